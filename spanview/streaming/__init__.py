"""Live sessions as streams."""
