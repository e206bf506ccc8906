"""Column functions: text spans, identities and numbers. All stay inside the JVM."""
