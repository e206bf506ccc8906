"""Window frames grow or slide: none starts at a row of its own and runs to the end, which costs the square of a group."""

import pathlib
import re

import spanview
from spanview.operators import history


def test_no_frame_to_the_end_from_a_row_of_its_own():
    for path in pathlib.Path(spanview.__file__).parent.rglob("*.py"):
        for frame in re.findall(r"(?:rows|range)Between\(([^()]*)\)", path.read_text()):
            start, end = (x.strip() for x in frame.split(",")) if "," in frame else ("", "")
            assert "unboundedFollowing" not in end or "unboundedPreceding" in start, path


def test_deliveries_are_settled_by_the_next_event(spark):
    kinds = ["pending", "pending", "sent", "pending", "failed", "pending", "completed", "pending"]
    rows = [("s", i, k, f"u{i}", "r") for i, k in enumerate(kinds)] + [("t", 0, "pending", "u", "r"), ("u", 1, "sent", "u", "r")]
    got = {(x.session, x.seq): x.outcome for x in history.acknowledged(spark.createDataFrame(rows, "session string, seq long, kind string, unit_id string, revision string")).collect()}
    assert got == {("s", 0): "committed", ("s", 1): "committed", ("s", 3): "discarded", ("s", 5): "committed", ("s", 7): "pending", ("t", 0): "pending"}


def test_pruned_pairs_go_and_nothing_else(spark):
    messages = [
        ("s", 1, "assistant", None, [("a",), ("b",)], None), ("s", 2, "tool", "A", None, "a"), ("s", 3, "tool", "B", None, "b"), ("s", 4, "assistant", " ", [("c",)], None), ("s", 5, "tool", "C", None, "c"),
        ("s", 6, "assistant", "said", [("d",)], None), ("s", 7, "tool", "D", None, "d"), ("s", 8, "user", "hi", None, None), ("s", 9, None, "no role", None, "a"), ("t", 1, "tool", "A", None, "a"), (None, 1, "tool", "N", None, "a"),
    ]
    df = spark.createDataFrame(messages, "session string, seq long, role string, text string, tool_calls array<struct<id:string>>, call_id string")
    dropped = spark.createDataFrame([("s", "a"), ("s", "c"), ("s", "d"), ("s", "d"), ("s", "b")], "session string, call_id string")
    replaced = spark.createDataFrame([("s", "b", "[gone]")], "session string, call_id string, marker string")
    got = {(x.session, x.seq): (x.text, [c.id for c in x.tool_calls] if x.tool_calls is not None else None) for x in history.pruned(df, dropped, replaced).collect()}
    assert got == {
        ("s", 1): (None, ["b"]), ("s", 3): ("[gone]", None), ("s", 6): ("said", []), ("s", 8): ("hi", None), ("s", 9): ("no role", None), ("t", 1): ("A", None), (None, 1): ("N", None),
    }
