"""Whole relocation decisions over rows that hold whole files: few of them are Python objects at once."""

from spanview.operators import relocate

UNITS = "session int, unit_id string, path string, scope string, selector string, content string, start_line int, end_line int, file_lines int"


def test_rows_pass_in_slices_and_all_cases_come_back(spark):
    units = [(i % 3, f"u{i}", f"p{i}", "region", None, f"a {i}\nb {i}\nc {i}", 1, 3, None) for i in range(200)] + [(7, "file", "p0", "file", None, "old", 1, 1, 1), (None, "none", "p1", "region", None, "x", None, None, None)]
    files = [(i % 3, f"p{i}", f"top\r\na {i}\nb {i}\nc {i}\nend" if i % 5 else None) for i in range(0, 200, 2)]
    out = relocate.relocated(spark.createDataFrame(units, UNITS).coalesce(1), spark.createDataFrame(files, "session int, path string, content string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Pandas" not in plan and relocate.SLICE <= 64
    rows = {x.unit_id: tuple(x)[2:] for x in out.collect()}
    assert len(rows) == 202 and {x.session for x in out.collect()} == {0, 1, 2, 7, None}
    for i in range(200):
        assert rows[f"u{i}"] == (("resolved", "exact", f"a {i}\nb {i}\nc {i}", 2, 4) if i % 2 == 0 and i % 5 else ("unresolved", "source-missing", None, None, None))
