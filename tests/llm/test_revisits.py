"""Revisit records name the original's address and date, and one record with very many revisits is resolved in parts."""

import gzip
import io

from spanview.llm import warc
from spanview.llm.common import new_path


def test_revisits_name_the_original(spark):
    pages = [(3, "http://x/3", "same"), (1, "http://x/a b", "same"), (2, None, "same"), (4, "http://x/4", "other"), (None, "http://x/n", "same")]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    headers = {}
    for f in spark.read.format("binaryFile").load(path).collect():
        if f.path.rsplit("/", 1)[-1].startswith("part-"):
            headers |= {h["x-page-id"]: h for h, _ in warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(f.content)))}
    assert {p: h["warc-type"] for p, h in headers.items()} == {"1": "response", "2": "revisit", "3": "revisit", "": "revisit", "4": "response"}
    for p in ("2", "3", ""):
        assert headers[p]["warc-refers-to"] == headers["1"]["warc-record-id"] and headers[p]["warc-refers-to-target-uri"] == "http://x/a%20b" and headers[p]["warc-refers-to-date"] == headers["1"]["warc-date"]
    assert len({h["warc-record-id"] for h in headers.values()}) == 5 and "warc-refers-to-date" not in headers["1"]


def test_a_hot_record(spark):
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "IF(id % 10 = 0, concat('page ', id), 'hot') AS html").repartition(8)
    path = new_path(spark, "warc")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path)
    out = warc.resolved(read)
    got = {x.refers_to: x["count"] for x in out.groupBy("refers_to").count().collect()}
    assert got == {None: 2001, 1: 17_999}
    # The join has exchanges of its own on both sides.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = warc.resolved(read)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("ENSURE_REQUIREMENTS") >= 3
