"""Sinks and the sources that read them: each query writes what the tables give and returns what comes back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance
from ..sources import readers, writers
from .tables import scratch, table


def jsonl_results(spark, sf_dir):
    """Line items as result records, written as JSON lines in two parts and read back."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("cell"), F.col("l_shipmode" if "l_shipmode" in li.columns else "l_linestatus").alias("trace"), F.col("l_returnflag").alias("method"),
        F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("recall"), F.col("l_quantity").cast("bigint").alias("projectionBytes"), F.col("l_linenumber").alias("n"),
    )
    path = scratch(spark, "results")
    writers.json_lines(rows.filter("n < 4").drop("n"), path)
    writers.json_lines(rows.filter("n >= 4").drop("n"), path, append=True)
    back = readers.results(spark, path)
    return back.groupBy("method").agg(F.count("*").alias("n"), F.count("recall").alias("recalls"), F.sum("projectionBytes").alias("bytes"), F.countDistinct("cell").alias("cells"))


def tsv_ledger(spark, sf_dir):
    """Orders as an experiment ledger, written as TSV with n/a for what is missing and read back."""
    o = table(spark, sf_dir, "orders")
    values = {
        "timestamp": F.date_format("o_orderdate", "yyyy-MM-dd"), "commit": F.col("o_orderkey").cast("string"), "decision": F.col("o_orderstatus"),
        "projection_bytes": F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).cast("string"), "train_score": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 100).cast("string"),
    }
    path = scratch(spark, "ledger")
    writers.tsv(o.select(*(values.get(c, F.lit(None).cast("string")).alias(c) for c in readers.LEDGER_COLUMNS)), path)
    back = readers.experiment_ledger(spark, path)
    return back.select("timestamp", F.col("commit").cast("bigint").alias("commit"), "decision", "projection_bytes", "train_score", "required_recall")


def state_versions(spark, sf_dir):
    """Customers as session state, written three times: the newest whole version is read."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    path = scratch(spark, "state")
    for n in range(3):
        writers.state(c.select("c_custkey", (F.col("c_acctbal") + n).alias("balance"), F.lit(n).alias("version")), path)
    return readers.latest_state(spark, path)


def request_lines(spark, sf_dir):
    """Turns as request objects, one a line, read as variants; every seventh line is cut off and no JSON."""
    c = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    line = F.when(F.col("turn") % 7 == 6, F.substring(body, 1, 9)).otherwise(body)
    path = scratch(spark, "requests")
    c.select(line.alias("value")).write.text(path)
    r = F.col("request")
    return readers.requests(spark, path, lines=True).select(
        F.try_variant_get(r, "$.id", "bigint").alias("id"), F.try_variant_get(r, "$.messages[0].role", "string").alias("role"), F.length(F.try_variant_get(r, "$.messages[0].content", "string")).cast("bigint").alias("chars")
    )


def report_guard(spark, sf_dir):
    """Which of the documents' report paths are refused."""
    i = F.col("doc_id")
    path = F.concat(F.when(i % 3 == 0, "a/packs/").otherwise("b/"), F.when(i % 2 == 0, "sealed-").otherwise("open-"), i.cast("string"), F.when(i % 5 == 0, "/results.jsonl").otherwise("/report.md"))
    return table(spark, sf_dir, "documents").select("doc_id", writers.refused(path).alias("refused"))


def binding_hash(spark, sf_dir):
    """Hash of each order's attestation, whatever hash it carries itself."""
    o = table(spark, sf_dir, "orders")
    body = F.to_json(F.struct(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("packId"), F.col("o_custkey").alias("n"), F.when(F.col("o_orderkey") % 2 == 0, "x").alias("bindingSha256")))
    return o.select("o_orderkey", provenance.binding_hash(body).alias("binding_sha256"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__}

ORACLE_SQL = {
    "jsonl_results": "SELECT l_returnflag AS method, count(*) AS n, count(*) FILTER (l_linenumber > 1) AS recalls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(DISTINCT l_orderkey) AS cells FROM lineitem GROUP BY 1",
    "tsv_ledger": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS timestamp, o_orderkey AS "commit", o_orderstatus AS decision, CAST(CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS DOUBLE) AS projection_bytes,
CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 END AS DOUBLE) AS train_score, CAST(NULL AS DOUBLE) AS required_recall FROM orders""",
    "state_versions": "SELECT c_custkey, c_acctbal + 2 AS balance, 2 AS version FROM customer",
    "request_lines": "SELECT CASE WHEN turn % 7 < 6 THEN conv_id END AS id, CASE WHEN turn % 7 < 6 THEN role END AS role, CASE WHEN turn % 7 < 6 THEN length(text) END AS chars FROM conversations",
    "report_guard": "SELECT doc_id, doc_id % 5 = 0 OR (doc_id % 3 = 0 AND doc_id % 2 = 0) AS refused FROM documents",
    "binding_hash": """SELECT o_orderkey, sha256('{' || chr(10) || '  "packId": "p' || o_orderkey || '",' || chr(10) || '  "n": ' || o_custkey || chr(10) || '}' || chr(10)) AS binding_sha256 FROM orders""",
}
