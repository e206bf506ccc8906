"""Units, scores, selections and projections over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import project, provenance, relocate, select
from .tables import BUDGET, TASK, TURN, UNITS_SQL, table, units


def _scored(spark, sf_dir):
    return select.scored(units(spark, sf_dir), TASK, TURN, BUDGET)


def _chosen(spark, sf_dir):
    return select.selected(_scored(spark, sf_dir), TURN, BUDGET)


def unit_identity(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "path", "unit_id", "revision")


def path_normal(spark, sf_dir):
    raw = F.concat(F.lit("./a//"), F.col("source"), F.lit("/../b\\"), F.col("doc_id").cast("string"), F.lit("/./c"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.normal_path(raw).alias("path"))


def anchors_first_last(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", relocate.anchors(F.col("content"), F.col("start_line")).alias("a")).select("doc_id", "a.first", "a.last", F.col("a.line_count").cast("bigint").alias("line_count"))


def terms(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", F.size(text.terms(F.col("content"))).cast("bigint").alias("n_terms"))


def term_overlap_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.col("overlap").cast("bigint").alias("overlap"), F.when(F.col("state") == "resolved", F.round("score", 9)).alias("score"))


def selection_rank(spark, sf_dir):
    return select.ranked(_scored(spark, sf_dir)).select("session", "doc_id", F.col("rank").cast("bigint").alias("rank"))


def select_greedy_budget(spark, sf_dir):
    return _chosen(spark, sf_dir).select("session", "doc_id", "disposition", "used")


def forced_pass(spark, sf_dir):
    return units(spark, sf_dir).filter(select.forced(TURN)).select("session", "doc_id")


def selection_summary(spark, sf_dir):
    return select.dispositions(_chosen(spark, sf_dir))


def render_order(spark, sf_dir):
    return select.render_order(_chosen(spark, sf_dir)).select("session", "doc_id", F.col("place").cast("bigint").alias("place"))


def render_unit(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", F.sha2(project.rendered_unit(), 256).alias("frame_sha256"))


def projection_text(spark, sf_dir):
    return project.projections(_chosen(spark, sf_dir), TURN).select("session", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


def decode_frames(spark, sf_dir):
    texts = project.projections(_chosen(spark, sf_dir), TURN)
    out = project.decoded(texts, "session").filter("error is null")
    return out.select("session", F.col("id").alias("unit_id"), "path", "content_bytes", F.sha2("content", 256).alias("sha256"))


def budget_resolution(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", select.adapter_budget(F.when(n % 7 == 0, n * 3), F.when(n % 5 == 0, n), F.when(n % 3 == 0, n * 20)).alias("budget"))


def line_slices(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", F.sha2(text.line_slice(F.col("content"), F.lit(2), F.lit(4)), 256).alias("slice_sha256"))


def line_bytes(spark, sf_dir):
    u = units(spark, sf_dir).select("doc_id", F.posexplode(text.lines(F.col("content"))).alias("at", "line"))
    return u.groupBy("doc_id").agg(F.sum(F.octet_length("line")).alias("bytes"), F.max(F.length(F.regexp_extract("line", "^[\\t ]*", 0))).cast("bigint").alias("indent"))


def hash_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"), F.lit("abc123").alias("commit"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("::file")).alias("selector"), F.lit("interior-edit").alias("scenario"), F.when(F.col("doc_id") % 9 == 0, "vendored").alias("reason"))
    return provenance.hash_sample(d, ["repo"], 5).select("doc_id", "rank_key", "disposition", "reason")


def path_classify(spark, sf_dir):
    i = F.col("doc_id")
    path = (
        F.when(i % 8 == 0, F.concat(F.lit("../x"), i.cast("string"), F.lit(".py"))).when(i % 8 == 1, F.concat(F.lit("vendor/"), i.cast("string"), F.lit(".js"))).when(i % 8 == 2, F.concat(F.lit("src/app.min.js")))
        .when(i % 8 == 3, F.concat(F.lit("src/"), i.cast("string"), F.lit(".txt"))).when(i % 8 == 4, F.concat(F.lit("a//b.py"))).when(i % 8 == 5, F.lit("lib/generated_code.go")).otherwise(F.concat(F.lit("src/"), i.cast("string"), F.lit(".PY")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", provenance.path_class(path).alias("reason"))


def unique_needle(spark, sf_dir):
    u = units(spark, sf_dir)
    unit = text.line_slice(F.col("content"), F.lit(1), F.lit(3))
    return u.select("doc_id", F.sha2(provenance.unique_needle(F.col("content"), unit, "The"), 256).alias("needle_sha256"))


def set_hash(spark, sf_dir):
    u = units(spark, sf_dir)
    return provenance.set_hash(u, ["session"], "path", "content").select("session", "members", "set_sha256")


def lines_hash(spark, sf_dir):
    # Trailing white space other than spaces and line ends does not occur in these texts.
    return units(spark, sf_dir).select("doc_id", provenance.lines_hash(F.regexp_replace("content", r"^\n+|\n+$", "")).alias("lines_sha256"))


def canonical_payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", provenance.canonical_json(F.col("props")).alias("canonical"))
    return e.select("event_id", F.sha2("canonical", 256).alias("canonical_sha256"))


_SCORED = f"""{UNITS_SQL},
words AS (SELECT list_distinct(regexp_extract_all(lower('{TASK}'), '[a-z_][a-z0-9_]{{2,}}')) AS w),
scored AS (
  SELECT n.*, length(content) AS size, len(list_intersect(list_distinct(regexp_extract_all(lower(path || chr(10) || chr(10) || content), '[a-z_][a-z0-9_]{{2,}}')), (SELECT w FROM words))) AS overlap FROM named n),
rated AS (
  SELECT *, CASE WHEN state = 'resolved' THEN greatest(0.0, 1 - greatest({TURN} - last_used_at, 0) / 12.0) * 4.0 + overlap * 8.0 + CASE WHEN changed_at = {TURN} THEN 2.0 ELSE 0.0 END
    + CASE WHEN pinned THEN 100.0 ELSE 0.0 END - size / {float(BUDGET)} * 1.5 ELSE CAST('-inf' AS DOUBLE) END AS score FROM scored)"""
_RANKED = f"""{_SCORED},
ordered AS (
  SELECT *, state = 'resolved' AND change_count >= 1 AND changed_at = {TURN} AS forced,
         row_number() OVER (PARTITION BY session ORDER BY (state = 'resolved' AND change_count >= 1 AND changed_at = {TURN}) DESC, pinned DESC, score DESC, unit_id) AS r FROM rated)"""
_CHOSEN = f"""WITH RECURSIVE {_RANKED},
walk AS (
  SELECT session, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST('' AS VARCHAR) AS disposition, CAST(NULL AS BIGINT) AS doc_id FROM (SELECT DISTINCT session FROM ordered)
  UNION ALL
  SELECT o.session, o.r, CASE WHEN o.state <> 'resolved' THEN w.used WHEN o.forced OR o.size = 0 OR w.used + o.size <= {BUDGET} THEN w.used + o.size ELSE w.used END,
         CASE WHEN o.state <> 'resolved' THEN 'unresolved' WHEN o.forced OR o.size = 0 OR w.used + o.size <= {BUDGET} THEN 'selected' ELSE 'budget' END, o.doc_id
  FROM walk w JOIN ordered o ON o.session = w.session AND o.r = w.r + 1),
chosen AS (SELECT o.*, w.used, w.disposition FROM walk w JOIN ordered o ON o.session = w.session AND o.r = w.r WHERE w.r > 0)"""
_FRAME = """'<span-unit id="' || unit_id || '" path="' || path || '" lines="1-' || end_line || '" revision="' || revision || '" resolution="whole-file" content-bytes="' || strlen(content) || '">' || chr(10) || content || chr(10) || '</span-unit>'"""
_NORMAL = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"

QUERIES = {
    "unit_identity": unit_identity, "path_normal": path_normal, "anchors_first_last": anchors_first_last, "terms": terms, "term_overlap_score": term_overlap_score, "selection_rank": selection_rank,
    "select_greedy_budget": select_greedy_budget, "forced_pass": forced_pass, "selection_summary": selection_summary, "render_order": render_order, "render_unit": render_unit,
    "projection_text": projection_text, "decode_frames": decode_frames, "budget_resolution": budget_resolution, "line_slices": line_slices, "line_bytes": line_bytes, "hash_sample": hash_sample,
    "path_classify": path_classify, "unique_needle": unique_needle, "set_hash": set_hash, "lines_hash": lines_hash, "canonical_payloads": canonical_payloads,
}

ORACLE_SQL = {
    "unit_identity": f"WITH {UNITS_SQL} SELECT doc_id, path, unit_id, revision FROM named",
    "path_normal": "SELECT doc_id, 'a/b/' || doc_id || '/c' AS path FROM documents",
    "anchors_first_last": rf"""WITH {UNITS_SQL}, l AS (SELECT doc_id, end_line, list_filter(list_transform(string_split(content, chr(10)), lambda x: {_NORMAL}), lambda x: x <> '') AS f FROM named)
SELECT doc_id, coalesce(f[1], '') AS first, coalesce(f[-1], '') AS last, CAST(end_line AS BIGINT) AS line_count FROM l""",
    "terms": f"WITH {UNITS_SQL} SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]{{2,}}'))) AS BIGINT) AS n_terms FROM named",
    "term_overlap_score": f"WITH {_SCORED} SELECT doc_id, CAST(overlap AS BIGINT) AS overlap, CASE WHEN state = 'resolved' THEN round(score, 9) END AS score FROM rated",
    "selection_rank": f"WITH {_SCORED} SELECT session, doc_id, row_number() OVER (PARTITION BY session ORDER BY pinned DESC, score DESC, unit_id) AS rank FROM rated",
    "select_greedy_budget": f"{_CHOSEN} SELECT session, doc_id, disposition, used FROM chosen",
    "forced_pass": f"WITH {UNITS_SQL} SELECT session, doc_id FROM named WHERE state = 'resolved' AND change_count >= 1 AND changed_at = {TURN}",
    "selection_summary": f"{_CHOSEN} SELECT session, count(*) FILTER (disposition = 'selected') AS selected, count(*) FILTER (disposition = 'unresolved') AS unresolved, count(*) FILTER (disposition = 'budget') AS budget, max(used) AS used_chars FROM chosen GROUP BY session",
    "render_order": f"{_CHOSEN} SELECT session, doc_id, row_number() OVER (PARTITION BY session ORDER BY change_count, unit_id) AS place FROM chosen WHERE disposition = 'selected'",
    "render_unit": f"WITH {UNITS_SQL} SELECT doc_id, sha256({_FRAME}) AS frame_sha256 FROM named",
    "projection_text": f"""{_CHOSEN}, p AS (
  SELECT session, list({_FRAME} ORDER BY change_count, unit_id) FILTER (disposition = 'selected') AS f, count(*) FILTER (disposition = 'unresolved') AS u, count(*) FILTER (disposition = 'budget') AS b FROM chosen GROUP BY session),
t AS (SELECT session, array_to_string(list_concat(['<span-context turn="{TURN}" selected="' || len(coalesce(f, [])) || '" unresolved="' || u || '" budget-omitted="' || b || '">' ||
  CASE WHEN len(coalesce(f, [])) > 0 THEN 'Files as they are now. Marks left by earlier reads point to this list.' ELSE '' END], coalesce(f, []), ['</span-context>']), chr(10)) AS text FROM p)
SELECT session, sha256(text) AS text_sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM t""",
    "decode_frames": f"{_CHOSEN} SELECT session, unit_id, path, CAST(strlen(content) AS BIGINT) AS content_bytes, sha256(content) AS sha256 FROM chosen WHERE disposition = 'selected'",
    "budget_resolution": """SELECT doc_id, CAST(CASE WHEN n_chars % 7 = 0 AND n_chars * 3 > 0 THEN n_chars * 3 WHEN n_chars % 5 = 0 AND n_chars > 0 THEN n_chars
  WHEN n_chars % 3 = 0 AND n_chars > 0 THEN least(32000, greatest(4000, floor(n_chars * 20 * 4 * 0.15))) ELSE 32768 END AS BIGINT) AS budget FROM documents""",
    "line_slices": f"WITH {UNITS_SQL} SELECT doc_id, sha256(coalesce(array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)), '')) AS slice_sha256 FROM named",
    "line_bytes": rf"""WITH {UNITS_SQL}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line FROM named)
SELECT doc_id, CAST(sum(strlen(line)) AS BIGINT) AS bytes, CAST(max(length(regexp_extract(line, '^[\t ]*'))) AS BIGINT) AS indent FROM l GROUP BY doc_id""",
    "hash_sample": """WITH c AS (SELECT doc_id, source AS repo, sha256('abc123' || source || '/' || doc_id || '::file' || 'interior-edit') AS rank_key, source || '/' || doc_id || '::file' AS selector, CASE WHEN doc_id % 9 = 0 THEN 'vendored' END AS reason FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank_key, selector) AS r FROM c WHERE reason IS NULL)
SELECT doc_id, rank_key, CASE WHEN r <= 5 THEN 'selected' ELSE 'rejected' END AS disposition, CASE WHEN r > 5 THEN 'below-rank-cutoff' END AS reason FROM g
UNION ALL SELECT doc_id, rank_key, 'rejected', reason FROM c WHERE reason IS NOT NULL""",
    "path_classify": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'path-escape' WHEN 1 THEN 'vendored' WHEN 2 THEN 'generated-or-minified' WHEN 3 THEN 'parser-not-implemented' WHEN 4 THEN 'path-escape' WHEN 5 THEN 'generated-or-minified' END AS reason FROM documents""",
    "unique_needle": f"""WITH {UNITS_SQL}, l AS (SELECT doc_id, content, list_filter(list_slice(string_split(content, chr(10)), 1, 3), lambda x: trim(x) <> '' AND NOT contains(x, 'The')) AS f FROM named),
o AS (SELECT doc_id, list_filter(f, lambda x: (length(content) - length(replace(content, x, ''))) / length(x) = 1) AS f FROM l) SELECT doc_id, sha256(f[-1]) AS needle_sha256 FROM o""",
    "set_hash": f"WITH {UNITS_SQL} SELECT session, count(*) AS members, sha256(string_agg(path || ':' || sha256(content), chr(10) ORDER BY path)) AS set_sha256 FROM named GROUP BY session",
    "lines_hash": f"""WITH {UNITS_SQL}, l AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(content, '^\\n+|\\n+$', '', 'g')), chr(10)), lambda x: x <> '') AS f FROM named)
SELECT doc_id, sha256(array_to_string(list_transform(f, lambda x, i: (i - 1) || ':' || sha256(x)), chr(10))) AS lines_sha256 FROM l""",
    "canonical_payloads": """SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS canonical_sha256 FROM events""",
}
