"""Queries of the operators by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op13_alignment
from .decontaminate import op4_decontamination
from .embedding_dedup import op1_embedding_dedup
from .html_text import op5_html_text
from .language_id import op3_language_id
from .license_scan import license_sql, op8_license_scan
from .lp_packing import op12_lp_packing
from .mixing import op6_mixing
from .packing import op2_packing
from .secret_scan import op10_secret_scan, secret_sql
from .simhash import op7_simhash
from .spelling import op11_spelling, spelling_sql
from .warc import op9_warc

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_html_text": op5_html_text,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_license_scan": op8_license_scan,
    "op9_warc": op9_warc,
    "op10_secret_scan": op10_secret_scan,
    "op11_spelling": op11_spelling,
    "op12_lp_packing": op12_lp_packing,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": """WITH RECURSIVE
ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
       AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN links l ON l.a = reach.r),
least AS (SELECT a, min(r) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op8_license_scan": license_sql(),
    "op10_secret_scan": secret_sql(),
    "op11_spelling": spelling_sql(),
    "op9_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
n AS (SELECT page_id, d, CAST(strlen(h) AS BIGINT) AS b, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j: strpos('0123456789abcdef', substr(d, 5 * i + j + 1, 1)) - 1), lambda x, y: 16 * x + y)) AS v FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d, b) AS o FROM n)
SELECT page_id, b AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x // q % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to FROM f""",
}
