"""A training corpus from raw documents: five stages, each written before the next reads it.

Cases: documents with a null text, or one without letters, have no known language and go at the first stage. Of equal and near
texts the one with the smaller doc_id stays; rows without doc_id are documents like others. Ties are broken as each stage's
module says, so runs agree. Texts are taken whole, however long. All columns of documents pass through the first four stages,
whatever their names; the last one gives packed rows. Empty tables give an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanview.llm import decontaminate, language_id, mixing, packing, simhash
from spanview.llm.common import dropped, settled, table

#: Documents of a known language; one of each near-duplicate group; those without benchmark
#: passages; the mix by source weights; packed token rows.
STAGES = [
    ("language_id", language_id.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Compression, hashing and tokenisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; cases as above. What a stage has written on its way is deleted once its result stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, before = settled(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}"), docs  # noqa: B023
        if name != STAGES[0][0]:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
