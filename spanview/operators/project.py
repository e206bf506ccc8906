"""Rendered projections: length-framed units in an envelope, and their decoder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import engine
from ..functions.text import escape_attribute


def rendered_unit(tag: str = engine.UNIT_TAG) -> Column:
    """Frame of a unit from its columns; its head states the content's UTF-8 length."""
    head = F.concat(
        F.lit(f'<{tag} id="'), escape_attribute(F.col("unit_id")), F.lit('" path="'), escape_attribute(F.col("path")), F.lit('" lines="'),
        F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")), F.lit('" revision="'), escape_attribute(F.col("revision")),
        F.lit('" resolution="'), escape_attribute(F.col("method")), F.lit('" content-bytes="'), F.octet_length("content").cast("string"), F.lit('">\n'),
    )
    return F.concat(head, F.col("content"), F.lit(f"\n</{tag}>"))


def projections(chosen: DataFrame, turn: int, unit_tag: str = engine.UNIT_TAG, envelope_tag: str = engine.ENVELOPE_TAG) -> DataFrame:
    """(session, text): the envelope of each session. It is one text, so a session's selected units, those within the budget and those that have just changed, are gathered in a row."""
    taken = F.col("disposition") == "selected"
    frames = F.transform(F.array_sort(F.collect_list(F.when(taken, F.struct("change_count", "unit_id", rendered_unit(unit_tag).alias("frame"))))), lambda x: x["frame"])
    rows = chosen.groupBy("session").agg(frames.alias("frames"), F.count_if(F.col("disposition") == "unresolved").alias("u"), F.count_if(F.col("disposition") == "budget").alias("b"))
    head = F.concat(F.lit(f'<{envelope_tag} turn="{turn}" selected="'), F.size("frames").cast("string"), F.lit('" unresolved="'), F.col("u").cast("string"), F.lit('" budget-omitted="'), F.col("b").cast("string"), F.lit('">'))
    head = F.concat(head, F.when(F.size("frames") > 0, engine.PREAMBLE).otherwise(""))
    return rows.select("session", F.array_join(F.concat(F.array(head), F.col("frames"), F.array(F.lit(f"</{envelope_tag}>"))), "\n").alias("text"))


def decoded(texts: DataFrame, key: str, tag: str = engine.UNIT_TAG, fail_fast: bool = False) -> DataFrame:
    """Units of each projection text: (key, place, id, path, lines, revision, resolution, content_bytes, content, error).

    A projection whose frames don't add up gives one row with the error, or fails the query.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, value in zip(pdf[key], pdf["text"]):
                try:
                    units, error = engine.decode(value or "", tag), None
                except engine.FrameError as e:
                    if fail_fast:
                        raise
                    units, error = [{}], str(e)
                rows += [(k, i, u.get("id"), u.get("path"), u.get("lines"), u.get("revision"), u.get("resolution"), u.get("content_bytes"), u.get("content"), error) for i, u in enumerate(units)]
            yield pd.DataFrame(rows, columns=[key, "place", "id", "path", "lines", "revision", "resolution", "content_bytes", "content", "error"]).astype({"content_bytes": "Int64"})

    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, place int, id string, path string, lines string, revision string, resolution string, content_bytes bigint, content string, error string")
