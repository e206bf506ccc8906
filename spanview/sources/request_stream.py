"""Requests as a stream: a data source over a spool folder into which hosts put files of JSON lines.

Files appear whole (written elsewhere, then renamed) and under rising names, folders included, such as a time or a counter. The
offset is the name of the last file that was taken, so a batch is the files between two names, whatever has come since; a batch
that is run again reads the same lines. Each file is a partition and is read by a task, line by line.

Rows are (file, line, value): what is no JSON is for requests() to tell apart, which keeps it beside the good ones. Lines of
over limit bytes come without their value. Empty lines are no requests. A file that is named before the offset is never read.
Any file system that pyarrow reaches by its address will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import BODY_LIMIT

SCHEMA = "file string, line bigint, value string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _File(InputPartition):
    name: str


class _Spool:
    def __init__(self, options: dict):
        self.path, self.limit = options["path"].rstrip("/"), int(options.get("limit", BODY_LIMIT))

    def names(self) -> list[str]:
        """Files in order; those whose name or folder begins with a dot or an underscore are not there yet."""
        where, top = _opened(self.path)
        found = where.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        names = (x.path[len(top.rstrip("/")) + 1 :] for x in found if x.is_file)
        return sorted(n for n in names if not any(part[0] in "._" for part in n.split("/")))

    def lines(self, name: str) -> Iterator[tuple]:
        where, top = _opened(self.path)
        with where.open_input_stream(f"{top}/{name}") as stream:
            number, rest, over = 0, b"", False
            while True:
                block = stream.read(1 << 20)
                *whole, rest_now = (rest + block).split(b"\n") if block else [rest, b""]
                for raw in whole:
                    number += 1
                    raw = raw.rstrip(b"\r")
                    if over or len(raw) > self.limit:
                        yield name, number, None
                    elif raw.strip():
                        yield name, number, raw.decode("utf-8", "replace")
                    over = False
                if not block:
                    return
                # Of a line that is too long only the fact is kept.
                over = over and not whole or len(rest_now) > self.limit
                rest = b"" if over else rest_now


class _Reader(DataSourceReader):
    def __init__(self, spool: _Spool):
        self.spool = spool

    def partitions(self) -> list[InputPartition]:
        return [_File(n) for n in self.spool.names()]

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.spool.lines(partition.name) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, spool: _Spool):
        self.spool = spool

    def initialOffset(self) -> dict:  # noqa: N802  the interface's names
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(self.spool.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(n) for n in self.spool.names() if start["after"] < n <= end["after"]]

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.spool.lines(partition.name)

    def commit(self, end: dict) -> None:
        pass


class RequestSpool(DataSource):
    """format("request_spool"), option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return "request_spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Spool(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Spool(self.options))


def lines(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    spark.dataSource.register(RequestSpool)
    return (spark.readStream if streaming else spark.read).format("request_spool").option("path", path).load()


def requests(lines_: DataFrame) -> DataFrame:
    """lines with request, a variant, and malformed: not an object in JSON."""
    request = F.try_parse_json("value")
    ok = F.coalesce(F.startswith(F.schema_of_variant(request), F.lit("OBJECT")), F.lit(False))
    return lines_.withColumns({"request": F.when(ok, request), "malformed": ~ok})
