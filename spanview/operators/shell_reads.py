"""Shell commands as rows: what they read, which tracked files they dump."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shell

_READ = "path string, scope string, start_line bigint, end_line bigint, tail_lines bigint"


def parsed(commands: DataFrame) -> DataFrame:
    """commands with read (null where the command is no plain read) and dumped (paths of a dump of several files)."""

    @F.pandas_udf(f"struct<{_READ.replace(' ', ':').replace(',:', ',')}>")
    def read(command: pd.Series) -> pd.DataFrame:
        rows = [shell.file_read(c) or {} for c in command]
        return pd.DataFrame(rows, columns=["path", "scope", "start_line", "end_line", "tail_lines"]).astype({c: "Int64" for c in ("start_line", "end_line", "tail_lines")})

    @F.pandas_udf("array<string>")
    def dumped(command: pd.Series) -> pd.Series:
        return command.map(shell.dumped_paths)

    out = commands.withColumns({"read": read("command"), "dumped": dumped("command")})
    return out.withColumn("read", F.when(F.col("read.path").isNotNull(), F.col("read")))


def command_of(arguments: Column) -> Column:
    """The command in a tool call's JSON arguments, under any of its names."""
    return F.trim(F.coalesce(*(F.get_json_object(arguments, f"$.{k}") for k in ("command", "cmd", "script"))))


def observed_spans(reads: DataFrame) -> DataFrame:
    """reads (read, file_text, seen) with span (start_line, end_line), null where the output isn't what the file has there."""

    @F.pandas_udf("struct<start_line:bigint,end_line:bigint>")
    def span(read: pd.Series, text: pd.Series, seen: pd.Series) -> pd.DataFrame:
        rows = []
        for r, t, s in zip(read, text, seen):
            value = json.loads(r) if r else None
            value = {"path": None, "scope": None, "start_line": None, "end_line": None, "tail_lines": None, **value} if value else None
            rows.append(shell.observed_span(value, t or "", s or "") or (None, None))
        return pd.DataFrame(rows, columns=["start_line", "end_line"]).astype("Int64")

    out = reads.withColumn("span", span(F.to_json("read"), "file_text", "seen"))
    return out.withColumn("span", F.when(F.col("span.start_line").isNotNull(), F.col("span")))


def stale_dumps(commands: DataFrame, tracked: DataFrame) -> DataFrame:
    """Commands (session, call_id, command) that name tracked paths (session, path): (session, call_id, paths, untracked).

    A dump of several files names the tracked ones among them; any other command counts if it
    mentions exactly one. A session's tracked paths come to its commands as one array.
    """
    paths = tracked.groupBy("session").agg(F.collect_set("path").alias("_tracked"))

    @F.pandas_udf("struct<paths:array<string>,untracked:array<string>>")
    def match(command: pd.Series, known: pd.Series) -> pd.DataFrame:
        rows = []
        for c, own in zip(command, known):
            own = list(own)
            named = list(dict.fromkeys(p.removeprefix("./") for p in shell.dumped_paths(c)))
            if len(shell.dumped_paths(c)) >= 2:
                by = {p.removeprefix("./"): p for p in sorted(own, key=len)}
                rows.append(([by[p] for p in named if p in by], [p for p in named if p not in by]))
            else:
                hits = shell.mentioned(c, own)
                rows.append((hits if len(hits) == 1 else [], []))
        return pd.DataFrame(rows, columns=["paths", "untracked"])

    out = commands.join(paths, "session").withColumn("m", match("command", "_tracked"))
    return out.filter(F.size("m.paths") > 0).select("session", "call_id", "m.paths", "m.untracked")


def discovered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Completed shell calls (session, call_id, arguments) that read one file: (session, call_id, path, scope, start_line, end_line, tail_lines)."""
    commands = calls.withColumn("command", command_of(F.col("arguments"))).join(results.select("session", "call_id").distinct(), ["session", "call_id"], "left_semi")
    return parsed(commands.filter("command is not null")).filter("read is not null").select("session", "call_id", "read.*")
