"""Path classes, deterministic samples, set hashes, and checks of packs and attestations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

#: Folders, names and extensions that decide a path's class.
VENDORED = ("node_modules", "vendor", "third_party", "dist", "build", "out", ".git", "__pycache__", "target")
BUILD_OUTPUT = ("build", "dist", "out")
SOURCES = (".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".go", ".rs", ".lua", ".c", ".h")
GENERATED = r"(?i)(?:^|[._-])(?:generated|min|bundle)(?:[._-]|$)"
#: Pack classifications, each earned after the one before.
CLASSIFICATIONS = ("unsealed-regression", "candidate", "locally-frozen", "remotely-attested", "sealed")
ATTESTED = ("schemaVersion", "packId", "freezeCommitSha", "manifestSha256", "reposLockSha256", "repositoryLocks", "workflowRunId", "workflowRunUrl", "attestedAt")


def path_class(path: Column) -> Column:
    """Why a path is no candidate, or null."""
    parts = F.split(path, "/", -1)
    base = F.element_at(parts, -1)

    def any_of(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(parts, F.array(*map(F.lit, names)))

    extension = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    return (
        F.when(any_of(("..", "")), "path-escape").when(any_of(VENDORED), "vendored").when(any_of(BUILD_OUTPUT), "build-output")
        .when(base.rlike(r"(?i)\.min\.(js|css)$") | base.rlike(GENERATED), "generated-or-minified").when(~extension.isin(*SOURCES), "parser-not-implemented")
    )


def rank_key(commit: Column, selector: Column, scenario: Column) -> Column:
    return F.sha2(F.concat(commit, selector, scenario), 256)


def hash_sample(candidates: DataFrame, by: list[str], n: int) -> DataFrame:
    """candidates (commit, selector, scenario, reason?) with rank_key, disposition and reason: the n smallest rank keys of each group.

    Rejected rows keep their reason. A candidate can be selected only if it is among the n
    smallest, which the ranking finds with at most n rows a task and group.
    """
    keyed = candidates.withColumn("rank_key", rank_key(F.col("commit"), F.col("selector"), F.col("scenario")))
    order = Window.partitionBy(*by).orderBy("rank_key", "selector")
    good = keyed.filter("reason is null").withColumn("_r", F.row_number().over(order))
    taken = good.withColumns({"disposition": F.when(F.col("_r") <= n, "selected").otherwise("rejected"), "reason": F.when(F.col("_r") > n, "below-rank-cutoff")}).drop("_r")
    return taken.unionByName(keyed.filter("reason is not null").withColumn("disposition", F.lit("rejected")))


def unique_needle(whole: Column, unit: Column, sentinel: str) -> Column:
    """The last non-blank line of a unit that occurs once in its file and lacks the sentinel; null if none does."""
    own = F.filter(text.lines(unit), lambda x: (F.trim(x) != "") & ~F.contains(x, F.lit(sentinel)))
    once = F.filter(own, lambda x: text.occurrences(whole, x) == 1)
    return F.when(F.size(once) > 0, F.element_at(once, -1))


def set_hash(rows: DataFrame, by: list[str], name: str, content: str) -> DataFrame:
    """(by, members, set_sha256) over `name:sha256(content)` lines in order of name; members without a name or content count but have no line.

    A set is streamed in order through one task, which holds a running hash, however many members it has.
    """
    line = F.concat(F.col(name).cast("string"), F.lit(":"), F.sha2(content, 256))
    keys = [F.col(c) for c in by]
    slim = rows.select(*keys, F.col(name).alias("_name"), line.alias("_line")).repartition(*keys)
    dealt = slim.sortWithinPartitions(*keys, F.col("_name").asc_nulls_last(), F.col("_line").asc_nulls_last()).select(*by, "_line")
    schema = ", ".join(f"`{c}` {k}" for c, k in dealt.dtypes if c != "_line") + ", members bigint, set_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        names = [*by, "members", "set_sha256"]

        def finished(types: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, n, h.hexdigest()) for k, n, h, _ in held)), types)], names=names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = [f.type for f in batch.schema][:-1] + [pa.int64(), pa.string()]
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != key:
                    if len(held) >= 1024:
                        yield finished(types)
                        held = []
                    now = [key, 0, hashlib.sha256(), False]
                    held.append(now)
                now[1] += 1
                if text is not None:
                    now[2].update((b"\n" if now[3] else b"") + text.encode())
                    now[3] = True
        if held:
            yield finished(types)

    return dealt.mapInArrow(run, schema)


def lines_hash(content: Column) -> Column:
    """Hash of the non-empty lines of a text: each as its place and hash."""
    own = F.filter(F.split(F.trim(content), "\n", -1), lambda x: x != "")
    return F.sha2(F.array_join(F.transform(own, lambda x, i: F.concat(i.cast("string"), F.lit(":"), F.sha2(x, 256))), "\n"), 256)


def _canonical(value: str | None) -> str | None:
    try:
        return None if value is None else json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def canonical_json(value: Column) -> Column:
    """JSON text with keys in order at every depth; null for what is no JSON."""

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        return values.map(_canonical)

    return canonical(value)


def binding_hash(attestation: Column) -> Column:
    """Hash of an attestation's indented JSON without its own hash."""

    @F.pandas_udf("string")
    def bind(values: pd.Series) -> pd.Series:
        import hashlib

        def one(v: str | None) -> str | None:
            try:
                body = {k: x for k, x in json.loads(v).items() if k != "bindingSha256"}
            except (TypeError, ValueError, AttributeError):
                return None
            return hashlib.sha256((json.dumps(body, indent=2, ensure_ascii=False) + "\n").encode()).hexdigest()

        return values.map(one)

    return bind(attestation)


def attestation_error(attestation: Column) -> Column:
    """The first fault of an attestation's JSON text, or null: fields, hashes, stub, run id, run address."""

    def field(name: str) -> Column:
        return F.get_json_object(attestation, f"$.{name}")

    missing = F.coalesce(*(F.when(F.coalesce(field(n), F.lit("")) == "", F.lit(f"missing {n}")) for n in ATTESTED))
    return F.coalesce(
        missing, F.when(~field("freezeCommitSha").rlike("^[0-9a-f]{40}$"), F.lit("freezeCommitSha invalid")), F.when(~field("manifestSha256").rlike("^[0-9a-f]{64}$"), F.lit("manifestSha256 invalid")),
        F.when(field("stub") == "true", F.lit("stub")), F.when(~field("workflowRunId").rlike(r"^\d+$"), F.lit("no production run id")),
        F.when(~field("workflowRunUrl").rlike(r"^https://github\.com/[^/]+/[^/]+/actions/runs/\d+"), F.lit("no production run address")),
    )


def classification_rank(value: Column) -> Column:
    """Place in CLASSIFICATIONS from 0, -1 for others."""
    return F.array_position(F.array(*map(F.lit, CLASSIFICATIONS)), value).cast("int") - 1


def advancement_error(current: Column, following: Column) -> Column:
    """Why a pack may not go from one classification to another, or null."""
    a, b = classification_rank(current), classification_rank(following)
    return F.when(current == following, F.lit(None).cast("string")).when((b <= a) & (current != "candidate"), "regress").when((b - a > 1) & (following != "candidate"), "skip")


def earned(packs: DataFrame) -> DataFrame:
    """packs (claimed, attested, report, run, generated, frozen) with earned: the claim if its evidence is there, else null."""
    all_of = F.col("attested") & F.col("report") & F.col("run") & F.col("generated")
    value = (
        F.when((F.col("claimed") == "sealed") & all_of, "sealed").when((F.col("claimed") == "remotely-attested") & F.col("attested") & F.col("frozen"), "remotely-attested")
        .when((F.col("claimed") == "locally-frozen") & F.col("frozen"), "locally-frozen").when(F.col("claimed") == "candidate", "candidate")
    )
    return packs.withColumn("earned", value)


def verified(expected: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """(by, checked, errors): artifacts (by, name, sha256) that differ, are missing or are not expected."""
    e = expected.select(*by, "name", F.col("sha256").alias("want"))
    a = actual.select(*by, "name", F.col("sha256").alias("have"))
    rows = e.join(a, [*by, "name"], "full_outer")
    error = F.when(F.col("have").isNull(), F.concat(F.lit("missing "), "name")).when(F.col("want").isNull(), F.concat(F.lit("unexpected "), "name")).when(F.col("want") != F.col("have"), F.concat(F.lit("hash mismatch "), "name"))
    return rows.withColumn("_e", error).groupBy(*by).agg(F.count("*").alias("checked"), F.array_sort(F.collect_list("_e")).alias("errors"))


def guard(changes: DataFrame) -> DataFrame:
    """(pack, errors) of added files (pack, kind: trace, result, manifest; exempt): packs that add frozen inputs and results at once, or exempt themselves."""
    rows = changes.groupBy("pack").agg(F.max(F.col("kind") == "trace").alias("t"), F.max(F.col("kind") == "result").alias("r"), F.max(F.coalesce("exempt", F.lit(False))).alias("x"), F.max(F.col("kind") == "manifest").alias("m"))
    errors = F.array_compact(F.array(F.when(F.col("t") & F.col("r"), "mixed-introduction"), F.when(F.col("x"), "exempt-forbidden"), F.when(F.col("t") & ~F.col("m"), "stray-trace")))
    return rows.select("pack", errors.alias("errors"))


def lock_errors(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """(id, error) of manifest entries (id, ref, sha256) whose lock (id, ref, sha256) is missing or differs."""
    rows = manifest.join(lock.select("id", F.col("ref").alias("_ref"), F.col("sha256").alias("_sha")), "id", "left")
    error = F.when(F.col("_ref").isNull(), "not locked").when(F.col("ref") != F.col("_ref"), "ref differs").when(~F.col("sha256").eqNullSafe(F.col("_sha")), "hash differs")
    return rows.withColumn("error", error).filter("error is not null").select("id", "error")


#: Phases of a pack's life and what each needs first.
PHASES = {"freeze": ("manifest",), "generate": ("manifest", "freeze"), "run": ("manifest", "freeze", "generate"), "report": ("manifest", "freeze", "generate", "run")}


def phase_errors(done: DataFrame) -> DataFrame:
    """(pack, phase, error) of phases (pack, phase, seq) that came before what they need."""
    needs = F.create_map(*(x for k, v in PHASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = done.withColumn("need", F.explode_outer(needs[F.col("phase")]))
    first = done.groupBy("pack", F.col("phase").alias("need")).agg(F.min("seq").alias("_at"))
    late = rows.join(first, ["pack", "need"], "left").filter(F.col("need").isNotNull() & (F.col("_at").isNull() | (F.col("_at") > F.col("seq"))))
    return late.groupBy("pack", "phase").agg(F.array_join(F.array_sort(F.collect_set("need")), ",").alias("error")).select("pack", "phase", F.concat(F.lit("needs "), "error").alias("error"))
