"""Cost ledgers of arms and sessions, success boards, and usage found in responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.numbers import estimated_tokens

#: US dollars a million tokens, by schedule: input from cache, input, output.
RATES = {"off-peak": (0.007, 0.22, 0.66), "peak": (0.014, 0.44, 1.32)}
LONG_SESSION = 8
TWO_TURN_CELLS = ("t1-read", "t2-settle")


def cost(prompt: Column, completion: Column, schedule: str = "off-peak", cached: bool = False) -> Column:
    """Dollars of a request; null without prompt tokens."""
    hit, miss, output = RATES[schedule]
    return prompt / 1e6 * (hit if cached else miss) + F.coalesce(completion, F.lit(0)) / 1e6 * output


def decorated(turns: DataFrame) -> DataFrame:
    """turns (arm, turn, cell_id, request_bytes, prompt_tokens, completion_tokens, source) with estimates, sources and costs."""
    known = F.col("prompt_tokens").isNotNull()
    out = turns.withColumns({
        "cell_id": F.coalesce("cell_id", F.concat(F.lit("t"), F.col("turn").cast("string"))), "estimated_prompt_tokens": F.coalesce("prompt_tokens", estimated_tokens(F.col("request_bytes"))),
        "source": F.coalesce("source", F.when(known, "provider").otherwise("synthetic")), "token_source": F.when(known, "provider").otherwise("bytes-estimate"),
    })
    return out.withColumns({"cost": cost(F.col("prompt_tokens"), F.col("completion_tokens")), "cost_estimated": cost(F.col("estimated_prompt_tokens"), F.col("completion_tokens"))})


def cumulative(rows: DataFrame) -> DataFrame:
    """Running sums of each arm; null until the first value, nulls skipped after it."""
    so_far = Window.partitionBy("arm").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"cumulative_{c}": F.sum(c).over(so_far) for c in ("request_bytes", "prompt_tokens", "cost")})


def totals(rows: DataFrame) -> DataFrame:
    """One row an arm; what the provider didn't state is null where it stated nothing at all."""
    sums = rows.groupBy("arm").agg(
        F.count("*").alias("turns"), F.count("prompt_tokens").alias("_stated"), *(F.sum(c).alias(c) for c in ("request_bytes", "prompt_tokens", "completion_tokens", "estimated_prompt_tokens"))
    )
    stated = F.col("_stated")
    kind = F.when(F.col("turns") == 0, "none").when(stated == F.col("turns"), "provider").when(stated == 0, "bytes-estimate").otherwise("mixed")
    out = sums.withColumn("token_source", kind)
    some = F.col("token_source") != "bytes-estimate"
    return out.select(
        "arm", "turns", "request_bytes", F.when(some, F.col("prompt_tokens")).alias("prompt_tokens"), F.when(some, F.col("completion_tokens")).alias("completion_tokens"), "estimated_prompt_tokens",
        F.when(F.col("token_source") == "provider", cost(F.col("prompt_tokens"), F.col("completion_tokens"))).alias("cost"),
        cost(F.col("estimated_prompt_tokens"), F.col("completion_tokens")).alias("cost_estimated"), "token_source",
    )


def turn_errors(turns: DataFrame) -> DataFrame:
    """(arm, turn, error) of turns that a ledger must refuse."""
    n = F.count("*").over(Window.partitionBy("arm", "turn"))
    error = F.when(F.col("arm").isNull(), "no arm").when(~F.coalesce(F.col("turn") >= 1, F.lit(False)), "turn must be a positive integer").when(n > 1, "duplicate turn")
    return turns.select("arm", "turn", error.alias("error")).filter("error is not null").distinct()


def arm_comparison(sums: DataFrame, baseline: str) -> DataFrame:
    """Differences of each arm's totals from the baseline arm's, null where either is."""
    values = ["request_bytes", "prompt_tokens", "cost", "cost_estimated"]
    # An aggregate without keys is one row, whatever the sums hold: that is the bound of what is broadcast.
    base = sums.filter(F.col("arm") == baseline).agg(F.first(F.struct(*values)).alias("_base")).filter(F.col("_base").isNotNull())
    return sums.crossJoin(F.broadcast(base)).select("arm", *((F.col(v) - F.col(f"_base.{v}")).alias(f"{v}_delta") for v in values))


def usage(response: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, usage_from) that a response states, as JSON or in text."""
    parsed = F.get_json_object(response, "$.usage")

    def number(*names: str) -> Column:
        return F.coalesce(*(F.get_json_object(response, f"$.usage.{n}").try_cast("bigint") for n in names))

    def found(name: str) -> Column:
        value = F.regexp_extract(response, rf'"{name}"\s*:\s*(\d+)', 1)
        return F.when(value != "", value).try_cast("bigint")

    whole = F.startswith(F.coalesce(parsed, F.lit("")), F.lit("{"))
    loose = response.rlike(r'"usage"\s*:')
    prompt = F.when(whole, number("prompt_tokens", "input_tokens")).when(loose, found("prompt_tokens"))
    completion = F.when(whole, number("completion_tokens", "output_tokens")).when(loose, found("completion_tokens"))
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.when(whole | loose, "provider-response").otherwise("none").alias("usage_from"))


def stream_usage(body: Column) -> Column:
    """The last usage object among the `data: {` lines of an event stream, as JSON text."""
    data = F.transform(F.filter(F.split(body, "\n", -1), lambda x: F.startswith(x, F.lit("data: {"))), lambda x: F.get_json_object(F.substring(x, 7, 2**31 - 1), "$.usage"))
    found = F.filter(data, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def scan_turns(scans: DataFrame) -> DataFrame:
    """Ledger turns of request scans (arm, file, n, bytes, prompt_tokens array): turn is n, or the scan's place by file name."""
    place = F.row_number().over(Window.partitionBy("arm").orderBy("file"))
    last = F.filter("prompt_tokens", lambda x: x.isNotNull())
    return scans.withColumn("turn", F.coalesce("n", place)).select(
        "arm", "turn", F.col("bytes").alias("request_bytes"), F.when(F.size(last) > 0, F.element_at(last, -1)).alias("last_prompt_tokens"),
        F.when(F.size(last) > 0, F.aggregate(last, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("prompt_tokens"),
    )


def session_kinds(turns: DataFrame) -> DataFrame:
    """(session, turns, kind, valid) of sessions by their turns (session, cell_id) and label (the same in all rows)."""
    late = F.regexp_extract("cell_id", r"^t(\d+)", 1).try_cast("int") >= 3
    sums = turns.groupBy("session").agg(
        F.count("*").alias("turns"), F.min("label").alias("label"), F.count("cell_id").alias("_named"),
        F.count_if(F.col("cell_id").isNotNull() & ~F.col("cell_id").isin(*TWO_TURN_CELLS)).alias("_other"), F.count_if(late).alias("_late"),
    )
    label = F.coalesce("label", F.lit(""))
    two = F.when(label.rlike("(?i)two-turn|2-turn|two_turn"), F.col("turns") <= 2).otherwise((F.col("turns") == 2) & ((F.col("_named") == 0) | ((F.col("_other") == 0) & (F.col("_late") == 0))))
    four = label.rlike("(?i)four-turn|4-turn|four_turn|multi-turn-trial|four-turn-multiturn")
    kind = F.when(two, "two-turn").when(four, "four-turn").when(F.col("turns") < LONG_SESSION, "short").otherwise("long")
    return sums.select("session", "turns", kind.alias("kind"), (kind == "long").alias("valid"))


def scored_cells(cells: DataFrame) -> DataFrame:
    """cells (exact, stdout: yes, no, n/a, true, false or null; missing) with verdict and reason."""
    present = F.col("exact").isNotNull() & F.col("stdout").isNotNull() & ~F.coalesce(F.col("missing"), F.lit(False))
    skip = (F.col("exact") == "n/a") & (F.col("stdout") == "n/a")
    good = F.col("exact").isin("yes", "true") & F.col("stdout").isin("yes", "true")
    verdict = F.when(~present, "fail").when(skip, "n/a").when(good, "pass").otherwise("fail")
    reason = F.when(~present, "missing-dump").when(skip, "asserts-not-applicable").when(good, "exact-current-and-stdout").otherwise("assert-failed")
    return cells.withColumns({"verdict": verdict, "reason": reason})


def board(cells: DataFrame, by: list[str]) -> DataFrame:
    """Verdict of each task: any failing cell fails it, and so does a task without a passing one."""
    sums = scored_cells(cells).groupBy(*by).agg(
        F.count_if(F.col("verdict") == "fail").alias("_fails"), F.count_if(F.col("reason") == "missing-dump").alias("_missing"), F.count_if(F.col("verdict") == "pass").alias("_passes")
    )
    good = (F.col("_fails") == 0) & (F.col("_passes") > 0)
    reason = F.when(good, "exact-current-and-stdout").when((F.col("_missing") > 0) | (F.col("_fails") == 0), "missing-dump").otherwise("assert-failed")
    return sums.select(*by, F.when(good, "pass").otherwise("fail").alias("verdict"), reason.alias("reason"))


def payload_scan(payloads: DataFrame, markers: dict[str, str]) -> DataFrame:
    """payloads with bytes, a boolean for each marker text, and the resolution that the first frame names."""
    found = {name: F.contains("payload", F.lit(marker)) for name, marker in markers.items()}
    resolution = F.regexp_extract("payload", r'resolution="([^"]*)"', 1)
    return payloads.withColumns({"bytes": F.octet_length("payload").cast("bigint"), **found, "resolution": F.when(resolution != "", resolution).otherwise("none")})


def answer_matches(answer: Column, expected: Column) -> Column:
    """Whether the number in an answer, bare JSON or the last fenced block, is the expected one."""
    fenced = F.regexp_extract_all(answer, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    body = F.trim(F.when(F.size(fenced) > 0, F.element_at(fenced, -1)).otherwise(answer))
    value = F.coalesce(F.get_json_object(body, "$.answer").try_cast("double"), body.try_cast("double"))
    return F.coalesce(value == expected, F.lit(False))


def spend(usages: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """(arm, requests, prompt_tokens, completion_tokens, usd) of each arm and of all, whose arm is null."""
    out = usages.rollup("arm").agg(F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return out.withColumn("usd", F.col("prompt_tokens") / 1e6 * prompt_price + F.col("completion_tokens") / 1e6 * completion_price)


def cached_spend(usages: DataFrame, hit_price: float, miss_price: float, completion_price: float) -> DataFrame:
    """(arm, requests, hit_tokens, miss_tokens, completion_tokens, usd) of each arm and of all, whose arm is null, where a provider's cache has a price of its own.

    usages: (arm, prompt_tokens, hit_tokens, completion_tokens). What is known to have come from the cache is priced so, at most
    the whole prompt; a missing count is none.
    """
    zero, prompt = F.lit(0).cast("bigint"), F.coalesce("prompt_tokens", F.lit(0)).cast("bigint")
    hit = F.least(F.greatest(F.coalesce("hit_tokens", zero), zero).cast("bigint"), prompt)
    rows = usages.select("arm", hit.alias("hit_tokens"), (prompt - hit).alias("miss_tokens"), F.coalesce("completion_tokens", zero).cast("bigint").alias("completion_tokens"))
    out = rows.rollup("arm").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in ("hit_tokens", "miss_tokens", "completion_tokens")))
    return out.withColumn("usd", (F.col("hit_tokens") * hit_price + F.col("miss_tokens") * miss_price + F.col("completion_tokens") * completion_price) / 1e6)


#: Keys whose values are secret, wherever the words stand in them.
_SECRET = re.compile(r"authorization|cookie|api[-_]?key|token|secret|password", re.I)
_PART = re.compile(r'"((?:\\.|[^"\\])*)"(\s*:\s*)?|[{}\[\]]|[^"{}\[\]]+|"', re.S)
_SCALAR = re.compile(r"[^\s,}\]]*")
REDACTED = '"[redacted]"'


def _unescaped(key: str) -> str:
    try:
        return json.loads(f'"{key}"', strict=False)
    except ValueError:
        return key


def redact(body: str) -> str:
    """JSON text with the values of secret keys replaced, whole objects and arrays too, at any depth; all else stays as it is written."""
    out, pos = [], 0
    while pos < len(body):
        m = _PART.match(body, pos)
        out.append(m[0])
        pos = m.end()
        if m[2] is None or not _SECRET.search(_unescaped(m[1])):
            continue
        out.append(REDACTED)
        depth, begun = 0, False
        while pos < len(body) and (depth or not begun):
            if not depth and body[pos] not in '"{[':
                pos = _SCALAR.match(body, pos).end()
                break
            m = _PART.match(body, pos)
            if m[0] == '"':  # a string without its end
                return "".join(out)
            depth += (m[0] in ("{", "[")) - (m[0] in ("}", "]"))
            # A string right after the key is the value; what follows it is not.
            pos, begun = (m.end(1) + 1 if m[1] is not None and not depth else m.end()), True
    return "".join(out)


@F.pandas_udf(StringType())
def redacted(body: pd.Series) -> pd.Series:
    """redact() of each text; null stays null. Arbitrary depth has no form in column functions."""
    return body.map(redact, na_action="ignore")
