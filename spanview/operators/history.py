"""Transcripts: which reads are still served, and messages rewritten accordingly.

Messages are rows (session, seq, role, text, unit_id?, call_id?); calls are rows (session,
seq, call_id, tool, arguments, unit_id?, path?). A session's units, calls and messages meet
in equality joins; pairing and collapsing are aggregates over a session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import engine
from ..engine import ENVELOPE_TAG, UNIT_TAG

#: Dispositions by precedence, where a path or call has several.
PRECEDENCE = ("selected", "budget", "unresolved")


def read_marker(unit_id: Column, path: Column) -> Column:
    return F.concat(F.lit("[span:"), unit_id, F.lit(" path="), path, F.lit("] Its text as it is now stands in the context below."))


def rewritten(messages: DataFrame, units: DataFrame) -> DataFrame:
    """messages where the text of each read of a known unit is its marker.

    Only messages that name a unit are moved, once, and not sorted: what they meet is small.
    """
    known = units.select("session", "unit_id", F.col("path").alias("_path")).hint("shuffle_hash")
    named = F.col("session").isNotNull() & F.col("unit_id").isNotNull()
    out = messages.filter(named).join(known, ["session", "unit_id"], "left")
    out = out.withColumn("text", F.when(F.col("_path").isNotNull(), read_marker(F.col("unit_id"), F.col("_path"))).otherwise(F.col("text"))).drop("_path")
    return out.unionByName(messages.filter(~named))


def flattened(parts: Column, separator: str = "\n") -> Column:
    """Text parts of a content array<struct<type, text>>, joined."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), separator)


def text_only(parts: Column) -> Column:
    """Joined text of a content array, null if any part is something else."""
    return F.when(F.forall(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), flattened(parts))


def tool_calls(messages: DataFrame) -> DataFrame:
    """Calls of assistant messages: from tool_calls (array<struct<id, name, arguments>>) if there are any, else from content parts of type toolCall."""
    native = F.transform(F.filter("parts", lambda p: p["type"] == "toolCall"), lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["arguments"].alias("arguments")))
    calls = F.when(F.size("tool_calls") > 0, F.col("tool_calls")).otherwise(native)
    rows = messages.filter("role = 'assistant'").select("session", "seq", F.posexplode(calls).alias("place", "call"))
    return rows.select("session", "seq", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"), F.col("call.arguments").alias("arguments"))


def served_calls(calls: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Calls whose unit (session, unit_id, disposition) is shown, or known to be unresolved."""
    return calls.join(dispositions.filter("disposition in ('selected', 'unresolved')"), ["session", "unit_id"], "left_semi")


def unserved_calls(calls: DataFrame, observed: DataFrame, served: DataFrame) -> DataFrame:
    """Distinct (session, call_id) of reads that were observed and are not served."""
    keys = ["session", "call_id"]
    return calls.select(*keys).distinct().join(observed.select(*keys), keys, "left_semi").join(served.select(*keys), keys, "left_anti")


def call_dispositions(calls: DataFrame, dispositions: DataFrame) -> DataFrame:
    """(session, call_id, path, disposition): the first in PRECEDENCE that holds for the call's unit."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("disposition"))
    joined = calls.join(dispositions, ["session", "unit_id"]).filter(rank > 0)
    return joined.groupBy("session", "call_id").agg(F.min_by(F.struct("path", "disposition"), rank).alias("d")).select("session", "call_id", "d.path", "d.disposition")


def path_dispositions(units: DataFrame) -> DataFrame:
    """(session, path, disposition): selected if any unit of the path is, else unresolved if any is, else budget."""
    order = F.array_position(F.array(*map(F.lit, ("selected", "unresolved", "budget"))), F.col("disposition"))
    return units.groupBy("session", "path").agg(F.min_by("disposition", order).alias("disposition"))


def omitted_marker(path: Column, disposition: Column) -> Column:
    reason = F.when(disposition == "budget", "Its text did not fit into the budget of this context.").otherwise("Its text is not part of this context.")
    return F.concat(F.lit("[span:omitted-read path="), path, F.lit("] "), reason)


def dump_marker(paths: Column, dispositions: Column, untracked: Column) -> Column:
    """Marker in place of a shell dump of tracked paths; dispositions is aligned with paths, null where there is none."""
    kind = F.get(dispositions, F.lit(0))
    one = (
        F.when(kind == "selected", "Its text as it is now stands in the context below.")
        .when(kind == "budget", "Its text did not fit into the budget of this context.")
        .when(kind == "unresolved", "Its text is not shown, as the unit has not been found again.")
        .otherwise("Its text is not part of this context.")
    )
    each = F.array_join(F.zip_with(paths, dispositions, lambda p, d: F.concat(p, F.lit("="), F.coalesce(d, F.lit("absent")))), "; ")
    many = F.concat(F.lit("[span:stale-dump paths="), F.array_join(paths, ", "), F.lit("] What the context has of each path: "), each, F.lit("."))
    body = F.when(F.size(paths) == 1, F.concat(F.lit("[span:stale-dump path="), F.get(paths, F.lit(0)), F.lit("] "), one)).otherwise(many)
    rest = F.concat(F.lit(" Paths named there that nobody tracks: "), F.array_join(untracked, ", "), F.lit("."))
    return F.concat(body, F.when(F.size(untracked) > 0, rest).otherwise(""))


def served_marker(units: Column, current: bool) -> Column:
    tail = "All tracked text was shown before and no file has changed since." if current else "An older context stood here; the newest one follows below."
    return F.concat(F.lit("[span:already-served units="), units.cast("string"), F.lit(f"] {tail}"))


def is_projection(text: Column, tag: str = ENVELOPE_TAG) -> Column:
    """Whether a message's whole text is a projection; exact, as its frames' lengths must add up too: see collapsed_history."""
    trimmed = F.trim(text)
    return F.startswith(trimmed, F.lit(f"<{tag} ")) & F.endswith(trimmed, F.lit(f"</{tag}>"))


def collapsed_history(messages: DataFrame, tag: str = ENVELOPE_TAG, unit_tag: str = UNIT_TAG) -> DataFrame:
    """messages where user messages that are whole projections became counted markers."""
    @F.pandas_udf("int")
    def units_in(text: pd.Series) -> pd.Series:
        def count(t: str | None) -> int | None:
            if t is None:
                return None
            try:
                return len(engine.decode(t, unit_tag))
            except engine.FrameError:
                return None

        return text.map(count).astype("Int64").astype("Int32")

    whole = (F.col("role") == "user") & is_projection(F.col("text"), tag)
    out = messages.withColumn("_n", units_in(F.when(whole, F.col("text"))))
    return out.withColumn("text", F.when(F.col("_n").isNotNull(), served_marker(F.col("_n"), False)).otherwise(F.col("text"))).drop("_n")


def collapse_decisions(messages: DataFrame, chosen: DataFrame, injected: DataFrame, tag: str = ENVELOPE_TAG) -> DataFrame:
    """(session, collapse): whether this turn's projection may be empty, as all it would show was shown at the same revision.

    Not with a projection left in the history, a single user message, nothing selected, or a
    symbol that a parser resolved for this request.
    """
    seen = messages.groupBy("session").agg(F.count_if(F.col("role") == "user").alias("users"), F.max(is_projection(F.coalesce("text", F.lit("")), tag)).alias("historical"))
    shown = chosen.filter("disposition = 'selected'").join(injected.select("session", "unit_id", F.col("revision").alias("_was")), ["session", "unit_id"], "left")
    units = shown.groupBy("session").agg(
        F.count("*").alias("selected"), F.count_if(F.col("_was") == F.col("revision")).alias("same"),
        F.count_if((F.col("scope") == "symbol") & (F.col("method") == "isolated-semantic-engine")).alias("parsed"),
    )
    out = seen.join(units, "session", "left").fillna(0, ["selected", "same", "parsed"])
    ok = ~F.col("historical") & (F.col("users") > 1) & (F.col("selected") > 0) & (F.col("parsed") == 0) & (F.col("selected") == F.col("same"))
    return out.select("session", ok.alias("collapse"))


def pruned(messages: DataFrame, dropped: DataFrame, replaced: DataFrame) -> DataFrame:
    """messages (session, seq, role, text, tool_calls, call_id) without dropped pairs (session, call_id).

    Results of dropped calls go, calls go from their assistant messages, and an assistant
    message that neither calls nor says anything any more goes. Results in replaced (session,
    call_id, marker) get the marker as text; a replaced call is never dropped. A text is moved
    once, and not sorted: what it meets is small.
    """
    keys, names = ["session", "call_id"], messages.columns
    told = dropped.select(*keys, F.lit(None).cast("string").alias("marker"), F.lit(True).alias("_drop")).unionByName(replaced.select(*keys, "marker", F.lit(False).alias("_drop")))
    decided = told.groupBy(*keys).agg(F.min("marker").alias("_marker"), F.bool_and("_drop").alias("_drop"))
    had = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    # The dropped calls of one message, by a row for each call that it makes; a session's are never gathered.
    made = messages.filter(had).select("session", "seq", F.explode("tool_calls.id").alias("call_id"))
    of_message = made.join(decided.filter("_drop"), keys).groupBy("session", "seq").agg(F.collect_set("call_id").alias("_gone"))
    left = F.when(F.col("_gone").isNull(), F.col("tool_calls")).otherwise(F.filter("tool_calls", lambda c: ~F.array_contains("_gone", c["id"])))
    calling = messages.filter(had).join(of_message.hint("shuffle_hash"), ["session", "seq"], "left").withColumn("tool_calls", left).select(*names, F.lit(True).alias("_had"))
    rows = calling.unionByName(messages.filter(~had).select(*names, F.lit(False).alias("_had")))
    # Texts meet all that is decided of their call at once; those without a call stay where they are.
    named = F.col("session").isNotNull() & F.col("call_id").isNotNull()
    met = rows.filter(named).join(decided.hint("shuffle_hash"), keys, "left").filter(~(F.col("role").eqNullSafe("tool") & F.coalesce("_drop", F.lit(False))))
    out = met.withColumn("text", F.coalesce("_marker", "text")).select(*names, "_had").unionByName(rows.filter(~named))
    says = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return out.filter(~((F.col("role") == "assistant") & F.col("_had") & (F.size("tool_calls") == 0) & ~says)).drop("_had")


def inline_decisions(requests: DataFrame) -> DataFrame:
    """requests with first_new and quoteable.

    first_new: the second user message after a reply, something shown before, nothing skipped or
    omitted now. quoteable: the projection carries a unit with content.
    """
    quoteable = F.coalesce(F.contains("projection", F.lit(f"<{UNIT_TAG} ")) & ~F.startswith("projection", F.lit("[span:already-served units=")) & (F.col("unit_bytes") > 0), F.lit(False))
    first = (F.col("users") == 2) & F.col("replied") & (F.col("injected") > 0) & F.contains("projection", F.lit(f"<{UNIT_TAG}")) & (F.col("skipped") == 0) & (F.col("selected") > 0) & (F.col("omitted") == 0)
    return requests.withColumns({"first_new": F.coalesce(first, F.lit(False)), "quoteable": quoteable})


def inlined(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tool results (session, call_id, unit_id, path, observed, content, disposition, historical) with text: current content where it must be quoted, else a marker."""
    rows = results.join(decisions.select("session", "first_new", "quoteable", "users"), "session")
    full = F.length("content") > 0
    fresh = (F.col("disposition") == "selected") & full & F.when(F.col("first_new"), F.col("observed") != F.col("content")).otherwise(~F.col("quoteable"))
    late = (F.col("historical") == "budget") & (F.col("users") > 1) & full & ~F.col("quoteable")
    return rows.withColumn("text", F.when(F.coalesce(fresh | late, F.lit(False)), F.col("content")).otherwise(read_marker(F.col("unit_id"), F.col("path"))))


def scope_of(path: Column, start: Column, limit: Column, end: Column, symbol: Column, file_lines: Column) -> Column:
    """struct(scope, start_line, end_line) that a read call's arguments mean; a region up to the last line is the file."""
    last = F.coalesce(end, F.when(limit.isNotNull(), F.coalesce(start, F.lit(1)) + limit - 1))
    first = F.coalesce(start, F.lit(1))
    whole = (start.isNull() & last.isNull()) | ((first <= 1) & (last >= file_lines))
    scope = F.when(F.length(symbol) > 0, "symbol").when(whole, "file").otherwise("region")
    return F.struct(scope.alias("scope"), F.when(scope == "region", first).alias("start_line"), F.when(scope == "region", F.least(F.coalesce(last, file_lines), file_lines)).alias("end_line"))


def merged_tracked(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tracked calls (session, call_id, path, content, span, selector ...): incoming ones win, and keep what only the previous had."""
    keys = ["session", "call_id"]
    kept = ["start_line", "end_line", "file_lines", "selector", "tail_lines"]
    p = previous.select(*keys, *(F.col(c).alias(f"_{c}") for c in previous.columns if c not in keys))
    out = incoming.join(p, keys, "full_outer")
    new = F.col("path").isNotNull()
    cols = [F.coalesce(c, f"_{c}").alias(c) if c in kept else F.when(new, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in incoming.columns if c not in keys]
    return out.select(*keys, *cols)


def tail_failures(tracked: DataFrame) -> DataFrame:
    """tracked with failure: a tail read whose output wasn't the file's tail, or whose span moved with the file's line count."""
    shifted = (F.col("tail_lines") > 0) & (F.col("file_lines") != F.col("lines_now")) & (F.col("start_now") != F.col("start_line"))
    return tracked.withColumn("failure", F.when(F.col("invalid_tail"), "tail-lines-invalid-observation").when(shifted, "tail-lines-line-count-shift"))


def pairing_errors(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session, error) of sessions whose calls and results (session, seq, call_id) don't pair up, by precedence."""
    keys = ["session", "call_id"]
    c = calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.min("seq").alias("called"))
    r = results.groupBy(*keys).agg(F.count("*").alias("n_results"), F.min("seq").alias("answered"))
    both = c.join(r, keys, "full_outer").fillna(0, ["n_calls", "n_results"])
    error = (
        F.when(F.col("n_calls") > 1, "1:duplicate-call").when(F.col("n_calls") == 0, "2:result-without-call").when(F.col("n_results") > 1, "3:duplicate-result")
        .when(F.col("n_results") == 0, "4:call-without-result").when(F.col("answered") <= F.col("called"), "5:result-before-call")
    )
    return both.withColumn("error", error).groupBy("session").agg(F.min("error").alias("error")).withColumn("error", F.substring("error", 3, 100))


def order_changes(now: DataFrame, captured: DataFrame) -> DataFrame:
    """(session, error) of sessions whose calls or results (session, seq, kind, call_id) do not follow each other as they were captured."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("session", "kind").orderBy("seq", "call_id")
        return df.select("session", "kind", F.row_number().over(order).alias("place"), F.col("call_id").alias(name))

    both = placed(now, "now").join(placed(captured, "then"), ["session", "kind", "place"], "full_outer")
    changed = both.filter(~F.col("now").eqNullSafe(F.col("then")))
    return changed.groupBy("session").agg(F.concat(F.min("kind"), F.lit("-order-changed")).alias("error"))


def request_facts(messages: DataFrame) -> DataFrame:
    """(session, users, replied) of messages (session, seq, role, text): how many a user wrote, and whether an answer with text stands between the first two."""
    user = F.col("role") == "user"
    before = F.sum(user.cast("int")).over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumn("_users", before)
    says = (F.col("role") == "assistant") & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.col("_users") == 1)
    out = rows.groupBy("session").agg(F.count_if(user).alias("users"), F.count_if(says).alias("_answers"))
    return out.select("session", "users", ((F.col("users") > 1) & (F.col("_answers") > 0)).alias("replied"))


def promoted(pending: DataFrame, messages: DataFrame) -> DataFrame:
    """pending (session, projection, after_user) with outcome, by the messages (session, seq, role, text, calls) of the session's next request.

    A pending projection is committed where a user message is its very text, or where the user
    message after which it was sent has an answer with text or calls before the next user
    message; else it is discarded. A session without messages discards.
    """
    p = pending.select("session", "projection", "after_user")
    rows = p.join(messages.select("session", "seq", "role", "text", "calls"), "session", "left")
    user, later = F.col("role") == "user", F.col("seq") > F.col("after_user")
    answers = (F.col("role") == "assistant") & ((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) | (F.coalesce("calls", F.lit(0)) > 0))
    facts = rows.groupBy("session", "projection", "after_user").agg(
        F.coalesce(F.bool_or(user & (F.col("text") == F.col("projection")) & (F.length("projection") > 0)), F.lit(False)).alias("_applied"),
        F.coalesce(F.bool_or(user & (F.col("seq") == F.col("after_user"))), F.lit(False)).alias("_is_user"),
        F.min(F.when(user & later, F.col("seq"))).alias("_next"), F.min(F.when(answers & later, F.col("seq"))).alias("_answer"),
    )
    answered = F.col("_is_user") & F.col("_answer").isNotNull() & (F.col("_next").isNull() | (F.col("_answer") < F.col("_next")))
    return facts.select("session", "projection", "after_user", F.when(F.col("_applied") | answered, "committed").otherwise("discarded").alias("outcome"))


def acknowledged(deliveries: DataFrame) -> DataFrame:
    """Two-phase delivery: each pending (session, seq, unit_id, revision) with outcome committed or discarded, by the session's next event.

    deliveries: (session, seq, kind, unit_id, revision), kind one of pending, sent, completed,
    failed. The first event after a pending one that isn't pending itself settles it.
    """
    # Read backwards, the frame grows by a row at each step.
    order = Window.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("kind") != "pending", F.col("kind")), ignorenulls=True).over(order)
    rows = deliveries.withColumn("next", following).filter("kind = 'pending'")
    outcome = F.when(F.col("next").isin("sent", "completed"), "committed").when(F.col("next").isNotNull(), "discarded").otherwise("pending")
    return rows.select("session", "seq", "unit_id", "revision", outcome.alias("outcome"))


def observed_calls(calls: DataFrame, results: DataFrame, executed: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """Read calls that have a result: (session, call_id, tool, arguments, text). Arguments as executed win over those in the transcript."""
    keys = ["session", "call_id"]
    done = executed.select(*keys, F.col("arguments").alias("_executed"))
    rows = calls.filter(F.col("tool").isin(*tools)).join(results.select(*keys, "text"), keys).join(done, keys, "left")
    return rows.select(*keys, "tool", F.coalesce("_executed", "arguments").alias("arguments"), "text")


def seeded(reads: DataFrame, limit: int = 512 * 1024) -> DataFrame:
    """Reads whose text may seed a unit: within the limit in bytes, without NUL, of a path inside the workspace."""
    from ..sources.readers import unsafe_path

    return reads.filter((F.octet_length("content") <= limit) & ~F.contains("content", F.lit("\0")) & ~unsafe_path(F.col("path")))


def fail_open(messages: DataFrame, transform) -> DataFrame:
    """transform(pandas frame of a session's messages) per session; where it fails, or changes which messages there are, the session stays as it was.

    Gives (session, seq, text, applied, error). A session's messages are one request, so they fit in a task.
    """
    kind = dict(messages.dtypes)["session"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        try:
            out = transform(pdf.copy(deep=True))
            if list(out["seq"]) != list(pdf["seq"]):
                raise ValueError("messages were added, lost or moved")
            return pdf[["session", "seq"]].assign(text=out["text"].to_numpy(), applied=True, error=None)
        except Exception as e:  # noqa: BLE001  the request goes out as it came, whatever failed
            return pdf[["session", "seq", "text"]].assign(applied=False, error=f"{type(e).__name__}: {e}")

    return messages.select("session", "seq", "text").groupBy("session").applyInPandas(run, f"session {kind}, seq bigint, text string, applied boolean, error string")
