"""Correlation of requests, responses, decisions and outcomes."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical, ref


def request_response(requests: DataFrame, responses: DataFrame, keys: list[str], request_order: str, response_order: str) -> DataFrame:
    """The nth request with the nth response of the same keys; what is left over on either side keeps a null."""
    nth = lambda df, order: df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    both = nth(requests, request_order).alias("q").join(nth(responses, response_order).alias("r"), [*keys, "occurrence"], "full")
    has_q, has_r = F.col(f"q.{request_order}").isNotNull(), F.col(f"r.{response_order}").isNotNull()
    return both.withColumn("status", F.when(has_q & has_r, "answered").when(has_q, "unanswered").otherwise("orphan_response"))


def outcome(denied: Column, known: Column, is_error: Column) -> Column:
    return F.when(denied, "denied").when(~known, "unknown").when(is_error, "error").otherwise("success")


def reconcile(decisions: DataFrame, outcomes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each decision's latest row against its latest outcome: settled, missing_outcome, or unexpected_outcome."""
    last = lambda df, name: df.groupBy(*key).agg(F.max_by("status", order).alias(name))
    both = last(decisions, "decision").join(last(outcomes, "outcome"), key, "full")
    return both.withColumn("state", F.when(F.col("outcome").isNull(), "missing_outcome").when(F.col("decision").isNull(), "unexpected_outcome").otherwise("settled"))


def pre_post(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each call's first pre event with the next post event of the same keys."""
    w = Window.partitionBy(*keys).orderBy("seq")
    later = F.min(F.when(F.col("phase") == "post", F.struct("seq", "ts"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return events.where("phase is not null").withColumn("post", later).where("phase = 'pre'").select(*keys, "seq", F.col("post.seq").alias("post_seq"), F.timestamp_diff("SECOND", F.col("ts"), F.col("post.ts")).alias("seconds"))


def in_flight(requests: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Requests that began while an earlier one with the same keys was open."""
    open_until = F.max(end).over(Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
    return requests.where(F.col(start).isNotNull()).withColumn("open_until", open_until).where(F.col(start) < F.col("open_until")).drop("open_until")


def first_claim(events: DataFrame, by: str = "session_id") -> DataFrame:
    """The first event of each session wins its start."""
    return events.groupBy(by).agg(F.min_by(F.struct("seq", "event_id", "ts"), "seq").alias("f")).select(by, "f.*")


def origins(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each call's catalog entry: by server key, else by the only entry that declares the tool."""
    keyed = catalog.select("server", F.col("host").alias("by_key")).dropDuplicates(["server"])
    single = catalog.groupBy("tool").agg(F.count_distinct("server").alias("n"), F.min("host").alias("by_tool")).where("n = 1").drop("n")
    return calls.join(keyed, "server", "left").join(single, "tool", "left").withColumn("host", F.coalesce("by_key", "by_tool")).drop("by_key", "by_tool")


def reconciliation(events: DataFrame) -> DataFrame:
    """(list, event_id, action_id, attempt_id): what recorded decisions leave open.

    events: event_id, seq, kind, phase, decision, outcome, action_id, attempt_id, record_event_id, gateway_decision. The last event
    of an attempt in a phase speaks for it. Lists: missing_outcome (allowed, no outcome), unknown_outcome, missing_companion (an
    outcome's record isn't there), gap, legacy (decisions without an action_id).
    """
    key = ["action_id", "attempt_id"]
    cycle = events.where("kind = 'action_lifecycle'")
    last = lambda df: df.groupBy(*key).agg(F.max_by(F.struct("event_id", "outcome", "record_event_id"), "seq").alias("e")).select(*key, "e.*")
    allowed, outcomes = last(cycle.where("phase = 'decision' and decision = 'allow'")), last(cycle.where("phase = 'outcome'"))
    same = F.col("a.action_id").eqNullSafe(F.col("b.action_id")) & F.col("a.attempt_id").eqNullSafe(F.col("b.attempt_id"))
    named = lambda df, name: df.select(F.lit(name).alias("list"), "event_id", *key)
    missing = allowed.alias("a").join(outcomes.alias("b"), same, "left_anti").select("a.*")
    alone = outcomes.where("record_event_id is not null").join(events.select(F.col("event_id").alias("record_event_id")).distinct(), "record_event_id", "left_anti")
    legacy = events.where("(kind = 'policy_decision' or (kind = 'tool_call' and gateway_decision is not null)) and action_id is null")
    parts = [named(missing, "missing_outcome"), named(outcomes.where("outcome = 'unknown'"), "unknown_outcome"), named(alone, "missing_companion"), named(events.where("kind = 'coverage_gap'"), "gap"), named(legacy, "legacy")]
    return reduce(DataFrame.unionByName, parts)


def with_pending(stored: DataFrame, pending: DataFrame) -> DataFrame:
    """Stored events, and pending ones that are not stored yet, each id once."""
    new = pending.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def decisions_of_calls(calls: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each call with the decision that its decision_id names."""
    return calls.join(decisions.select(F.col("event_id").alias("decision_id"), F.col("decision").alias("decided"), "rule_id"), "decision_id", "left")


def stale(markers: DataFrame, settled: DataFrame, now: Column, seconds: int = 24 * 3600) -> DataFrame:
    """Markers (session_id, request_id, started_at) that nothing settled and that are older than so many seconds."""
    open_ = markers.join(settled.select("session_id", "request_id").distinct(), ["session_id", "request_id"], "left_anti")
    return open_.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")) > seconds * 1_000_000)


#: Fixed value: how many requests may wait for their response at once.
MAX_PENDING = 10_000


def _evicted(limit: int):
    """Opened and answered requests in order, group by group: the oldest that isn't protected goes when one too many waits, or else the oldest."""

    def run(batches):
        group, free, kept = object(), {}, {}  # requests that wait, in the order in which they came
        for batch in batches:
            out = []
            for g, at, request, opens, protected in zip(*(batch[c].to_pylist() for c in ("g", "at", "request", "opens", "protected"))):
                if g != group:
                    group, free, kept = g, {}, {}
                if opens:
                    if len(free) + len(kept) >= limit:
                        waiting = free or kept
                        oldest = next(iter(waiting))
                        del waiting[oldest]
                        out.append((g, oldest, at))
                    (kept if protected else free)[request] = True
                else:
                    free.pop(request, None)
                    kept.pop(request, None)
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("g").type, pa.int64(), pa.int64()))], ["g", "request", "evicted_at"])

    return run


def evictions(requests: DataFrame, by: str, asked: str, answered: str, limit: int = MAX_PENDING, protected: str | None = None) -> DataFrame:
    """(by, asked, evicted_at): requests that were given up because more than ``limit`` would wait in their group at once.

    ``asked`` and ``answered`` are places in the group's log (numbers, each used once; answered is null without a response). A request
    that is one too many makes the oldest waiting one go, one with a true ``protected`` only where all are. Whether a group ever
    has so many is told by a running count of requests less responses; only such groups are gone through in order, with at most
    ``limit`` requests in memory.
    """
    flag = F.coalesce(F.col(protected), F.lit(False)) if protected else F.lit(False)
    rows = requests.where(F.col(asked).isNotNull()).select(F.col(by).alias("g"), F.col(asked).cast("long").alias("request"), F.col(answered).cast("long").alias("end"), flag.alias("protected"))
    moves = rows.select("g", "request", "protected", F.explode(F.array(F.struct(F.col("request").alias("at"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("at"), F.lit(False).alias("opens")))).alias("m")).select("g", "request", "protected", "m.*").where("at is not null")
    waiting = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(Window.partitionBy("g").orderBy("at"))
    crowded = moves.select("g", waiting.alias("waiting")).groupBy("g").agg(F.max("waiting").alias("most")).where(F.col("most") > limit).select(F.col("g").alias("crowded"))
    some = moves.join(crowded, F.col("g").eqNullSafe(F.col("crowded")), "left_semi")
    kind = f"g {requests.schema[by].dataType.simpleString()}, request long, evicted_at long"
    out = some.repartition("g").sortWithinPartitions("g", "at").mapInArrow(_evicted(limit), kind)
    return out.select(F.col("g").alias(by), F.col("request").alias(asked), "evicted_at")


def sealed_calls(requests: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each request with its response: kind, duration, error and the reference of the result.

    requests: keys, asked_at, method; responses: keys, answered_at, result (JSON), is_error. tools/call gives tool_call, initialize itself,
    any other method rpc. A request without a response is an error with the reference of null; a response without a request a
    protocol_error.
    """
    both = request_response(requests, responses, keys, "asked_at", "answered_at")
    orphan, answered = F.col("status") == "orphan_response", F.col("status") == "answered"
    kind = F.when(orphan, "protocol_error").when(F.col("method") == "tools/call", "tool_call").when(F.col("method") == "initialize", "initialize").otherwise("rpc")
    took = (F.unix_micros(F.col("answered_at").cast("timestamp")) - F.unix_micros(F.col("asked_at").cast("timestamp"))) / 1000
    error = F.when(orphan, F.lit(True)).when(answered, F.coalesce("is_error", F.lit(False))).otherwise(F.lit(True))
    return both.select(*keys, "occurrence", kind.alias("kind"), F.when(answered, took).alias("duration_ms"), error.alias("is_error"), F.when(~answered, F.col("status")).alias("error_type"), ref(F.coalesce(F.when(~orphan, canonical(F.col("result"))), F.lit("null"))).alias("result_hash"))
