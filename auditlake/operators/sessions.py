"""Session analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _is_call() -> Column:
    return (F.col("kind") == "tool_call") & (F.col("phase").isNull() | (F.col("phase") == "pre"))


def is_hook_deny() -> Column:
    """A call that a hook refused."""
    return F.coalesce((F.col("kind") == "tool_call") & (F.col("phase") == "pre") & (F.col("error_type") == "policy_denied"), F.lit(False))


def session_summary(events: DataFrame) -> DataFrame:
    """One row per session, in one aggregation. Decisions: recorded ones, notifications that the gateway decided, and hook denials."""
    n = lambda c: F.count_if(c)
    decided = (F.col("kind") == "policy_decision") | ((F.col("kind") == "notification") & F.col("gateway_decision").isNotNull()) | is_hook_deny()
    return events.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.max(F.when(F.col("kind") == "session_end", F.col("ts"))).alias("ended_at"), F.max("ts").alias("last_event_at"),
        F.count("*").alias("events"), n(_is_call()).alias("tool_calls"), n(F.col("kind").isin("tool_call", "rpc") & F.col("is_error")).alias("errors"),
        F.count_distinct(F.when(F.col("kind") == "tool_call", F.col("server"))).alias("servers"), n(decided).alias("decisions"),
        F.min_by("server", "seq").alias("first_server"), F.min_by("identity", "seq").alias("identity"), F.min("seq").alias("first_seq"),
    )


def end_state(ended: Column, last: Column) -> Column:
    return F.when(ended.isNull(), "(open)").when(last > ended, "(reopened)").otherwise(F.lit("ended"))


def tool_census(events: DataFrame) -> DataFrame:
    """Calls, errors, denials, holds and sessions of each tool, over tool calls alone."""
    denied = F.coalesce(F.col("gateway_decision") == "deny", F.lit(False)) | is_hook_deny()
    return events.where("kind = 'tool_call'").groupBy(F.coalesce("server", F.lit("")).alias("server"), "tool").agg(
        F.count_if(_is_call()).alias("calls"), F.count_if(F.col("is_error")).alias("errors"), F.count_if(denied).alias("denied"),
        F.count_if(F.col("gateway_decision") == "hold").alias("held"), F.count_distinct(F.when(_is_call(), F.col("session_id"))).alias("sessions"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def why(events: DataFrame, last: int | None = None, per_session: bool = False) -> DataFrame:
    """Decisions, and results that the filter acted on, as one list, newest first; the last n of all or of each session."""
    decisions = events.where(F.col("decision").isNotNull()).select("session_id", "seq", "tool", F.col("decision").alias("what"), "rule_id")
    acted = (F.col("kind") == "tool_call") & (F.col("boundary_action") != "none") & ((F.col("secrets_found") > 0) | (F.col("injection_found") > 0))
    filtered = events.where(acted).select("session_id", "seq", "tool", F.concat(F.lit("filter:"), "boundary_action").alias("what"))
    both = decisions.unionByName(filtered, allowMissingColumns=True)
    if last is None:
        return both
    if per_session:
        return both.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).where(F.col("n") <= last)
    return both.orderBy(F.desc("seq")).limit(last)


def redelivery(events: DataFrame, *by: str) -> DataFrame:
    """Events enqueued, written and dropped, as session ends report them."""
    return events.where("kind = 'session_end'").groupBy(*by).agg(F.sum(F.col("events_recorded") + F.col("events_dropped")).alias("enqueued"), F.sum("events_recorded").alias("written"), F.sum("events_dropped").alias("dropped"))


def with_reasons(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule's reason where the decision was taken under that very policy."""
    return decisions.join(rules.select("policy_hash", "rule_id", "reason"), ["policy_hash", "rule_id"], "left")


def as_of(events: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """The last known value up to each event."""
    return events.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def resolve_prefix(sessions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, status, session_id): exact, unique, ambiguous or none."""
    ids = sessions.select("session_id").distinct()
    wanted = prefixes.select("prefix").distinct()
    lengths = wanted.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))  # one row
    cut = ids.crossJoin(F.broadcast(lengths)).select("session_id", F.explode(F.filter("lengths", lambda n: n.between(1, F.length("session_id")))).alias("n"))
    met = cut.select("session_id", F.substring("session_id", F.lit(1), F.col("n")).alias("prefix")).join(wanted, "prefix")
    found = met.groupBy("prefix").agg(F.count("*").alias("n"), F.min("session_id").alias("one"), F.max(F.col("session_id") == F.col("prefix")).alias("exact"))
    status = F.when(F.col("exact"), "exact").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return wanted.join(found, "prefix", "left").select("prefix", status.alias("status"), F.when(F.col("exact"), F.col("prefix")).when(F.col("n") == 1, F.col("one")).alias("session_id"))


def timeline(rows: DataFrame, session: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each session, numbered, with a flag for sessions that go on."""
    w = Window.partitionBy(session).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy(session)) > most).where(F.col("n") <= most)


def pending_holds(holds: DataFrame, now: Column) -> DataFrame:
    """Holds with expiry applied; a pending one past its deadline reads as timeout."""
    state = F.when((F.col("status") == "pending") & (F.col("timeout_at") <= now), "timeout").otherwise(F.col("status"))
    return holds.withColumn("state", state)


def latency_quantiles(calls: DataFrame, by: list[str], exact: bool = True) -> DataFrame:
    """p50, p95 and p99 of durations; exact=False keeps a bounded sketch a group."""
    q = F.expr(f"{'percentile' if exact else 'percentile_approx'}(duration_ms, array(0.5, 0.95, 0.99))")
    return calls.groupBy(*by).agg(q.alias("q"), F.count("duration_ms").alias("calls")).select(*by, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "calls")


def activity_rollup(events: DataFrame, *by: str) -> DataFrame:
    """Events, decisions and sessions at each level of a hierarchy."""
    return events.rollup(*by).agg(F.count("*").alias("events"), F.count("decision").alias("decisions"), F.count_distinct("session_id").alias("sessions"))


def integrity_rollup(events: DataFrame, verdicts: DataFrame, tenant: str) -> DataFrame:
    """Activity and integrity by tenant and chain, with totals by tenant and of all: a total is ok if all its chains are.

    verdicts: chain_id, ok, problems. A chain without a verdict counts as unverified; one without decisions is told as such.
    """
    per = events.groupBy(tenant, "chain_id").agg(F.count("*").alias("events"), F.count("decision").alias("decisions"), F.count_distinct("session_id").alias("sessions"))
    known = per.join(verdicts.select("chain_id", "ok", "problems"), "chain_id", "left")
    total = known.rollup(tenant, "chain_id").agg(
        F.sum("events").alias("events"), F.sum("decisions").alias("decisions"), F.sum("sessions").alias("sessions"), F.sum(F.coalesce("problems", F.lit(0))).alias("problems"),
        F.min(F.coalesce("ok", F.lit(False))).alias("ok"), F.count_if(F.col("ok").isNull()).alias("unverified"),
    )
    return total.withColumn("no_decisions", F.col("decisions") == 0)
