"""Wire lines, and the recovery of what runs that died left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import ref


def _kind(json: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(json))


def classify_lines(lines: DataFrame, line: str = "line", most_bytes: int = 1 << 20) -> DataFrame:
    """One row for each message of each line: item (place in a batch, else 0), message, class, request_id, method.

    Classes: oversized, unparseable, request, notification, response, other. Ids are texts or numbers; a message with a
    method and another id is a notification. An empty batch has no row; null lines are unparseable.
    """
    text = F.col(line)
    over = F.coalesce(F.octet_length(text) > most_bytes, F.lit(False))
    batch = F.coalesce(~over & _kind(text).startswith("ARRAY"), F.lit(False))
    items = F.when(batch, F.from_json(text, "array<string>")).otherwise(F.array(text))
    rows = lines.withColumn("over", over).select("*", F.posexplode(items).alias("item", "message"))
    value = F.try_parse_json("message")
    at = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    has_id = F.coalesce(at("$.id").rlike("^(STRING|BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), F.lit(False))
    has_method = F.coalesce(at("$.method") == "STRING", F.lit(False))
    named = F.when(F.col("over"), "oversized").when(value.isNull(), "unparseable").when(~_kind(F.col("message")).startswith("OBJECT"), "other")
    named = named.when(has_method & has_id, "request").when(has_method, "notification").when(has_id, "response").otherwise("other")
    seen = ~F.col("over")
    fields = F.when(seen & has_id, F.get_json_object("message", "$.id")).alias("request_id"), F.when(seen & has_method, F.get_json_object("message", "$.method")).alias("method")
    return rows.select("*", named.alias("class"), *fields).drop("over")


def recovered_outcomes(events: DataFrame, dead_runs: DataFrame, ended_sessions: DataFrame) -> DataFrame:
    """Outcomes for attempts without one, of dead runs or of ended sessions that hooks recorded.

    events: action_id, attempt_id, phase, seq, event_id, decision, run_id, session_id, source. The last event of an
    attempt speaks for it. Ids derive from that event's, so a second recovery gives the same rows.
    """
    key = ["action_id", "attempt_id"]
    # one pass over the attempts' keys: the outcome flag and the last other event come from the same aggregation
    other = F.col("phase") != "outcome"
    last = F.max_by(F.when(other, F.struct("event_id", "decision", "run_id", "session_id", "source")), F.when(other, F.col("seq")))
    opened = events.groupBy(*key).agg(F.max(~other).alias("closed"), last.alias("e")).where("not closed and e is not null").select(*key, "e.*")
    dead = dead_runs.select("run_id", F.lit(True).alias("dead")).distinct()
    ended = ended_sessions.select("session_id", F.lit(True).alias("ended")).distinct()
    lost = opened.join(dead, "run_id", "left").join(ended, "session_id", "left").where("dead or (source = 'hook' and ended)")
    return lost.select(*key, "session_id", "run_id", ref(F.concat("event_id", F.lit(":recovered-outcome"))).alias("event_id"), F.when(F.col("decision") == "deny", "denied").otherwise("unknown").alias("outcome"), F.lit("recorder_exit").alias("reason"))


#: Dead runs up to which they are sent to every task.
_MOST_BROADCAST = 200_000


def recovery_gaps(events: DataFrame, dead_runs: DataFrame) -> DataFrame:
    """One gap row for each dead run (run_id, started_at) that has none yet, in the session of its first event (null if it has no event).

    Only events of dead runs, and ids that a gap would have, leave the events' own tasks.
    """
    gaps = dead_runs.select("run_id", "started_at").withColumn("event_id", ref(F.concat("run_id", F.lit(":coverage-gap"))))
    few = gaps.count() <= _MOST_BROADCAST
    of = lambda key: (F.broadcast if few else lambda df: df)(gaps.select(key).distinct())
    first = events.join(of("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.min_by("session_id", "seq").alias("session_id"))
    noted = events.select("event_id").join(of("event_id"), "event_id", "left_semi").distinct()
    found = gaps.join(first, "run_id", "left").join(noted, "event_id", "left_anti")
    return found.select("event_id", "run_id", "session_id", F.col("started_at").alias("ts"), F.lit("recorder_exit").alias("reason"), F.lit(0).cast("long").alias("dropped_at_least"))
