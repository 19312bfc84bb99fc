"""Log tables made of the given event, page and order tables; the SQL beside each gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: how many chains the events are dealt to.
CHAINS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df for work that is heavy for each row: over as many tasks as a shuffle has, where its files give fewer (a row group is one task).

    The keys tell rows apart. Rows are dealt by them, not in turn: for that Spark sorts all that a task has read, a whole row group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() > n else df.repartition(n, *keys)


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged event per row of events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type").isin("view", "error"), "tool_call").when((F.col("event_type") == "click") & (k % 6 == 0), "notification").when(F.col("event_type") == "click", "rpc").when(F.col("event_type") == "signup", "session_start").otherwise("policy_decision")
    e = e.select("event_id", "ts", "user_id", F.col("value").alias("duration_ms"), k.alias("k"), kind.alias("kind"), (F.col("event_type") == "error").alias("is_error"), F.col("props").alias("args"))
    decided = F.col("kind") == "policy_decision"
    return e.select(
        "event_id", "ts", "user_id", "k", "kind", "is_error", "duration_ms", "args",
        (F.col("event_id") + 1).alias("seq"),
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(CHAINS)).cast("string")).alias("chain_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.concat(F.lit("server_"), F.pmod("user_id", F.lit(5)).cast("string")).alias("server"),
        F.concat(F.lit("tool_"), F.pmod("k", F.lit(10)).cast("string")).alias("tool"),
        F.when(F.col("kind") == "tool_call", F.when(F.col("k") % 5 == 0, "post").when(F.col("k") % 5 == 1, "pre")).alias("phase"),
        F.when(decided, F.when(F.col("k") % 2 == 1, "deny").otherwise("hold")).alias("decision"),
        F.when(decided, F.concat(F.lit("rule_"), (F.col("k") % 4).cast("string"))).alias("rule_id"),
        F.when(F.col("kind") == "session_start", F.concat(F.lit("policy_"), (F.col("k") % 3).cast("string"))).alias("policy"),
        F.concat(F.lit("who_"), F.pmod("user_id", F.lit(3)).cast("string")).alias("identity"),
        F.when(F.col("kind").isin("tool_call", "notification"), F.when(F.col("k") % 4 == 2, "deny").when(F.col("k") % 4 == 3, "hold")).alias("gateway_decision"),
        F.when((F.col("kind") == "tool_call") & (F.col("k") % 3 == 1), "policy_denied").alias("error_type"),
        F.when((F.col("kind") == "tool_call") & (F.col("k") % 7 < 3), F.element_at(F.lit(["none", "redact", "flag"]), F.col("k") % 7 + 1)).alias("boundary_action"),
        (F.col("k") % 2).alias("secrets_found"), F.when(F.col("k") % 5 == 0, 1).otherwise(0).alias("injection_found"),
    )


AUDIT = f"""e AS (SELECT *, CASE WHEN kind = 'tool_call' THEN CASE WHEN k % 5 = 0 THEN 'post' WHEN k % 5 = 1 THEN 'pre' END END AS phase,
    CASE WHEN kind = 'policy_decision' THEN CASE WHEN k % 2 = 1 THEN 'deny' ELSE 'hold' END END AS decision,
    CASE WHEN kind = 'policy_decision' THEN 'rule_' || (k % 4) END AS rule_id, CASE WHEN kind = 'session_start' THEN 'policy_' || (k % 3) END AS policy, 'tool_' || (k % 10) AS tool, 'who_' || (user_id % 3) AS identity,
    CASE WHEN kind IN ('tool_call', 'notification') THEN CASE WHEN k % 4 = 2 THEN 'deny' WHEN k % 4 = 3 THEN 'hold' END END AS gateway_decision, CASE WHEN kind = 'tool_call' AND k % 3 = 1 THEN 'policy_denied' END AS error_type,
    CASE WHEN kind = 'tool_call' AND k % 7 < 3 THEN ['none', 'redact', 'flag'][k % 7 + 1] END AS boundary_action, k % 2 AS secrets_found, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS injection_found
    FROM (SELECT event_id, ts, user_id, value AS duration_ms, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type = 'error' AS is_error, props AS args, event_id + 1 AS seq,
    CASE WHEN event_type IN ('view', 'error') THEN 'tool_call' WHEN event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS INT) % 6 = 0 THEN 'notification' WHEN event_type = 'click' THEN 'rpc' WHEN event_type = 'signup' THEN 'session_start' ELSE 'policy_decision' END AS kind,
    'c' || (user_id % {CHAINS}) AS chain_id, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, 'server_' || (user_id % 5) AS server FROM events))"""


def chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain_id, seq, event): each chain's events numbered from 1, as canonical JSON."""
    e = audit_events(spark, sf_dir)
    seq = F.row_number().over(Window.partitionBy("chain_id").orderBy("event_id")).cast("long")
    event = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), "kind", F.lit('","session_id":"'), "session_id", F.lit('","tool":"'), "tool", F.lit('"}'))
    return e.select("chain_id", seq.alias("seq"), "event_id", "session_id", "kind", event.alias("event"))


CHAIN = AUDIT + """, ch AS (SELECT chain_id, row_number() OVER (PARTITION BY chain_id ORDER BY event_id) AS seq, event_id, session_id, kind,
    '{"event_id":' || event_id || ',"kind":"' || kind || '","session_id":"' || session_id || '","tool":"' || tool || '"}' AS event FROM e)"""
