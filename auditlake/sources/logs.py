"""Readers for event logs, bundles, holds, tool catalogs and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import friendly_name

RECORD = "seq BIGINT, prev_hash STRING, hash STRING, event STRING"
HOLD = "approval_id STRING, created_at STRING, session_id STRING, server STRING, tool STRING, args_hash STRING, rule_id STRING, reason STRING, status STRING, timeout_at STRING, decided_at STRING, decided_by STRING"
STATUSES = ("pending", "approved", "denied", "timeout", "cancelled")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line; ``line`` orders the lines of a file: its block and the place in it. Large files are read by blocks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return rows.select("file", F.struct("block", "at").alias("line"), "value").where(F.trim("value") != "")


def parsed_records(lines: DataFrame) -> DataFrame:
    """lines with a column ``parsed`` (is the text JSON?) and the members of a record; other columns stay."""
    v = lines.withColumn("_v", F.try_parse_json("value"))
    get = lambda p, t: F.try_variant_get("_v", p, t)
    return v.select(*[c for c in lines.columns if c != "value"], F.col("_v").isNotNull().alias("parsed"), get("$.seq", "bigint").alias("seq"), get("$.prev_hash", "string").alias("prev_hash"), get("$.hash", "string").alias("hash"), F.to_json(get("$.event", "variant")).alias("event"))


def chain_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSONL logs with a status: ok, torn_tail (a bad last line) or corrupt (a bad line elsewhere)."""
    rows = parsed_records(lines(spark, path))
    last = rows.groupBy("file").agg(F.max("line").alias("last"))  # one row for each file
    state = F.when(F.col("parsed"), "ok").when(F.col("line") == F.col("last"), "torn_tail").otherwise("corrupt")
    return rows.join(last, "file").select("file", "line", state.alias("status"), "seq", "prev_hash", "hash", "event")


def tailed_chain_log(lines: DataFrame) -> DataFrame:
    """Records of a ``tail`` stream of JSONL logs with a status: ok or corrupt; a torn last line isn't in the stream yet."""
    rows = parsed_records(lines)
    return rows.select("file", "start", F.when(F.col("parsed"), "ok").otherwise("corrupt").alias("status"), "seq", "prev_hash", "hash", "event")


def chain_log_until_bad(spark: SparkSession, path: str) -> DataFrame:
    """The lenient scan: each file's records before its first bad line."""
    log = chain_log(spark, path)
    bad = log.where("status <> 'ok'").groupBy("file").agg(F.min("line").alias("bad"))
    return log.join(bad, "file", "left").where("bad is null or line < bad").drop("bad")


def heads(records: DataFrame, genesis: str, chains: DataFrame | None = None) -> DataFrame:
    """Each chain's head. With ``chains`` (chain_id) those without records, too: seq 0 and the hash before the first."""
    own = records.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.coalesce(F.max_by("hash", "seq"), F.lit(genesis)).alias("hash"))
    if chains is None:
        return own
    every = chains.select("chain_id").distinct().join(own, "chain_id", "left")
    return every.select("chain_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("hash", F.lit(genesis)).alias("hash"))


#: In which order each kind of listing comes.
ORDERINGS = {
    "records": ("chain_id", "seq"),
    "sessions": (F.desc, "started_at", "session_id"),
    "tools": ("server", "tool"),
    "chains": (F.desc, "last_seen", "chain_id"),
    "holds": ("created_at", "approval_id"),
}


def listed(rows: DataFrame, kind: str) -> DataFrame:
    """rows in the order of their kind of listing; where that is the newest first, ids settle ties."""
    first, *rest = ORDERINGS[kind]
    return rows.orderBy(*((first(rest[0]), *rest[1:]) if callable(first) else (first, *rest)))


def latest_signatures(signatures: DataFrame) -> DataFrame:
    """Each chain's newest signature, by insertion."""
    return signatures.groupBy("chain_id").agg(F.max_by(F.struct(*[c for c in signatures.columns if c != "chain_id"]), "sig_id").alias("s")).select("chain_id", "s.*")


def holds(spark: SparkSession, folder: str) -> DataFrame:
    """Well-formed hold documents, one JSON file each; unreadable ones are left out."""
    raw = spark.read.schema(HOLD + ", _corrupt_record STRING").option("multiLine", True).json(folder)
    return raw.where(F.col("_corrupt_record").isNull() & F.col("approval_id").rlike("^[A-Za-z0-9_-]+$") & F.col("status").isin(*STATUSES)).drop("_corrupt_record")


def tool_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(server, url, host, tool, permission_policy, friendly) of client configuration documents.

    The host is that of the address which a relay's parameter mcp_url names, else of the address itself. What is no such document
    gives no rows.
    """
    shape = "mcpServers MAP<STRING, STRUCT<url: STRING, tools: ARRAY<STRUCT<name: STRING, permission_policy: STRING>>>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
    servers = docs.select(F.explode("d.mcpServers").alias("server", "s"))
    relayed = F.try_parse_url(F.try_url_decode(F.try_parse_url("s.url", F.lit("QUERY"), F.lit("mcp_url"))), F.lit("HOST"))
    host = F.lower(F.coalesce(relayed, F.try_parse_url("s.url", F.lit("HOST"))))
    each = servers.select("server", "s.url", host.alias("host"), F.explode_outer("s.tools").alias("t"))
    return each.select("server", "url", "host", F.col("t.name").alias("tool"), F.col("t.permission_policy").alias("permission_policy"), friendly_name(F.col("server"), F.col("host")).alias("friendly"))


def policy_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, policy_hash): SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("policy_hash"))


def records_between(records: DataFrame, first: int | None = None, last: int | None = None, session_id: str | None = None, chain_id: str | None = None) -> DataFrame:
    """Records of a range of seqs, a session or a chain, in order."""
    for column, test in (("seq", None if first is None else F.col("seq") >= first), ("seq", None if last is None else F.col("seq") <= last), ("session_id", None if session_id is None else F.col("session_id") == session_id), ("chain_id", None if chain_id is None else F.col("chain_id") == chain_id)):
        records = records if test is None else records.where(test)
    return listed(records, "records")


def counts_by_run(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id").agg(F.count("*").alias("records"))


def bundles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, manifests) of bundle folders under ``folder``: events.jsonl and manifest.json, each row with its bundle_id, the folder's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    shape = "event_count BIGINT, from_seq BIGINT, to_seq BIGINT, head_hash STRING, signature_seq BIGINT, signature_hash STRING, public_key STRING, public_key_pem STRING"
    manifests = spark.read.schema(shape).option("multiLine", True).json(f"{folder}/*/manifest.json").select("*", name.alias("bundle_id"))
    raw = spark.read.text(f"{folder}/*/events.jsonl").select("value", name.alias("bundle_id")).where(F.trim("value") != "")
    v = raw.withColumn("v", F.try_parse_json("value"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    return v.select("bundle_id", get("$.seq", "bigint").alias("seq"), get("$.prev_hash", "string").alias("prev_hash"), get("$.hash", "string").alias("hash"), F.to_json(get("$.event", "variant")).alias("event")), manifests
