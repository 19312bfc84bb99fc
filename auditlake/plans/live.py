"""Registered queries over streams, growing logs and chains of any size, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators import correlate, integrity, policy, scan
from ..sources import logs, tail
from ..sources.adapters import AUDIT, CHAIN, audit_events, chain_events, table
from ..sources.shared import shared_path, written
from ..streaming import stateful, streams
from .registry import _ARGS, _SEALED, _TAMPERED, _calls, _tampered, query

_ONE = """o AS (SELECT 'all' AS chain_id, event_id + 1 AS seq, sha256('e' || (event_id - 1)) AS prev_hash, sha256(CASE WHEN event_id % 97 = 5 THEN 'x' ELSE 'e' END || event_id) AS hash, 2 * event_id + twice AS position
    FROM events, (VALUES (0), (1)) AS t(twice) WHERE event_id % 211 <> 7 AND (twice = 0 OR event_id % 301 = 9))"""


@query("verify_links_one_chain", f"""WITH {_ONE}, l AS (SELECT *, lag(seq) OVER w AS s, lag(hash) OVER w AS h FROM o WINDOW w AS (ORDER BY position)),
    p AS (SELECT chain_id, seq, unnest([CASE WHEN s IS NULL AND prev_hash <> '{C.GENESIS_HASH}' THEN 'bad_genesis' END, CASE WHEN seq <= s THEN 'duplicate_seq' END, CASE WHEN seq - s > 1 THEN 'seq_gap' END, CASE WHEN prev_hash <> h THEN 'prev_hash_mismatch' END]) AS problem FROM l)
    SELECT * FROM p WHERE problem IS NOT NULL""")  # fmt: skip
def verify_links_one_chain(spark, d):
    """All events as one chain, some altered, missing or twice, checked in ranges."""
    n = F.col("event_id")
    text = lambda mark, i: F.sha2(F.concat(mark, i.cast("string")), 256)
    twice = F.explode(F.when(n % 301 == 9, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("twice")
    rows = table(spark, d, "events").where("event_id % 211 <> 7").select("event_id", twice)
    records = rows.select(F.lit("all").alias("chain_id"), (n + 1).alias("seq"), text(F.lit("e"), n - 1).alias("prev_hash"), text(F.when(n % 97 == 5, "x").otherwise("e"), n).alias("hash"), (2 * n + F.col("twice")).alias("position"))
    return integrity.link_problems(records, parts=int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("self_check", f"""{_TAMPERED}, l AS (SELECT *, lag(seq) OVER (PARTITION BY chain_id ORDER BY seq) AS s FROM t),
    p AS (SELECT chain_id, min(seq) AS bad FROM l WHERE sha256(prev_hash || chr(10) || event) <> hash OR seq - s > 1 OR (s IS NULL AND prev_hash <> '{C.GENESIS_HASH}') GROUP BY 1)
    SELECT chain_id, max(t.seq) AS seq, max_by(hash, t.seq) AS hash, max(t.seq) FILTER (bad IS NULL OR t.seq < bad) AS sound_seq, max(bad) IS NOT NULL AS broken FROM t LEFT JOIN p USING (chain_id) GROUP BY chain_id""")  # fmt: skip
def self_check(spark, d):
    """Sealed chains in two batches: the second check reads the second batch alone, and goes on where the first one ended."""
    path = shared_path(spark, "log")
    records = _tampered(spark, d).select("chain_id", "seq", "prev_hash", "hash", "event")
    for batch, some in enumerate(("seq <= 20", "seq > 20")):
        integrity.lay_out(records.where(some), path, batch)
    reached = spark.createDataFrame([], integrity.REACHED)
    for batch in range(2):
        _, reached = integrity.self_check(integrity.laid_out(spark, path, batch - 1).where(F.col("batch") <= batch), reached)
    return reached


@query("log_tail", f"WITH {CHAIN} SELECT chain_id, seq, CASE WHEN event_id % 50 = 3 THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN event_id % 50 <> 3 THEN 'sha256:' || sha256(event) END AS event_ref FROM ch")
def log_tail(spark, d):
    """Events as JSONL logs, one for each chain, some lines broken; read as a stream of completed lines."""
    folder, out = shared_path(spark, "logs"), shared_path(spark, "tail")
    e = chain_events(spark, d)
    line = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"prev_hash":"'), F.col("chain_id"), F.lit('","hash":"h","event":'), "event", F.when(F.col("event_id") % 50 == 3, "").otherwise("}"))
    e.select(line.alias("value"), F.regexp_extract("chain_id", "[0-9]+", 0).cast("int").alias("log")).repartition("log").select("value").write.text(f"{folder}/all")
    rows = tail.tail(spark, f"{folder}/all", ".txt")
    streams.run_to_end(rows, stateful.by_batch(out), shared_path(spark, "tail-state"))
    lines = spark.read.schema("file string, start long, value string").parquet(out)
    of = lambda pattern: F.regexp_extract("value", pattern, 1)
    named = lines.withColumn("chain_id", of('"prev_hash":"([^"]*)"')).withColumn("n", of('"seq":([0-9]+)').cast("long"))
    return logs.parsed_records(named).select("chain_id", F.col("n").alias("seq"), F.when(F.col("parsed"), "ok").otherwise("corrupt").alias("status"), C.ref(F.col("event")).alias("event_ref"))


def _fed(spark, feeds: dict[str, list[DataFrame]], build: Callable[..., DataFrame], write: Callable[[DataFrame, int], None], state: str) -> None:
    """Slices that come one after another into the folder of each feed, each followed by what the stream built over the folders makes of it.

    A slice has the files of all tasks that write it and is a micro-batch of its own, as the stream runs to its end before the next one comes.
    """
    for some in zip(*feeds.values()):
        for path, part in zip(feeds, some):
            part.write.mode("append").parquet(path)
        sources = [spark.readStream.schema(part.schema).option("pathGlobFilter", "*.parquet").parquet(path) for path, part in zip(feeds, some)]
        streams.run_to_end(build(*sources), write, state)


def _slices(df: DataFrame, by: str, cuts: list, closing: DataFrame) -> list[DataFrame]:
    """df split at the cuts, and a last slice that lets the watermark pass all."""
    bounds = [F.col(by) < cuts[0], *[(F.col(by) >= a) & (F.col(by) < b) for a, b in zip(cuts, cuts[1:])], F.col(by) >= cuts[-1]]
    return [*[df.where(b) for b in bounds], closing]


_ENDED = "2099-01-01 00:00:00"


def _cuts(e: DataFrame) -> list:
    """Two times at which the events fall into three parts."""
    return [F.lit(t) for t in e.select(F.percentile_approx(F.col("ts").cast("timestamp"), [0.3, 0.7]).alias("q")).first().q]


@query("stream_request_response", """WITH q AS (SELECT event_id AS request_id, ts AS asked_at FROM events WHERE event_id % 5 <> 4), r AS (SELECT CASE WHEN event_id % 7 = 0 THEN -event_id - 1 ELSE event_id END AS request_id, ts + INTERVAL 1 SECOND * (event_id % 400) AS answered_at FROM events WHERE event_id % 3 <> 0)
    SELECT coalesce(q.request_id, r.request_id) AS request_id, CASE WHEN asked_at IS NULL THEN 'orphan_response' WHEN answered_at IS NULL THEN 'unanswered' ELSE 'answered' END AS status, (epoch_us(answered_at) - epoch_us(asked_at)) / 1000 AS duration_ms
    FROM q FULL JOIN r ON q.request_id = r.request_id AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL 300 SECOND""")  # fmt: skip
def stream_request_response(spark, d):
    """Requests and responses as two streams of several micro-batches; some responses are missing, late or of no request."""
    asked, answered, out = (shared_path(spark, n) for n in ("asked", "answered", "calls"))
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = F.col("event_id")
    requests = e.where("event_id % 5 <> 4").select(n.alias("request_id"), F.col("ts").alias("asked_at"))
    late = F.timestamp_seconds(F.unix_micros("ts") / 1e6 + n % 400)
    responses = e.where("event_id % 3 <> 0").select(F.when(n % 7 == 0, -n - 1).otherwise(n).alias("request_id"), late.alias("answered_at"))
    end = lambda df: spark.createDataFrame([(None, _ENDED)], "request_id long, at string").select("request_id", F.col("at").cast("timestamp").alias(df.columns[1]))
    cuts = _cuts(e)
    feeds = {asked: _slices(requests, "asked_at", cuts, end(requests)), answered: _slices(responses, "answered_at", cuts, end(responses))}
    calls = lambda q, r: stateful.live_request_response(q, r, ["request_id"], "300 seconds").where("request_id is not null")
    _fed(spark, feeds, calls, stateful.by_batch(out), shared_path(spark, "calls-state"))
    return spark.read.schema("request_id long, asked_at timestamp, answered_at timestamp, duration_ms double, status string").parquet(out).select("request_id", "status", "duration_ms")


@query("stream_silence", f"""WITH {AUDIT}, a AS (SELECT DISTINCT chain_id, ts FROM e WHERE chain_id <> 'c7'), g AS (SELECT chain_id, ts AS silent_from, coalesce(lead(ts) OVER (PARTITION BY chain_id ORDER BY ts), TIMESTAMP '{_ENDED}') AS silent_until FROM a)
    SELECT * FROM g WHERE epoch_us(silent_until) - epoch_us(silent_from) >= 21600000000""")  # fmt: skip
def stream_silence(spark, d):
    """Arrivals of chains as a stream of several micro-batches: outages of six hours and more, told when they begin and when they end."""
    path, out = shared_path(spark, "arrivals"), shared_path(spark, "alerts")
    e = audit_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = e.select("chain_id", F.col("ts").alias("received_at"))
    end = spark.createDataFrame([(None, _ENDED)], "chain_id string, at string").select("chain_id", F.col("at").cast("timestamp").alias("received_at"))
    forked = spark.createDataFrame([("c7",)], "chain_id string")
    alerts = lambda a: stateful.silence_alerts(a, 6 * 3600, forked=forked)
    _fed(spark, {path: _slices(arrivals, "received_at", _cuts(e), end)}, alerts, stateful.by_batch(out), shared_path(spark, "silence-state"))
    told = stateful.outages(spark.read.schema(stateful.OUTAGES).parquet(out), F.lit(_ENDED).cast("timestamp"))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return told.select("chain_id", ntz("silent_from"), ntz("silent_until"))


def _offered(spark, d, sound: bool) -> list[DataFrame]:
    """Sealed chains in two parts that overlap, or, not sound, in three: their first half; all but c1 to c4 whole, with an overlap; and what c1 to c4 claim instead.

    Of c1 a stored record comes back altered, c2 goes on behind a gap, c3 links to another head, and c4 breaks a link within.
    """
    sealed = written(integrity.seal(chain_events(spark, d)).drop("event"), "sealed")
    n = sealed.groupBy("chain_id").agg(F.max("seq").alias("n"))
    rows = sealed.join(F.broadcast(n), "chain_id").withColumn("half", F.floor(F.col("n") / 2))  # a fixed number of chains
    odd = F.lit(False) if sound else F.col("chain_id").isin("c1", "c2", "c3", "c4")
    columns = sealed.columns
    first = rows.where("seq <= half").select(columns)
    second = rows.where(~odd & (F.col("seq") >= F.col("half") - 1)).select(columns)
    seq, half, other = F.col("seq"), F.col("half"), F.sha2("hash", 256)
    claims = rows.where(odd & ((seq > half) | ((F.col("chain_id") == "c1") & (seq == half))) & ~((F.col("chain_id") == "c2") & (seq == half + 1)))
    hash_ = F.when((F.col("chain_id") == "c1") & (seq == half), other).otherwise(F.col("hash"))
    prev = F.when((F.col("chain_id") == "c3") & (seq == half + 1), other).when((F.col("chain_id") == "c4") & (seq == half + 3), other).otherwise(F.col("prev_hash"))
    claims = claims.withColumn("hash", hash_).withColumn("prev_hash", prev).select(columns)
    return [first, second] if sound else [first, second, claims]


def _ingested(spark, d, sound: bool = False) -> tuple[str, str]:
    records, out, refused = (shared_path(spark, n) for n in ("offered", "chains", "refused"))
    write = stateful.by_batch(out, refused, split=stateful.admitted_and_refused)
    _fed(spark, {records: _offered(spark, d, sound)}, stateful.ingest_chains, write, shared_path(spark, "chain-state"))
    return out, refused


_HALVES = "h AS (SELECT chain_id, floor(max(seq) / 2)::BIGINT AS half FROM sealed GROUP BY 1)"


@query("stream_chain_ingest", f"{_SEALED} SELECT chain_id, seq, prev_hash, hash FROM sealed")
def stream_chain_ingest(spark, d):
    """Sealed chains in micro-batches that overlap, admitted by each chain's state."""
    return spark.read.schema("chain_id string, seq long, prev_hash string, hash string").parquet(_ingested(spark, d, sound=True)[0]).select("chain_id", "seq", "prev_hash", "hash")


@query("stream_chain_admitted", f"{_SEALED}, {_HALVES} SELECT chain_id, seq, prev_hash, hash FROM sealed JOIN h USING (chain_id) WHERE chain_id NOT IN ('c1', 'c2', 'c3', 'c4') OR seq <= half")
def stream_chain_admitted(spark, d):
    """Chain records in three micro-batches, admitted by each chain's state: overlaps once, forks, gaps and broken links not at all."""
    return spark.read.schema("chain_id string, seq long, prev_hash string, hash string").parquet(_ingested(spark, d)[0]).select("chain_id", "seq", "prev_hash", "hash")


@query("stream_chain_refusals", f"""{_SEALED}, {_HALVES}, s AS (SELECT * FROM sealed JOIN h USING (chain_id))
    SELECT chain_id, seq, 'fork' AS reason, sha256(hash) AS offered_hash, hash AS stored_hash FROM s WHERE chain_id = 'c1' AND seq = half UNION ALL SELECT chain_id, seq, 'gap', hash, NULL FROM s WHERE chain_id = 'c2' AND seq = half + 2
    UNION ALL SELECT a.chain_id, a.seq, 'fork', a.hash, b.hash FROM s a JOIN s b ON a.chain_id = b.chain_id AND b.seq = a.half WHERE a.chain_id = 'c3' AND a.seq = a.half + 1 UNION ALL SELECT chain_id, seq, 'bad_link', hash, NULL FROM s WHERE chain_id = 'c4' AND seq = half + 3""")  # fmt: skip
def stream_chain_refusals(spark, d):
    """What the ingest refuses, with both branches of each fork."""
    rows = spark.read.schema(stateful.INGESTED).parquet(_ingested(spark, d)[1])
    return rows.select("chain_id", "seq", "reason", F.col("hash").alias("offered_hash"), "stored_hash")


@query("in_flight_evictions", """WITH r AS (SELECT o_custkey % 40 AS session, 10 * o_orderkey AS asked, CASE WHEN o_orderkey % 9 <> 0 THEN 10 * o_orderkey + 5 + 400 * (o_orderkey % 23) END AS answered FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY asked) AS n FROM r),
    c AS (SELECT i.session, i.asked, j.asked AS evicted_at, count(*) AS waiting FROM n i JOIN n j ON j.session = i.session AND j.n > i.n AND j.n <= i.n + 60 AND (i.answered IS NULL OR i.answered > j.asked)
        JOIN n k ON k.session = i.session AND k.n > i.n AND k.n <= j.n AND (k.answered IS NULL OR k.answered > j.asked) GROUP BY 1, 2, 3)
    SELECT session, asked, min(evicted_at) AS evicted_at FROM c WHERE waiting >= 12 GROUP BY 1, 2""")  # fmt: skip
def in_flight_evictions(spark, d):
    """Orders as requests of sessions in which twelve may wait at once; a request goes when twelve later ones wait."""
    n = F.col("o_orderkey")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("session"), (10 * n).alias("asked"), F.when(n % 9 != 0, 10 * n + 5 + 400 * (n % 23)).alias("answered"))
    return correlate.evictions(rows, "session", "asked", "answered", limit=12)


DOCUMENTS = {
    "old": {"mcp": {"default": "allow", "rules": [
        {"id": "no_tool_3", "match": {"server": ["server_1", "server_2"], "tool": "tool_3"}, "action": "deny", "reason": "not allowed"},
        {"id": "objects_never_match", "match": {"args": {"note": "server"}}, "action": "deny"},
        {"id": "one_digit", "match": {"tool": "tool_*", "args": {"k": "^[0-9]$"}}, "action": "hold"},
        {"id": "nineties", "match": {"any_arg": r"^u9\d?$|^server_4 9\d$"}, "action": "deny"},
        {"match": {"server": "server_0", "max_args_bytes": 59}, "action": "hold"},
    ]}},
    "new": {"mcp": {"default": "hold", "rules": [{"id": "to", "match": {"args": {"to.0": "^u[0-4]"}}, "action": "allow"}, {"id": "four", "match": {"server": "*_4"}, "action": "deny"}]}},
}
_BY_TABLE = f"""c AS (SELECT * EXCLUDE args, {_ARGS} AS args FROM e), v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'old' WHEN event_id % 3 = 1 THEN 'new' ELSE 'lost' END AS policy_hash,
    server IN ('server_1', 'server_2') AND tool = 'tool_3' AS a, regexp_matches(k::VARCHAR, '^[0-9]$') AS b, regexp_matches('u' || user_id, '^u9[0-9]?$|^server_4 9[0-9]$') OR regexp_matches(server || ' ' || k, '^u9[0-9]?$|^server_4 9[0-9]$') AS c, server = 'server_0' AND strlen(args) <= 59 AS d,
    regexp_matches('u' || user_id, '^u[0-4]') AS t, server = 'server_4' AS f FROM c),
    w AS (SELECT event_id, policy_hash, CASE policy_hash WHEN 'old' THEN CASE WHEN a THEN 'deny' WHEN b THEN 'hold' WHEN c THEN 'deny' WHEN d THEN 'hold' ELSE 'allow' END WHEN 'new' THEN CASE WHEN t THEN 'allow' WHEN f THEN 'deny' ELSE 'hold' END ELSE 'deny' END AS action,
    CASE policy_hash WHEN 'old' THEN CASE WHEN a THEN 'no_tool_3' WHEN b THEN 'one_digit' WHEN c THEN 'nineties' WHEN d THEN 'rule[4]' END WHEN 'new' THEN CASE WHEN t THEN 'to' WHEN f THEN 'four' END END AS rule, policy_hash = 'lost' AS fail_closed FROM v)"""


def _under_policies(spark, d) -> DataFrame:
    n = F.col("event_id") % 3
    return _calls(spark, d).withColumn("policy_hash", F.when(n == 0, "old").when(n == 1, "new").otherwise("lost"))


@query("policy_by_table", f"WITH {AUDIT}, {_BY_TABLE} SELECT * FROM w")
def policy_by_table(spark, d):
    """Each call under the policy that it names: two documents, and one that nobody has."""
    out = policy.evaluate_table(_under_policies(spark, d), policy.rule_table(spark, DOCUMENTS))
    return out.select("event_id", "policy_hash", "action", "rule", "fail_closed")


@query("stream_policy_filter", f"WITH {AUDIT}, {_BY_TABLE} SELECT event_id, action, rule, CASE WHEN event_id % 10 = 0 THEN 'key [redacted:sha256:' || left(sha256('AKIA' || lpad(event_id::VARCHAR, 16, '0')), 16) || '] end' ELSE 'result ' || event_id END AS result FROM w")
def stream_policy_filter(spark, d):
    """Calls as a stream: each is decided by the table of rules, and its result filtered."""
    path, out = shared_path(spark, "calls"), shared_path(spark, "decided")
    n = F.col("event_id").cast("string")
    secret = F.concat(F.lit("key AKIA"), F.lpad(n, 16, "0"), F.lit(" end"))
    calls = _under_policies(spark, d).select("event_id", "policy_hash", "server", "tool", "args", F.when(F.col("event_id") % 10 == 0, secret).otherwise(F.concat(F.lit("result "), n)).alias("result"))
    calls = written(calls, "all-calls")
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    rules = policy.rule_table(spark, DOCUMENTS)
    decided = lambda c: policy.evaluate_table(c, rules).select("event_id", "action", "rule", scan.redact(F.col("result")).alias("result"))
    _fed(spark, {path: [calls.where(third == i) for i in range(3)]}, decided, stateful.by_batch(out), shared_path(spark, "policy-state"))
    return spark.read.schema("event_id long, action string, rule string, result string").parquet(out).select("event_id", "action", "rule", "result")
