"""Registered queries over logs, signatures, intake batches, redaction and catalogs, with the SQL that gives the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import ed25519, identity
from ..operators import correlate, integrity, policy, redaction, replica, scan, search, sessions
from ..sources import logs
from ..sources.adapters import AUDIT, CHAIN, audit_events, chain_events, spread, table
from ..sources.shared import written
from .registry import _REF, _SEALED, _TAMPERED, _tampered, query

text = lambda c: F.col(c).cast("string")
lit = F.lit


@query("chain_heads", f"{_SEALED}, n AS (SELECT 'c' || i AS chain_id FROM range(70) AS r(i)) SELECT chain_id, coalesce(max(seq), 0) AS seq, coalesce(max_by(hash, seq), '{C.GENESIS_HASH}') AS hash FROM n LEFT JOIN sealed USING (chain_id) GROUP BY 1")
def chain_heads(spark, d):
    """Heads of seventy chains, of which the last ones have no record."""
    return logs.heads(integrity.seal(chain_events(spark, d)), C.GENESIS_HASH, spark.range(70).select(F.concat(lit("c"), text("id")).alias("chain_id")))


@query("latest_signatures", f"WITH {CHAIN} SELECT chain_id, max(1000 - seq) AS sig_id, max_by(seq, 1000 - seq) AS seq, max_by(event_id, 1000 - seq) AS event_id FROM ch WHERE event_id % 3 = 0 GROUP BY 1")
def latest_signatures(spark, d):
    """The newest by insertion, which isn't the one of the greatest seq here."""
    return logs.latest_signatures(chain_events(spark, d).where("event_id % 3 = 0").select("chain_id", (1000 - F.col("seq")).alias("sig_id"), "seq", "event_id"))


@query("records_of_session", f"WITH {CHAIN}, one AS (SELECT max_by(session_id, n) AS session_id FROM (SELECT session_id, count(*) * 1000000 - min(event_id) AS n FROM ch GROUP BY 1)) SELECT chain_id, seq, event_id FROM ch WHERE session_id IN (SELECT session_id FROM one) AND seq BETWEEN 2 AND 1000")
def records_of_session(spark, d):
    """A range of the session with the most events."""
    e = chain_events(spark, d)
    most = e.groupBy("session_id").agg((F.count("*") * 1_000_000 - F.min("event_id")).alias("n")).agg(F.max_by("session_id", "n")).first()[0]
    return logs.records_between(e, 2, 1000, session_id=most).select("chain_id", "seq", "event_id")


@query("counts_by_run", f"WITH {AUDIT} SELECT 'run' || (event_id % 7) AS run_id, count(*) AS records FROM e GROUP BY 1")
def counts_by_run(spark, d):
    return logs.counts_by_run(audit_events(spark, d).withColumn("run_id", F.concat(lit("run"), (F.col("event_id") % 7).cast("string"))))


@query("replica_scan", f"WITH {CHAIN} SELECT ch.chain_id, ch.seq, e.ts + INTERVAL 5 SECOND AS received_at FROM ch JOIN e USING (event_id) WHERE ch.chain_id = 'c3' AND ch.seq BETWEEN 5 AND 40")
def replica_scan(spark, d):
    """A chain's records with the time at which each arrived."""
    arrived = audit_events(spark, d).select("event_id", (F.col("ts") + F.expr("interval 5 seconds")).alias("received_at"))
    return logs.records_between(chain_events(spark, d).join(arrived, "event_id"), 5, 40, chain_id="c3").select("chain_id", "seq", "received_at")


HEAD = "head"


def _signed(seq: Column, chain_hash: Column, seed: Column) -> tuple[Column, Column]:
    """(public key, signature) over a head, by the key of a secret seed."""

    @F.arrow_udf("struct<key:string,signature:string>")
    def sign(messages: pa.Array, seeds: pa.Array) -> pa.Array:
        out = []
        for m, s in zip(messages.to_pylist(), seeds.to_pylist()):
            secret = bytes.fromhex(s)
            out.append({"key": ed25519.public_key(secret).hex(), "signature": ed25519.sign(m.encode(), secret).hex()})
        return pa.array(out, pa.struct([("key", pa.string()), ("signature", pa.string())]))

    both = sign(F.concat(lit(HEAD + "\n"), seq.cast("string"), lit("\n"), chain_hash), seed)
    return both["key"], both["signature"]


_EIGHTH = "h AS (SELECT chain_id, max(seq) AS head, substr(chain_id, 2)::INT % 8 AS m FROM ch GROUP BY 1)"


@query("signature_verdicts", f"""WITH {CHAIN}, {_EIGHTH} SELECT chain_id, head + (problem = 'truncated_after_signature')::INT AS seq, problem, problem = 'unsigned_tail' AS warning
    FROM (SELECT chain_id, head, unnest(CASE m WHEN 0 THEN ['no_valid_signature'] WHEN 2 THEN ['unsigned_tail'] WHEN 3 THEN ['unsigned_session_end'] WHEN 4 THEN ['truncated_after_signature'] WHEN 5 THEN ['signature_chain_mismatch'] WHEN 1 THEN [] ELSE ['signature_invalid', 'no_valid_signature'] END) AS problem FROM h)""")  # fmt: skip
def signature_verdicts(spark, d):
    """Chains with and without a signed head: unsigned, signed short of the head, past it, over another hash, or not by the key."""
    e = chain_events(spark, d)
    case = (F.regexp_extract("chain_id", "[0-9]+", 0).cast("int") % 8).alias("m")
    head = e.groupBy("chain_id").agg(F.max("seq").alias("head")).select("chain_id", "head", case)
    ended = (F.col("m") == 3) & (F.col("seq") == F.col("head"))
    event = F.when(ended, F.regexp_replace("event", '"kind":"[a-z_]*"', '"kind":"session_end"')).otherwise(F.col("event"))
    records = integrity.seal(e.join(head, "chain_id").withColumn("event", event))
    m = F.col("m")
    at = F.when(m.isin(2, 3), F.col("head") - 2).otherwise(F.col("head"))
    over = records.join(head, "chain_id").where((m != 0) & (F.col("seq") == at)).select("chain_id", "m", F.when(m == 4, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"), F.when(m == 5, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("chain_hash"))
    key, signature = _signed(F.col("seq"), F.col("chain_hash"), F.sha2("chain_id", 256))
    signed = over.select("chain_id", "m", "seq", "chain_hash", lit("ed25519").alias("algo"), key.alias("public_key"), signature.alias("signature"))
    signed = signed.withColumn("signature", F.when(m == 6, F.reverse("signature")).otherwise(F.col("signature"))).withColumn("public_key", F.when(m == 7, "zz").otherwise(F.col("public_key")))
    return integrity.signature_verdicts(signed.drop("m"), records, HEAD)


def _batches(spark, d) -> DataFrame:
    """Each chain's first four records as a batch, with a fault by the chain's number."""
    r = integrity.seal(chain_events(spark, d)).where("seq <= 4")
    rows = r.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("seq", "prev_hash", "hash", "event"))).alias("records"))
    m = F.regexp_extract("chain_id", "[0-9]+", 0).cast("int") % 16
    bad = lambda i, column, value: F.when(m == i, value).otherwise(column)
    hash_ = F.sha2("chain_id", 256)
    broken = F.transform("records", lambda x: x.withField("prev_hash", lit("x")))
    three, twice = F.slice("records", 1, 3), F.concat("records", F.transform("records", lambda x: x.withField("seq", x["seq"] + 4)))
    body = F.concat(lit("body of "), "chain_id", F.when(m == 14, F.repeat(lit("x"), 200)).otherwise(""))
    return rows.select(
        "chain_id", m.alias("m"), bad(1, lit(1), lit(9)).alias("protocol"), bad(2, hash_, F.upper(hash_)).alias("id"), bad(3, hash_, lit("")).alias("key"), bad(4, lit(C.GENESIS_HASH), lit(None)).alias("base_hash"),
        bad(5, bad(8, bad(6, lit(1), lit(0)), lit(5)), lit(-1)).cast("long").alias("from_seq"), bad(13, bad(9, lit(4), lit(3)), lit(8)).cast("long").alias("to_seq"), bad(10, lit(4), lit(-4)).cast("long").alias("head_seq"), hash_.alias("head_hash"),
        bad(7, bad(11, bad(12, bad(13, F.col("records"), twice), three), broken), lit(None)).alias("records"), body.alias("body"), F.sha2(bad(15, body, lit("other")), 256).alias("body_digest"),
    )


@query("intake_faults", f"WITH {CHAIN}, {_EIGHTH}, c AS (SELECT chain_id, substr(chain_id, 2)::INT % 16 AS m FROM h) SELECT chain_id, CASE m WHEN 1 THEN 'unsupported protocol' WHEN 2 THEN 'chain_id' WHEN 3 THEN 'key' WHEN 4 THEN 'base_hash' WHEN 5 THEN 'from_seq' WHEN 6 THEN 'heartbeat' WHEN 7 THEN 'records' WHEN 8 THEN 'range' WHEN 9 THEN 'count' WHEN 10 THEN 'head' WHEN 11 THEN 'record shape' WHEN 12 THEN 'count' WHEN 13 THEN 'too large' WHEN 14 THEN 'too large' WHEN 15 THEN 'body digest differs' END AS reason FROM c")
def intake_faults(spark, d):
    """Batches of which most are refused, each for another reason; at most six records and 100 bytes are admitted."""
    named = _batches(spark, d).withColumnRenamed("chain_id", "name").withColumnRenamed("id", "chain_id")
    return replica.batch_faults(named, 1, most_records=6, most_bytes=100).select(F.col("name").alias("chain_id"), "reason")


@query("attested_seq", f"{_SEALED} SELECT chain_id, max(seq) AS attested_seq, count(*) AS signatures FROM sealed WHERE event_id % 5 = 2 AND event_id % 3 <> 0 GROUP BY 1")
def attested_seq(spark, d):
    """Signatures, each of them twice, some over another hash."""
    stored = integrity.seal(chain_events(spark, d))
    number = F.get_json_object("event", "$.event_id").cast("long")
    signed = stored.where(number % 5 == 2).select("chain_id", "seq", F.when(number % 3 == 0, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("chain_hash"), F.md5("hash").alias("signature"))
    return replica.attested(signed.unionByName(signed), stored)


@query("ownership", """WITH b AS (SELECT o_orderkey AS batch, 'chain' || (o_custkey % 30) AS chain_id, 'key' || (o_orderkey % 4) AS key, o_orderpriority AS tenant FROM orders), w AS (SELECT chain_id, min_by(key, batch) AS key, min_by(tenant, batch) AS tenant FROM b GROUP BY 1)
    SELECT b.batch, chain_id FROM b JOIN w USING (chain_id) WHERE b.key <> w.key OR b.tenant <> w.tenant""")  # fmt: skip
def ownership(spark, d):
    """Batches of chains whose first batch came under another key or tenant."""
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch"), F.concat(lit("chain"), (F.col("o_custkey") % 30).cast("string")).alias("chain_id"), F.concat(lit("key"), (F.col("o_orderkey") % 4).cast("string")).alias("key"), F.col("o_orderpriority").alias("tenant"))
    owners = b.groupBy("chain_id").agg(F.min_by("key", "batch").alias("key"), F.min_by("tenant", "batch").alias("tenant"))
    return replica.ownership(b, owners).select("batch", "chain_id")


@query("with_pending", f"WITH {AUDIT} SELECT event_id, kind, CASE WHEN event_id % 3 = 0 THEN tool END AS tool, CASE WHEN event_id % 3 <> 0 THEN server END AS server FROM e WHERE event_id % 3 = 0 OR event_id % 2 = 0")
def with_pending(spark, d):
    """Stored and pending events of unlike columns; what is stored goes first, pending ones come twice."""
    e = audit_events(spark, d)
    pending = e.where("event_id % 2 = 0").select("event_id", "kind", "server")
    return correlate.with_pending(e.where("event_id % 3 = 0").select("event_id", "kind", "tool"), pending.unionByName(pending))


@query("decisions_of_calls", f"WITH {AUDIT} SELECT c.event_id, p.decision AS decided, p.rule_id FROM e c LEFT JOIN e p ON p.event_id = c.event_id - 1 AND p.kind = 'policy_decision' WHERE c.kind = 'tool_call'")
def decisions_of_calls(spark, d):
    """Calls with the decision that came just before, if one did."""
    e = audit_events(spark, d)
    calls = e.where("kind = 'tool_call'").select("event_id", (F.col("event_id") - 1).alias("decision_id"))
    return correlate.decisions_of_calls(calls, e.where("kind = 'policy_decision'")).select("event_id", "decided", "rule_id")


_CATALOG = "g AS (SELECT 'server_' || (s_suppkey % 4) AS server, 'host' || (s_suppkey % 4) || '.example' AS host, 'tool_' || (s_suppkey % 9) AS tool FROM supplier GROUP BY ALL)"


def _catalog(spark, d) -> DataFrame:
    n = F.col("s_suppkey")
    name = lambda prefix, m, suffix="": F.concat(lit(prefix), (n % m).cast("string"), lit(suffix))
    return table(spark, d, "supplier").select(name("server_", 4).alias("server"), name("host", 4, ".example").alias("host"), name("tool_", 9).alias("tool")).distinct()


@query("call_origins", f"""WITH {AUDIT}, {_CATALOG}, one AS (SELECT tool, min(host) AS host FROM g WHERE tool IN ('tool_1', 'tool_2') AND server = 'server_1' GROUP BY 1)
    SELECT event_id, coalesce(k.host, one.host) AS host FROM e LEFT JOIN (SELECT DISTINCT server, host FROM g) k USING (server) LEFT JOIN one ON one.tool = e.tool""")  # fmt: skip
def call_origins(spark, d):
    """Calls' hosts by server, or by the tool where one server of the catalog alone has it; server_4 isn't in the catalog."""
    rare = F.col("tool").isin("tool_1", "tool_2") & (F.col("server") != "server_1")
    return correlate.origins(audit_events(spark, d).select("event_id", "server", "tool"), _catalog(spark, d).withColumn("tool", F.when(rare, "tool_0").otherwise(F.col("tool")))).select("event_id", "host")


@query("stale_markers", "SELECT o_orderkey AS request_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate::TIMESTAMP) > 86400000000::BIGINT * 300")
def stale_markers(spark, d):
    """Orders as markers that a returned item settles, left for more than 300 days."""
    markers = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), lit("s").alias("session_id"), F.col("o_orderdate").alias("started_at"))
    settled = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("request_id"), lit("s").alias("session_id"))
    return correlate.stale(markers, settled, lit("1998-01-01"), 300 * 24 * 3600).select("request_id")


@query("redelivery", f"WITH {AUDIT} SELECT identity, sum(k + k % 4)::BIGINT AS enqueued, sum(k)::BIGINT AS written, sum(k % 4)::BIGINT AS dropped FROM e WHERE event_id % 6 = 1 GROUP BY 1")
def redelivery(spark, d):
    """Every sixth event as a session's end that tells its counters."""
    e = audit_events(spark, d).select("identity", F.when(F.col("event_id") % 6 == 1, "session_end").otherwise("rpc").alias("kind"), F.col("k").alias("events_recorded"), (F.col("k") % 4).alias("events_dropped"))
    return sessions.redelivery(e, "identity")


@query("tool_name_parts", f"WITH {AUDIT} SELECT event_id, CASE event_id % 4 WHEN 0 THEN server WHEN 1 THEN 'a' ELSE '' END AS server, CASE event_id % 4 WHEN 1 THEN 'b__' || tool WHEN 3 THEN 'mcp__' || tool ELSE tool END AS tool FROM e")
def tool_name_parts(spark, d):
    n = F.col("event_id") % 4
    name = F.when(n == 0, F.concat(lit("mcp__"), "server", lit("__"), "tool")).when(n == 1, F.concat(lit("mcp__a__b__"), "tool")).when(n == 2, F.col("tool")).otherwise(F.concat(lit("mcp__"), "tool"))
    server, tool = C.tool_parts(F.col("name"))
    return audit_events(spark, d).select("event_id", name.alias("name")).select("event_id", server.alias("server"), tool.alias("tool"))


@query("rule_lint", """WITH r AS (SELECT 'p' || (p_partkey % 20) AS policy_hash, p_brand AS rule_id, p_size IN (7, 9) AS empty FROM part)
    SELECT policy_hash, rule_id, 'duplicate_id' AS problem FROM r GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT policy_hash, rule_id, 'empty_glob' FROM r WHERE empty""")  # fmt: skip
def rule_lint(spark, d):
    """Parts as rules of twenty policies."""
    empty = F.col("p_size").isin(7, 9)
    rules = table(spark, d, "part").select(F.concat(lit("p"), (F.col("p_partkey") % 20).cast("string")).alias("policy_hash"), F.col("p_brand").alias("rule_id"), F.array(lit("a"), F.when(empty, " ").otherwise("b")).alias("server"), F.array(lit("**")).alias("tool"))
    return policy.lint(rules)


@query("scrubbed_keys", f"SELECT p_partkey, CASE WHEN contains(p_brand, '4') OR NOT regexp_matches(p_brand, '^[A-Za-z][A-Za-z0-9_./:-]*$') THEN {_REF.format('p_brand')} ELSE p_brand END AS k1, CASE WHEN regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9_./:-]*$') AND NOT contains(p_name, '4') THEN p_name ELSE {_REF.format('p_name')} END AS k2 FROM part WHERE p_brand <> p_name")
def scrubbed_keys(spark, d):
    keys = F.map_keys(C.scrub_keys(F.create_map("p_brand", lit(1), "p_name", lit(2)), "4"))
    return table(spark, d, "part").where("p_brand <> p_name").select("p_partkey", keys[0].alias("k1"), keys[1].alias("k2"))


_TOKEN = "'AKIA' || lpad(event_id::VARCHAR, 16, '0')"
_NOTE = f"'first ' || {_TOKEN} || ' then ' || {_TOKEN} || CASE WHEN event_id % 4 = 0 THEN ' and ghp_' || repeat('a', 15) || lpad(event_id::VARCHAR, 8, '0') ELSE '' END"


def _with_secrets(spark, d) -> DataFrame:
    """JSON events whose argument holds an access key twice, and some a token."""
    n = text("event_id")
    key = F.concat(lit("AKIA"), F.lpad(n, 16, "0"))
    note = F.concat(lit("first "), key, lit(" then "), key, F.when(F.col("event_id") % 4 == 0, F.concat(lit(" and ghp_"), lit("a" * 15), F.lpad(n, 8, "0"))).otherwise(""))
    event = F.concat(lit('{"kind":"tool_call","arguments":{"note":"'), note, lit('"}}'))
    return spread(audit_events(spark, d).select("event_id", "session_id", event.alias("event")), "event_id").withColumn("event", redaction.scrub(F.col("event"), lockdown=True))


@query("embedded_secret_refs", f"""WITH {AUDIT} SELECT event_id, {_REF.format(_NOTE)} AS ref, list_filter([{_REF.format(_TOKEN)}, CASE WHEN event_id % 4 = 0 THEN {_REF.format("'ghp_' || repeat('a', 15) || lpad(event_id::VARCHAR, 8, '0')")} END], lambda x: x IS NOT NULL) AS secret_refs FROM e""")
def embedded_secret_refs(spark, d):
    """What a scrubbed argument keeps: its own reference and those of the secrets within."""
    at = lambda path: F.get_json_object("event", f"$.arguments.note.{path}")
    return _with_secrets(spark, d).select("event_id", at("ref").alias("ref"), F.from_json(at("secret_refs"), "array<string>").alias("secret_refs"))


@query("embedded_secret_radius", f"WITH {AUDIT} SELECT {_TOKEN} AS needle, event_id, session_id, 'ref' AS matched_on, '$.arguments.note.secret_refs[0]' AS path FROM e WHERE event_id % 20 = 3")
def embedded_secret_radius(spark, d):
    """Events that a key touched as a part of a longer text, which they keep as a reference only."""
    e = _with_secrets(spark, d)
    needles = e.where("event_id % 20 = 3").select(F.concat(lit("AKIA"), F.lpad(text("event_id"), 16, "0")).alias("needle"))
    return search.touched(needles, written(search.event_index(e), "index"))


@query("token_refs_in_texts", "SELECT page_id, list_sort(list_filter(list_distinct([" + _REF.format("t[1]") + ", " + _REF.format("t[2]") + """]), lambda x: x IS NOT NULL)) AS refs FROM (SELECT page_id, regexp_extract_all(html, '<title>[^<]*</title>') || regexp_extract_all(html, 'href="[^"]*"')[1:1] AS t FROM pages WHERE html IS NOT NULL) WHERE len(t) BETWEEN 1 AND 2""")
def token_refs_in_texts(spark, d):
    """The references of a page's title and first link, where it has at most these two."""
    title, link = F.regexp_extract_all("html", lit("<title>[^<]*</title>"), lit(0)), F.slice(F.regexp_extract_all("html", lit('href="[^"]*"'), lit(0)), 1, 1)
    tokens = F.concat(title, link)
    return table(spark, d, "pages").where("html is not null").select("page_id", tokens.alias("t")).where(F.size("t").between(1, 2)).select("page_id", F.sort_array(F.array_distinct(F.transform("t", C.ref))).alias("refs"))


_DEEP = "repeat('{\"a\":[', event_id % 6) || '1' || repeat(']}', event_id % 6)"


@query("bounded_canonical", f"""WITH {AUDIT} SELECT event_id, CASE WHEN event_id % 6 <= 3 THEN {_DEEP} ELSE repeat('{{"a":[', 3) || '"[deeper]"' || repeat(']}}', 3) END AS canon, event_id % 6 > 3 AS capped FROM e""")
def bounded_canonical(spark, d):
    """Nested objects and arrays, cut below six of them."""
    n = (F.col("event_id") % 6).cast("int")
    nested = F.concat(F.repeat(lit('{"a": ['), n), lit(" 1"), F.repeat(lit("]}"), n))
    bound = audit_events(spark, d).select("event_id", C.bounded_canonical(nested, "[deeper]", 6).alias("b"))
    return bound.select("event_id", F.col("b.text").alias("canon"), "b.capped")


_CLAIM_FAULTS = {1: "alg", 2: "iss", 3: "sub", 4: "idp", 5: "tool", 6: "host", 7: "exp", 8: "expired", 9: "future", 10: "segments", 11: "payload", 12: "email"}


@query("actor_claims", "SELECT c_custkey, CASE c_custkey % 14 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in _CLAIM_FAULTS.items()) + " END AS error, CASE WHEN c_custkey % 14 IN (0, 13) THEN 'u' || c_custkey || '@example.com' END AS email, CASE WHEN c_custkey % 14 IN (0, 13) THEN 'user' END AS run_as FROM customer")
def actor_claims(spark, d):
    """Customers' identity tokens, most with something wrong."""
    m = F.col("c_custkey") % 14
    bad = lambda i, good, value: F.when(m == i, value).otherwise(good)
    uuid = F.concat(lit("00000000-0000-4000-8000-"), F.lpad(F.hex("c_custkey"), 12, "0"))
    claims = F.to_json(F.struct(
        bad(2, lit("issuer"), lit("else")).alias("iss"), lit("gate").alias("aud"), bad(3, uuid, text("c_custkey")).alias("sub"), uuid.alias("tenant_id"), lit("human").alias("kind"), lit("user").alias("run_as"),
        bad(4, lit("okta"), lit("none")).alias("idp"), lit("").alias("idp_sub"), F.struct(uuid.alias("id"), bad(5, lit("t"), lit("")).alias("name"), lit("1").alias("version")).alias("tool"),
        F.struct(lit("o").alias("origin"), bad(6, lit("local"), lit("moon")).alias("kind")).alias("host"), lit("j").alias("jti"), bad(9, lit(1000), lit(2031)).alias("iat"), bad(7, bad(8, lit(2000), lit(1970)), lit(None)).alias("exp"),
        lit("t").alias("tenant"), bad(12, F.concat(lit("u"), text("c_custkey"), lit("@example.com")), lit("")).alias("email"), lit("r").alias("role"),
    ))
    segment = lambda c: F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[=\r\n]", ""), "+/", "-_")
    header = segment(bad(1, lit('{"alg":"EdDSA","kid":"k"}'), lit('{"alg":"none"}')))
    token = F.concat(lit(" "), header, lit("."), bad(11, segment(claims), segment(lit("[1]"))), bad(10, lit(".c2ln"), lit("")))
    tokens = table(spark, d, "customer").select("c_custkey", token.alias("token"))
    return identity.with_actor(tokens, "token", "issuer", "gate", lit(2000)).select("c_custkey", "actor.error", F.col("actor.user.email").alias("email"), "actor.run_as")


@query("semantic_attributes", f"""WITH {AUDIT} SELECT event_id, CASE WHEN kind = 'tool_call' THEN 'execute_tool' END AS operation, CASE WHEN kind = 'tool_call' THEN tool END AS tool, CASE WHEN kind IN ('tool_call', 'rpc', 'notification') THEN 'jsonrpc' END AS system, CASE WHEN kind = 'rpc' THEN event_id::VARCHAR END AS request_id,
    CASE WHEN kind = 'tool_call' THEN 'tools/call' WHEN kind IN ('rpc', 'notification') THEN 'do/' || tool END AS method, CASE WHEN kind IN ('tool_call', 'rpc') THEN error_type END AS error, CASE kind WHEN 'tool_call' THEN gateway_decision WHEN 'policy_decision' THEN decision END AS decided FROM e""")  # fmt: skip
def semantic_attributes(spark, d):
    e = audit_events(spark, d)
    bag = identity.attributes(F.col("kind"), F.col("tool"), F.concat(lit("do/"), "tool"), text("event_id"), F.col("error_type"), F.coalesce("gateway_decision", "decision"), F.col("rule_id"), "lake")
    of = lambda name, key: F.col("bag")[key].alias(name)
    return e.select("event_id", bag.alias("bag")).select("event_id", of("operation", "gen_ai.operation.name"), of("tool", "gen_ai.tool.name"), of("system", "rpc.system"), of("request_id", "rpc.jsonrpc.request_id"), of("method", "mcp.method.name"), of("error", "error.type"), of("decided", "lake.policy.decision"))


_SPELT = f"""k AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'key' || s_suppkey ELSE '00000000-0000-4000-8000-' || lpad(s_suppkey::VARCHAR, 12, '0') END AS server, 'tool_' || (s_suppkey % 9) AS tool, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'mcp.vendor' || s_suppkey || '.com' ELSE 'acme' || s_suppkey || '.mcp.com' END AS host FROM supplier),
    f AS (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN server WHEN s_suppkey % 3 = 1 THEN 'vendor' || s_suppkey WHEN s_suppkey % 3 = 2 THEN 'acme' || s_suppkey END AS friendly FROM k),
    s AS (SELECT server, tool, list_distinct(list_filter([server, '{policy.OPAQUE_SEGMENT}', friendly, upper(left(friendly, 1)) || substr(friendly, 2), '{policy.CLIENT_PREFIX}' || friendly, host, '{policy.UNKNOWN_SEGMENT}'], lambda x: x IS NOT NULL)) AS g, leg FROM (SELECT *, CASE WHEN s_suppkey % 5 < 2 THEN 'hook' ELSE 'gateway' END AS leg FROM f))"""


def _servers(spark, d) -> DataFrame:
    n = F.col("s_suppkey")
    key = F.when(n % 2 == 0, F.concat(lit("key"), text("s_suppkey"))).otherwise(F.concat(lit("00000000-0000-4000-8000-"), F.lpad(text("s_suppkey"), 12, "0")))
    host = F.when(n % 3 == 1, F.concat(lit("mcp.vendor"), text("s_suppkey"), lit(".com"))).when(n % 3 == 2, F.concat(lit("acme"), text("s_suppkey"), lit(".mcp.com")))
    return table(spark, d, "supplier").select(key.alias("server"), F.concat(lit("tool_"), (n % 9).cast("string")).alias("tool"), host.alias("host"), F.when(n % 5 < 2, "hook").otherwise("gateway").alias("leg"))


@query("tool_spelling_drift", f"""WITH {_SPELT}, n AS (SELECT server, tool, unnest(g) AS x FROM s), p AS (SELECT unnest(['^mcp__(vendor|acme)', '__tool_[0-4]$', '^mcp__[A-Z]']) AS pattern)
    SELECT pattern, server, tool, count(*) FILTER (regexp_matches('mcp__' || x || '__' || tool, pattern)) AS matched, count(*) FILTER (NOT regexp_matches('mcp__' || x || '__' || tool, pattern)) AS missed FROM n, p GROUP BY ALL HAVING min(regexp_matches('mcp__' || x || '__' || tool, pattern)::INT) = 0 AND max(regexp_matches('mcp__' || x || '__' || tool, pattern)::INT) = 1""")  # fmt: skip
def tool_spelling_drift(spark, d):
    """All seven spellings of tools against patterns that meet some of them."""
    found = policy.spelling_drift(_servers(spark, d), ["^mcp__(vendor|acme)", "__tool_[0-4]$", "^mcp__[A-Z]"])
    return found.select("pattern", "server", "tool", F.size("matched").cast("long").alias("matched"), F.size("missed").cast("long").alias("missed"))


@query("catalog_coverage", f"""WITH {_SPELT} SELECT server, tool, leg, CASE WHEN leg = 'hook' THEN CASE WHEN regexp_matches(tool, '_[0-3]$') THEN 'deny' ELSE 'allow' END WHEN tool = 'tool_3' THEN 'deny' WHEN tool = 'tool_5' THEN 'hold' ELSE 'allow' END AS action,
    CASE WHEN leg = 'gateway' THEN CASE tool WHEN 'tool_3' THEN 'three' WHEN 'tool_5' THEN 'five' END END AS rule FROM s""")  # fmt: skip
def catalog_coverage(spark, d):
    """A catalog's tools under rules on names; a rule on arguments covers none of them."""
    rules = [policy.Rule("deny", tool=("tool_4",), args={"$.x": "."}, rule_id="argued"), policy.Rule("deny", tool=("tool_3",), rule_id="three"), policy.Rule("hold", tool=("*_5",), rule_id="five")]
    return policy.catalog_coverage(_servers(spark, d), rules, "allow", ["__tool_[0-3]$"])


@query("guarded_controls", f"WITH {AUDIT} SELECT event_id, CASE WHEN k % 4 = 3 THEN 'allow' ELSE 'deny' END AS action, CASE WHEN k % 4 < 3 THEN 'dont-touch-the-controls' END AS rule FROM e")
def guarded_controls(spark, d):
    """Arguments that name the engine's own folder or a client's configuration."""
    kind = F.col("k") % 4
    args = F.when(kind == 0, '{"path":"/home/u/.lake/chain.db"}').when(kind == 1, '{"files":["a",{"p":"/p/.mcp.json"}]}').when(kind == 2, '{"p":"x/.claude/settings.local.json"}').otherwise('{"p":"/x/lake/.lakes","q":"mcp.json"}')
    rules, default = policy.rules_of(policy.starter_document(".lake"))
    return policy.evaluate(audit_events(spark, d).withColumn("args", args), rules, default).select("event_id", "action", "rule")


@query("command_lines", f"""SELECT c_custkey, 'run --api-key ' || {_REF.format('c_name')} || ' NAME=' || c_custkey || ' DB_PASSWORD=' || {_REF.format("'pw' || c_custkey")} || ' postgres://db/x OWN_TOKEN=' || {_REF.format("'t'")} || ' --verbose' AS command,
    [{_REF.format('c_name')}, {_REF.format("'pw' || c_custkey")}, {_REF.format("'u' || c_custkey || ':p w'")}, {_REF.format("'p w'")}, {_REF.format("'u' || c_custkey")}, {_REF.format("'u' || c_custkey || ':p%20w'")}, {_REF.format("'p%20w'")}] AS refs FROM customer""")  # fmt: skip
def command_lines(spark, d):
    """Customers' command lines with credentials in flags, variables and addresses."""
    n = text("c_custkey")
    argv = F.array(lit("run"), lit("--api-key"), F.col("c_name"), F.concat(lit("NAME="), n), F.concat(lit("DB_PASSWORD=pw"), n), F.concat(lit("postgres://u"), n, lit(":p%20w@db/x?a=b")), lit("OWN_TOKEN=t"), lit("--verbose"))
    return table(spark, d, "customer").select("c_custkey", redaction.scrub_command(argv, "OWN_").alias("s")).select("c_custkey", "s.command", F.col("s.fingerprints.ref").alias("refs"))


_LOOKS_SECRET = r"\bsk-[A-Za-z0-9_-]{10,}\b"


@query("scrubbed_origins", r"""WITH p AS (SELECT page_id, page_id % 4 AS m, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN m = 2 THEN 'vendor.example' ELSE host END AS host, CASE m WHEN 0 THEN scheme || '://' || host || (CASE WHEN path = '' THEN '/' ELSE path END) WHEN 1 THEN scheme || '://' || host || ':8443/a/sha256:' || sha256('0123456789abcdefg') || '/sha256:' || sha256('a%20b') || '/x' WHEN 2 THEN 'https://vendor.example/v2' ELSE scheme || '://' || host || '/sha256:' || sha256('sk-abcdefghijkl') END AS url FROM p""")  # fmt: skip
def scrubbed_origins(spark, d):
    """Pages' addresses as they are, with ids in the path, behind a relay, or with a secret."""
    m = F.col("page_id") % 4
    scheme, host = F.regexp_extract("url", "^([a-z]+)://", 1), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    made = lambda *parts: F.concat(scheme, lit("://"), *parts)
    url = F.when(m == 1, made(lit("u:p@"), host, lit(":8443/a/0123456789abcdefg/a%20b/x?q=1"))).when(m == 2, made(host, lit("/relay?x=1&mcp_url=https%3A%2F%2Fu%40Vendor.example%3A443%2Fv2%3Fk%3Dv"))).when(m == 3, made(host, lit("/sk-abcdefghijkl#f"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", C.scrubbed_origin(url, _LOOKS_SECRET).alias("o")).select("page_id", "o.host", "o.url")


@query("hold_ends", """WITH h AS (SELECT o_orderkey AS approval_id, 's' || (o_custkey % 60) AS session_id, o_orderdate::TIMESTAMP + INTERVAL 60 DAY AS timeout_at, o_orderstatus FROM orders), x AS (SELECT l_orderkey, min(l_shipdate)::TIMESTAMP AS d FROM lineitem GROUP BY 1),
    s AS (SELECT 's' || (c_custkey % 60) AS session_id, TIMESTAMP '1994-01-01' + INTERVAL 1 DAY * min(c_custkey % 900) AS e FROM customer WHERE c_custkey % 60 < 30 GROUP BY 1)
    SELECT approval_id, CASE WHEN d < timeout_at AND (e IS NULL OR e > d) THEN CASE WHEN o_orderstatus = 'O' THEN 'denied' ELSE 'approved' END WHEN e < timeout_at AND (d IS NULL OR d >= timeout_at OR e < d) THEN 'session_end' WHEN d < timeout_at THEN CASE WHEN o_orderstatus = 'O' THEN 'denied' ELSE 'approved' END WHEN timeout_at <= TIMESTAMP '1997-01-01' THEN 'timeout' ELSE 'pending' END AS outcome
    FROM h LEFT JOIN x ON l_orderkey = approval_id LEFT JOIN s USING (session_id)""")  # fmt: skip
def hold_ends(spark, d):
    """Orders as holds that shipping decides, unless their session ends before."""
    o = table(spark, d, "orders")
    session = lambda c: F.concat(lit("s"), (F.col(c) % 60).cast("string")).alias("session_id")
    holds = o.select(F.col("o_orderkey").alias("approval_id"), session("o_custkey"), "o_orderstatus", F.expr("cast(o_orderdate as timestamp) + interval 60 days").alias("timeout_at"))
    decided = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("approval_id"), F.col("l_shipdate").cast("timestamp").alias("decided_at"))
    decided = decided.join(holds.select("approval_id", F.when(F.col("o_orderstatus") == "O", "denied").otherwise("approved").alias("decision")), "approval_id")
    ends = table(spark, d, "customer").where("c_custkey % 60 < 30").select(session("c_custkey"), F.expr("cast(date_add(date'1994-01-01', cast(c_custkey % 900 as int)) as timestamp)").alias("ended_at"))
    return replica.hold_outcomes(holds, decided, lit("1997-01-01").cast("timestamp"), ends)


@query("integrity_rollup", f"""{_TAMPERED}, l AS (SELECT *, lag(seq) OVER w AS s FROM t WINDOW w AS (PARTITION BY chain_id ORDER BY seq)), p AS (SELECT chain_id, count(*) FILTER (sha256(prev_hash || chr(10) || event) <> hash) + 2 * count(*) FILTER (seq - s > 1) + count(*) FILTER (s IS NULL AND prev_hash <> '{C.GENESIS_HASH}') AS problems FROM l GROUP BY 1),
    a AS (SELECT 't' || (substr(chain_id, 2)::INT % 3) AS tenant, chain_id, count(*) AS events, count(decision) AS decisions, count(DISTINCT session_id) AS sessions FROM e GROUP BY 1, 2), k AS (SELECT * FROM a LEFT JOIN p USING (chain_id))
    SELECT tenant, chain_id, sum(events)::BIGINT AS events, sum(decisions)::BIGINT AS decisions, sum(sessions)::BIGINT AS sessions, sum(problems)::BIGINT AS problems, min(problems = 0) AS ok, 0::BIGINT AS unverified, sum(decisions) = 0 AS no_decisions FROM k GROUP BY ROLLUP (tenant, chain_id)""")  # fmt: skip
def integrity_rollup(spark, d):
    """Activity and verdicts by tenant and chain."""
    records = _tampered(spark, d)
    e = audit_events(spark, d).withColumn("tenant", F.concat(lit("t"), (F.regexp_extract("chain_id", "[0-9]+", 0).cast("int") % 3).cast("string")))
    return sessions.integrity_rollup(e, integrity.verdicts(records, integrity.verify(records, order="seq")), "tenant")


@query("sealed_calls", f"""WITH q AS (SELECT event_id AS id, ts AS asked, CASE event_id % 3 WHEN 0 THEN 'tools/call' WHEN 1 THEN 'initialize' ELSE 'tools/list' END AS method FROM events WHERE event_id % 5 <> 4), r AS (SELECT event_id AS id, ts + INTERVAL 1 MILLISECOND * (event_id % 900) AS answered, event_id % 6 = 1 AS bad FROM events WHERE event_id % 7 <> 2)
    SELECT coalesce(q.id, r.id) AS id, CASE WHEN q.id IS NULL THEN 'protocol_error' WHEN method = 'tools/call' THEN 'tool_call' WHEN method = 'initialize' THEN 'initialize' ELSE 'rpc' END AS kind, CASE WHEN q.id IS NOT NULL THEN (epoch_us(answered) - epoch_us(asked)) / 1000 END AS duration_ms, q.id IS NULL OR r.id IS NULL OR bad AS is_error,
    CASE WHEN q.id IS NULL THEN 'orphan_response' WHEN r.id IS NULL THEN 'unanswered' END AS error_type, 'sha256:' || sha256(CASE WHEN q.id IS NULL OR r.id IS NULL THEN 'null' ELSE '{{"a":1,"n":' || r.id || '}}' END) AS result_hash FROM q FULL JOIN r ON q.id = r.id""")  # fmt: skip
def sealed_calls(spark, d):
    """Requests and responses as the records that are kept of them."""
    e, n = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    method = F.when(n % 3 == 0, "tools/call").when(n % 3 == 1, "initialize").otherwise("tools/list")
    requests = e.where("event_id % 5 <> 4").select(n.alias("id"), F.col("ts").alias("asked_at"), method.alias("method"))
    result = F.concat(lit('{"n": '), n.cast("string"), lit(', "a": 1}'))
    responses = e.where("event_id % 7 <> 2").select(n.alias("id"), F.timestamp_micros(F.unix_micros("ts") + 1000 * (n % 900)).alias("answered_at"), result.alias("result"), (n % 6 == 1).alias("is_error"))
    return correlate.sealed_calls(requests, responses, ["id"]).drop("occurrence")


@query("injection_regions", f"""WITH {AUDIT} SELECT event_id, CASE event_id % 6 WHEN 5 THEN [] ELSE [5] END AS start, CASE event_id % 6 WHEN 0 THEN [33] WHEN 1 THEN [34] WHEN 2 THEN [34] WHEN 3 THEN [42] WHEN 4 THEN [33] ELSE [] END AS "end" FROM e""")
def injection_regions(spark, d):
    """Markers in plain, hidden, accented, coloured and wide letters, at their places in the text as it is."""
    n = F.col("event_id") % 6
    forms = ["ignore previous instructions", "igno\u200bre previous instructions", "igno\u0301re previous instructions", "ig\x1b[31mnore\x1b[0m previous instructions", "\uff49\uff47\uff4e\uff4f\uff52\uff45 previous instructions", "note previous instructions"]
    said = F.element_at(F.array(*[lit(f"say: {t} {{}}") for t in forms]), (n + 1).cast("int"))
    e = audit_events(spark, d).select("event_id", F.replace(said, lit("{}"), text("event_id")).alias("t"))
    scanner = scan.Scanner()

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def regions(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": a, "end": b} for a, b in scanner.injection_spans(t)] if t else [] for t in texts.to_pylist()], kind)

    found = e.select("event_id", regions(F.coalesce(scanner.sieve(F.col("t"), False, True), lit(""))).alias("r"))
    return found.select("event_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))
