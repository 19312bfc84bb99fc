"""Registered queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators import capture, correlate, integrity, policy, redaction, replica, scan, search, sessions
from ..sources.adapters import AUDIT, CHAIN, audit_events, chain_events, spread, table
from ..sources.shared import dealt, shared_path, written
from ..streaming import stateful, streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CALL = "kind = 'tool_call' AND (phase IS NULL OR phase = 'pre')"
_SUMMARY = f"""SELECT session_id, min(ts) AS started_at, max(ts) AS last_event_at, count(*) AS events, count(*) FILTER ({_CALL}) AS tool_calls,
    count(*) FILTER (kind IN ('tool_call', 'rpc') AND is_error) AS errors, count(DISTINCT server) FILTER (kind = 'tool_call') AS servers,
    count(*) FILTER (kind = 'policy_decision' OR (kind = 'notification' AND gateway_decision IS NOT NULL) OR (kind = 'tool_call' AND phase = 'pre' AND error_type = 'policy_denied')) AS decisions,
    min_by(server, seq) AS first_server, min_by(identity, seq) AS identity, min(seq) AS first_seq FROM e GROUP BY session_id"""


@query("session_summary", f"WITH {AUDIT} {_SUMMARY}")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_summary(audit_events(spark, d)).drop("ended_at")


_ENDS = "SELECT session_id, max(ts) AS last_event_at, max(ts) FILTER (kind = 'policy_decision') AS ended_at FROM e GROUP BY session_id"


@query("session_end_state", f"WITH {AUDIT} SELECT session_id, CASE WHEN ended_at IS NULL THEN '(open)' WHEN last_event_at > ended_at THEN '(reopened)' ELSE 'ended' END AS state FROM ({_ENDS})")
def session_end_state(spark, d):
    ends = audit_events(spark, d).groupBy("session_id").agg(F.max("ts").alias("last_event_at"), F.max(F.when(F.col("kind") == "policy_decision", F.col("ts"))).alias("ended_at"))
    return ends.select("session_id", sessions.end_state(F.col("ended_at"), F.col("last_event_at")).alias("state"))


@query("session_prefix_resolve", f"""WITH {AUDIT}, s AS (SELECT DISTINCT session_id FROM e), p AS (SELECT DISTINCT left(session_id, 3) AS prefix FROM s UNION SELECT session_id FROM s WHERE right(session_id, 1) = '7'),
    m AS (SELECT prefix, count(session_id) AS n, min(session_id) AS one, coalesce(bool_or(session_id = prefix), false) AS exact FROM p LEFT JOIN s ON starts_with(session_id, prefix) GROUP BY prefix)
    SELECT prefix, CASE WHEN exact THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN exact THEN prefix WHEN n = 1 THEN one END AS session_id FROM m""")  # fmt: skip
def session_prefix_resolve(spark, d):
    ids = audit_events(spark, d).select("session_id").distinct()
    prefixes = ids.select(F.substring("session_id", 1, 3).alias("prefix")).union(ids.where(F.col("session_id").endswith("7")))
    return sessions.resolve_prefix(ids, prefixes)


@query("session_prefix_resolve_all", SQL["session_prefix_resolve"].replace(" WHERE right(session_id, 1) = '7'", ""))
def session_prefix_resolve_all(spark, d):
    """Every id and its first three characters."""
    ids = audit_events(spark, d).select("session_id").distinct()
    return sessions.resolve_prefix(ids, ids.select(F.substring("session_id", 1, 3).alias("prefix")).union(ids))


@query("tool_census", f"""WITH {AUDIT} SELECT coalesce(server, '') AS server, tool, count(*) FILTER ({_CALL}) AS calls, count(*) FILTER (is_error) AS errors, count(*) FILTER (coalesce(gateway_decision = 'deny', false) OR (phase = 'pre' AND error_type = 'policy_denied')) AS denied,
    count(*) FILTER (gateway_decision = 'hold') AS held, count(DISTINCT session_id) FILTER ({_CALL}) AS sessions, min(ts) AS first_seen, max(ts) AS last_seen FROM e WHERE kind = 'tool_call' GROUP BY 1, 2""")  # fmt: skip
def tool_census(spark, d):
    return sessions.tool_census(audit_events(spark, d))


_WHY = "SELECT session_id, seq, tool, decision AS what, rule_id FROM e WHERE decision IS NOT NULL UNION ALL SELECT session_id, seq, tool, 'filter:' || boundary_action, NULL FROM e WHERE kind = 'tool_call' AND boundary_action <> 'none' AND (secrets_found > 0 OR injection_found > 0)"


@query("why_latest", f"WITH {AUDIT} SELECT * FROM ({_WHY}) ORDER BY seq DESC LIMIT 50")
def why_latest(spark, d):
    return sessions.why(audit_events(spark, d), 50)


@query("why_per_session", f"WITH {AUDIT} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM ({_WHY})) WHERE n <= 3")
def why_per_session(spark, d):
    return sessions.why(audit_events(spark, d), 3, per_session=True)


@query("reason_enrichment", f"WITH {AUDIT}, p AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'old' ELSE 'new' END AS policy_hash FROM e WHERE decision IS NOT NULL) SELECT seq, rule_id, policy_hash, CASE WHEN policy_hash = 'new' AND rule_id IN ('rule_0', 'rule_1') THEN 'reason of ' || rule_id END AS reason FROM p")
def reason_enrichment(spark, d):
    decided = audit_events(spark, d).where("decision is not null").withColumn("policy_hash", F.when(F.col("k") % 3 == 0, "old").otherwise("new"))
    rules = spark.createDataFrame([("new", f"rule_{i}", f"reason of rule_{i}") for i in (0, 1)], "policy_hash string, rule_id string, reason string")
    return sessions.with_reasons(decided, rules).select("seq", "rule_id", "policy_hash", "reason")


@query("policy_name_asof", f"WITH {AUDIT} SELECT chain_id, seq, last_value(policy IGNORE NULLS) OVER (PARTITION BY chain_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS policy_now FROM e")
def policy_name_asof(spark, d):
    return sessions.as_of(audit_events(spark, d), "policy", "chain_id", "policy_now").select("chain_id", "seq", "policy_now")


@query("handshake_asof", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::INT AS client_now FROM conversations")
def handshake_asof(spark, d):
    turns = table(spark, d, "conversations").withColumn("seq", F.col("turn")).withColumn("client", F.when(F.col("role") == "user", F.length("text")))
    return sessions.as_of(turns, "client", "conv_id", "client_now").select("conv_id", "turn", "client_now")


@query("latency_quantiles", f"WITH {AUDIT} SELECT server, tool, quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99, count(duration_ms) AS calls FROM e WHERE kind = 'tool_call' GROUP BY 1, 2")
def latency_quantiles(spark, d):
    return sessions.latency_quantiles(audit_events(spark, d).where("kind = 'tool_call'"), ["server", "tool"])


@query("timeline_first_n", "SELECT conv_id, turn, role, n, truncated FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, count(*) OVER (PARTITION BY conv_id) > 3 AS truncated FROM conversations) WHERE n <= 3")
def timeline_first_n(spark, d):
    return sessions.timeline(table(spark, d, "conversations"), "conv_id", ["turn", "text"], 3).select("conv_id", "turn", "role", "n", "truncated")


@query("pending_holds", "SELECT o_orderkey AS approval_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate <= DATE '1997-01-01' THEN 'timeout' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'approved' END AS state FROM orders")
def pending_holds(spark, d):
    holds = table(spark, d, "orders").select(F.col("o_orderkey").alias("approval_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"), F.col("o_orderdate").cast("date").alias("timeout_at"))
    return sessions.pending_holds(holds, F.lit("1997-01-01").cast("date")).select("approval_id", "state")


@query("activity_rollup", f"WITH {AUDIT} SELECT server, chain_id, count(*) AS events, count(decision) AS decisions, count(DISTINCT session_id) AS sessions FROM e GROUP BY ROLLUP (server, chain_id)")
def activity_rollup(spark, d):
    return sessions.activity_rollup(audit_events(spark, d), "server", "chain_id")


_SEALED = f"""WITH RECURSIVE {CHAIN}, sealed AS (SELECT chain_id, seq, event_id, session_id, '{C.GENESIS_HASH}' AS prev_hash, sha256('{C.GENESIS_HASH}' || chr(10) || event) AS hash, event FROM ch WHERE seq = 1
    UNION ALL SELECT c.chain_id, c.seq, c.event_id, c.session_id, s.hash, sha256(s.hash || chr(10) || c.event), c.event FROM sealed s JOIN ch c ON c.chain_id = s.chain_id AND c.seq = s.seq + 1)"""


@query("seal_chain", f"{_SEALED} SELECT chain_id, seq, prev_hash, hash FROM sealed")
def seal_chain(spark, d):
    return integrity.seal(chain_events(spark, d)).drop("event")


def _tampered(spark, d) -> DataFrame:
    """A sealed copy with altered and missing records."""
    number = F.get_json_object("event", "$.event_id").cast("long")
    sealed = integrity.seal(chain_events(spark, d)).withColumn("event_id", number)
    changed = F.when(F.col("event_id") % 97 == 5, F.regexp_replace("event", '"tool":"tool_', '"tool":"told_')).otherwise(F.col("event"))
    return sealed.where("event_id % 211 <> 7").withColumn("event", changed)


_TAMPERED = _SEALED + ", t AS (SELECT chain_id, seq, prev_hash, hash, CASE WHEN event_id % 97 = 5 THEN replace(event, '\"tool\":\"tool_', '\"tool\":\"told_') ELSE event END AS event FROM sealed WHERE event_id % 211 <> 7)"


@query("verify_content", f"{_TAMPERED} SELECT chain_id, seq, 'hash_mismatch' AS problem FROM t WHERE sha256(prev_hash || chr(10) || event) <> hash")
def verify_content(spark, d):
    return integrity.content_problems(_tampered(spark, d))


@query("verify_links", f"""{_TAMPERED}, l AS (SELECT *, lag(seq) OVER w AS s, lag(hash) OVER w AS h FROM t WINDOW w AS (PARTITION BY chain_id ORDER BY seq)) SELECT chain_id, seq, unnest(['seq_gap', 'prev_hash_mismatch']) AS problem FROM l WHERE seq - s > 1
    UNION ALL SELECT chain_id, seq, 'bad_genesis' FROM l WHERE s IS NULL AND prev_hash <> '{C.GENESIS_HASH}'""")  # fmt: skip
def verify_links(spark, d):
    return integrity.link_problems(_tampered(spark, d), order="seq")


@query("chain_verdicts", f"""{_TAMPERED}, l AS (SELECT *, lag(seq) OVER w AS s FROM t WINDOW w AS (PARTITION BY chain_id ORDER BY seq)), p AS (SELECT chain_id, count(*) FILTER (sha256(prev_hash || chr(10) || event) <> hash) + 2 * count(*) FILTER (seq - s > 1) + count(*) FILTER (s IS NULL AND prev_hash <> '{C.GENESIS_HASH}') AS problems FROM l GROUP BY 1)
    SELECT chain_id, count(*) AS checked, max(seq) AS head_seq, max_by(hash, seq) AS head_hash, max(problems) AS problems, max(problems) = 0 AS ok FROM t JOIN p USING (chain_id) GROUP BY chain_id""")  # fmt: skip
def chain_verdicts(spark, d):
    records = _tampered(spark, d)
    return integrity.verdicts(records, integrity.verify(records, order="seq"))


@query("signature_window_pick", f"WITH {CHAIN}, s AS (SELECT chain_id, seq, event_id AS sig_id, floor((seq - 1) / 20)::BIGINT AS win FROM ch WHERE event_id % 3 = 0) SELECT chain_id, win AS \"window\", max(seq) AS seq, max_by(sig_id, seq) AS sig_id FROM s GROUP BY 1, 2")
def signature_window_pick(spark, d):
    signed = chain_events(spark, d).where("event_id % 3 = 0").select("chain_id", "seq", F.col("event_id").alias("sig_id"))
    return integrity.window_pick(signed, size=20).select("chain_id", "window", "seq", "sig_id")


@query("signature_problems", f"""{_TAMPERED}, g AS (SELECT chain_id, seq, hash AS chain_hash FROM sealed WHERE event_id % 3 = 0 UNION ALL SELECT chain_id, max(seq) + 1, '' FROM sealed GROUP BY 1), h AS (SELECT chain_id, max(seq) AS head FROM t GROUP BY 1)
    SELECT chain_id, seq, problem FROM (SELECT g.chain_id, g.seq, CASE WHEN g.seq > head THEN 'truncated_after_signature' WHEN t.seq IS NULL OR sha256(t.prev_hash || chr(10) || t.event) <> chain_hash THEN 'signature_chain_mismatch' END AS problem
    FROM g JOIN h USING (chain_id) LEFT JOIN t ON t.chain_id = g.chain_id AND t.seq = g.seq) WHERE problem IS NOT NULL""")  # fmt: skip
def signature_problems(spark, d):
    sealed = integrity.seal(chain_events(spark, d))
    signed = sealed.where(F.get_json_object("event", "$.event_id").cast("long") % 3 == 0).select("chain_id", "seq", F.col("hash").alias("chain_hash"))
    beyond = sealed.groupBy("chain_id").agg((F.max("seq") + 1).alias("seq")).select("chain_id", "seq", F.lit("").alias("chain_hash"))
    return integrity.signature_problems(signed.unionByName(beyond), _tampered(spark, d))


@query("bundle_range", f"""{_SEALED}, o AS (SELECT chain_id, session_id, min(seq) AS from_seq, max(seq) AS to_seq FROM sealed WHERE right(session_id, 1) = '3' GROUP BY 1, 2)
    SELECT o.*, count(*) AS event_count, min_by(s.prev_hash, s.seq) AS base_hash, max_by(s.hash, s.seq) AS head_hash FROM o JOIN sealed s ON s.chain_id = o.chain_id AND s.seq BETWEEN from_seq AND to_seq GROUP BY ALL""")  # fmt: skip
def bundle_range(spark, d):
    events = chain_events(spark, d)
    records = integrity.seal(events).withColumn("session_id", F.get_json_object("event", "$.session_id"))
    return integrity.bundle_range(records, records.where(F.col("session_id").endswith("3")).select("session_id"))


@query("bundle_range_all", SQL["bundle_range"].replace(" WHERE right(session_id, 1) = '3'", ""))
def bundle_range_all(spark, d):
    """The ranges of all sessions."""
    records = integrity.seal(chain_events(spark, d)).withColumn("session_id", F.get_json_object("event", "$.session_id"))
    return integrity.bundle_range(records, records.select("session_id"))


@query("dedupe_collision", f"WITH {AUDIT}, x AS (SELECT event_id, args FROM e UNION ALL SELECT event_id, CASE WHEN k % 2 = 0 THEN args ELSE args || ' ' END FROM e WHERE k % 7 = 0) SELECT event_id, count(*) AS seen, count(DISTINCT args) AS contents, CASE WHEN count(DISTINCT args) > 1 THEN 'collision' ELSE 'skip' END AS verdict FROM x GROUP BY 1 HAVING count(*) > 1")
def dedupe_collision(spark, d):
    e = audit_events(spark, d)
    again = e.where("k % 7 = 0").select("event_id", F.when(F.col("k") % 2 == 0, F.col("args")).otherwise(F.concat("args", F.lit(" "))).alias("args"))
    return integrity.collisions(e.select("event_id", "args").unionByName(again), "event_id", "args")


_REF = "'sha256:' || sha256({})"


@query("blast_radius", f"""WITH {AUDIT}, n AS (SELECT DISTINCT needle FROM (SELECT args AS needle FROM e WHERE event_id % 50 = 1 UNION ALL SELECT upper(tool) FROM e WHERE k < 2)),
    f AS (SELECT needle, event_id, session_id, 3 AS rank, '$.args' AS path, 'args_hash' AS matched_on FROM n JOIN e ON {_REF.format('needle')} = {_REF.format('args')} UNION ALL SELECT needle, event_id, session_id, 5, '$.tool', 'name' FROM n JOIN e ON lower(needle) = tool)
    SELECT needle, event_id, session_id, min_by(matched_on, rank) AS matched_on, min_by(path, rank) AS path FROM f GROUP BY 1, 2, 3""")  # fmt: skip
def blast_radius(spark, d):
    return search.touched(*_needles(spark, d))


def _needles(spark, d) -> tuple[DataFrame, DataFrame]:
    e = audit_events(spark, d)
    needles = e.where("event_id % 50 = 1").select(F.col("args").alias("needle")).union(e.where("k < 2").select(F.upper("tool")))
    return needles, search.index(e.withColumn("args_ref", C.ref(F.col("args"))), {"$.args": ("args_hash", "args_ref")}, {"$.tool": "tool"})


@query("touched_sessions", f"""WITH {AUDIT}, n AS (SELECT DISTINCT args AS needle FROM e WHERE event_id % 50 = 1 UNION SELECT DISTINCT upper(tool) FROM e WHERE k < 2), s AS ({_SUMMARY})
    SELECT session_id, started_at, events FROM s WHERE session_id IN (SELECT session_id FROM e JOIN n ON needle = args OR lower(needle) = tool)""")  # fmt: skip
def touched_sessions(spark, d):
    matches = search.touched(*_needles(spark, d))
    return search.touched_sessions(session_summary(spark, d), matches).select("session_id", "started_at", "events")


RULES = [
    policy.Rule("deny", server=("server_1", "server_2"), tool=("tool_[!x]*", "tool_3"), rule_id="no_tool_3", reason="not allowed"),
    policy.Rule("deny", args={"$.note": "server"}, rule_id="objects_never_match"),
    policy.Rule("hold", tool=("tool_*",), args={"$.k": r"^[0-9]$"}, rule_id="one_digit"),
    policy.Rule("deny", any_arg=r"^u9\d?$|^server_4 9\d$", rule_id="nineties"),
    policy.Rule("hold", server=("server_0",), max_bytes=59),
]
_ARGS = """'{"k":' || k || ',"to":["u' || user_id || '","' || tool || '"],"note":{"n":"' || server || ' ' || k || '"}}'"""
_EVALUATED = f"""c AS (SELECT * EXCLUDE args, {_ARGS} AS args, regexp_matches('u' || user_id, '^u9\\d?$|^server_4 9\\d$') OR regexp_matches(server || ' ' || k, '^u9\\d?$|^server_4 9\\d$') AS nineties FROM e),
    v AS (SELECT event_id, server, tool, CASE WHEN server IN ('server_1', 'server_2') AND tool = 'tool_3' THEN 'deny' WHEN regexp_matches(k::VARCHAR, '^[0-9]$') THEN 'hold' WHEN nineties THEN 'deny' WHEN server = 'server_0' AND strlen(args) <= 59 THEN 'hold' ELSE 'allow' END AS action,
    CASE WHEN server IN ('server_1', 'server_2') AND tool = 'tool_3' THEN 'no_tool_3' WHEN regexp_matches(k::VARCHAR, '^[0-9]$') THEN 'one_digit' WHEN nineties THEN 'nineties' WHEN server = 'server_0' AND strlen(args) <= 59 THEN 'rule[4]' END AS rule FROM c)""".replace("\\\\d", "\\d")


def _calls(spark, d) -> DataFrame:
    """Events with nested arguments."""
    lit, text = F.lit, lambda c: F.col(c).cast("string")
    args = F.concat(lit('{"k":'), text("k"), lit(',"to":["u'), text("user_id"), lit('","'), "tool", lit('"],"note":{"n":"'), "server", lit(" "), text("k"), lit('"}}'))
    return spread(audit_events(spark, d).withColumn("args", args), "event_id")


@query("policy_first_match", f"WITH {AUDIT}, {_EVALUATED} SELECT event_id, action, rule, false AS fail_closed FROM v")
def policy_first_match(spark, d):
    return policy.evaluate(_calls(spark, d), RULES).select("event_id", "action", "rule", "fail_closed")


@query("policy_starter", f"WITH {AUDIT} SELECT event_id, CASE WHEN k % 7 = 1 THEN 'deny' WHEN k % 7 IN (2, 3) THEN 'hold' ELSE 'allow' END AS action, CASE k % 7 WHEN 1 THEN 'credential-files' WHEN 2 THEN 'destructive-tools' WHEN 3 THEN 'spends-money' END AS rule FROM e")
def policy_starter(spark, d):
    """The rules to start from, over calls of seven kinds."""
    kind = F.col("k") % 7
    tool = F.when(kind == 2, "db_delete_rows").when(kind == 3, "issue_refund").otherwise(F.lit("read_file"))
    args = F.when(kind == 1, F.lit('{"paths":["a.txt",{"p":"/home/u/.ssh/config"}]}')).when(kind == 4, F.lit('{".env":1,"note":"x .env y"}')).otherwise(F.lit('{"path":"/tmp/notes.txt"}'))
    rules, default = policy.rules_of(policy.STARTER_DOCUMENT)
    return policy.evaluate(audit_events(spark, d).withColumn("tool", tool).withColumn("args", args), rules, default).select("event_id", "action", "rule")


@query("policy_coverage", f"WITH {AUDIT}, {_EVALUATED} SELECT server, count(*) FILTER (action = 'deny') AS denied, count(*) FILTER (action = 'hold') AS held, count(*) FILTER (action = 'allow') AS allowed, CASE WHEN count(*) FILTER (action <> 'allow') = 0 THEN 'FAIL' ELSE 'ok' END AS verdict FROM v GROUP BY 1")
def policy_coverage(spark, d):
    return policy.coverage(policy.evaluate(_calls(spark, d), RULES))


@query("policy_diff", f"WITH {AUDIT}, {_EVALUATED} SELECT v.event_id, v.action AS before, 'allow' AS after FROM v WHERE v.action <> 'allow' AND v.rule <> 'no_tool_3' UNION ALL SELECT event_id, 'deny', 'allow' FROM v WHERE rule = 'no_tool_3' AND server = 'server_2'")
def policy_diff(spark, d):
    e = _calls(spark, d)
    looser = [policy.Rule("deny", server=("server_1",), tool=("tool_3",))]
    return policy.compare(policy.evaluate(e, RULES), policy.evaluate(e, looser), "event_id")


@query("glob_match", "SELECT p_partkey, regexp_matches(p_name, '^[^ ]* [^ ]*$') AS two_words, regexp_matches(p_name, '^.*e$') AS ends_in_e FROM part")
def glob_match(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", policy.matches_any(name, ("* *",), " ").alias("two_words"), policy.matches_any(name, ("**e",), " ").alias("ends_in_e"))


@query("hook_policy", f"WITH {AUDIT} SELECT event_id, CASE WHEN regexp_matches(tool, '_[45]$') OR regexp_matches(server, '_4$') THEN 'deny' WHEN regexp_matches(tool, '_[0-7]$') THEN 'allow' ELSE 'ask' END AS action FROM e")
def hook_policy(spark, d):
    e = audit_events(spark, d)
    return e.select("event_id", policy.hook(F.col("tool"), [r"_[45]$", r"^server_4$"], [r"_[0-7]$"], "ask", alias=F.col("server")).alias("action"))


@query("spelling_drift", f"""WITH {AUDIT}, t AS (SELECT DISTINCT server, tool FROM e), n AS (SELECT server, tool, unnest([tool, 'mcp__' || server || '__' || tool, 'mcp__' || upper(left(server, 1)) || substr(server, 2) || '__' || tool, server || '.' || tool]) AS name FROM t),
    p AS (SELECT unnest(['^mcp__server_1', 'tool_[0-4]$', '^tool_']) AS pattern) SELECT pattern, server, tool, count(*) FILTER (regexp_matches(name, pattern)) AS matched, count(*) FILTER (NOT regexp_matches(name, pattern)) AS missed FROM n, p GROUP BY ALL HAVING count(*) FILTER (regexp_matches(name, pattern)) > 0 AND count(*) FILTER (NOT regexp_matches(name, pattern)) > 0""")  # fmt: skip
def spelling_drift(spark, d):
    return policy.drift(audit_events(spark, d).select("server", "tool").distinct(), ["^mcp__server_1", "tool_[0-4]$", "^tool_"])


_URLS = r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path, strlen(coalesce(html, '')) AS body_bytes FROM pages"


def _requests(spark, d) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), F.when(path != "", path).otherwise("/").alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).alias("body_bytes"))


@query("egress_decisions", rf"SELECT page_id, CASE WHEN regexp_matches(host, '^[^.]*\.example\.com$') AND method = 'GET' AND regexp_matches(path, '^/[^/]*$') THEN 'allow' WHEN regexp_matches(host, '^.*\.(org|net|com)$') AND body_bytes <= 3000 THEN 'hold' ELSE 'deny' END AS action FROM ({_URLS})")
def egress_decisions(spark, d):
    rules = [{"host": ["*.example.com"], "methods": ["GET"], "path": ["/*"], "action": "allow"}, {"host": ["**.org", "**.net", "**.com"], "max_body_bytes": 3000, "action": "hold"}]
    return policy.egress(_requests(spark, d), rules).select("page_id", "action")


@query("destination_rules", rf"""SELECT page_id, reason IS NULL AS allowed, reason FROM (SELECT page_id, CASE WHEN method = 'GET' AND regexp_matches(host, '^[^.]*\.example\.com$') THEN NULL WHEN NOT regexp_matches(host, '^.*\.(org|com)$') THEN 'host_not_permitted' WHEN NOT regexp_matches(path, '^/[^/]*/.*$') THEN 'path_not_permitted' END AS reason FROM ({_URLS}))""")
def destination_rules(spark, d):
    rules = [{"method": ["GET"], "host": ["*.example.com"]}, {"host": ["**.org", "**.com"], "path": ["/*/**"]}]
    return policy.destinations(_requests(spark, d), rules).select("page_id", "allowed", "reason")


_COUNTS = lambda families, text: ", ".join(f"len(regexp_extract_all(coalesce({text}, ''), '{p.replace(chr(39), chr(39) * 2)}'))::INT AS {scan.column_name(n)}" for n, p in families.items())


@query("secret_family_counts", f"SELECT doc_id, {_COUNTS(scan.SECRET_FAMILIES, 'text')} FROM documents")
def secret_family_counts(spark, d):
    return scan.family_counts(spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id"), "text", scan.SECRET_FAMILIES).drop("text")


@query("secret_context_counts")
def secret_context_counts(spark, d):
    return scan.family_counts(spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id"), "text", scan.CONTEXT_FAMILIES).drop("text")


@query("secret_redaction")
def secret_redaction(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", scan.redact_with_refs(F.col("text"), scan.ALL_SECRETS).alias("text"))


@query("injection_counts", f"SELECT page_id, {_COUNTS(scan.INJECTION_FAMILIES, 'html')} FROM pages")
def injection_counts(spark, d):
    return scan.family_counts(spread(table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")), "page_id"), "html", scan.INJECTION_FAMILIES).drop("html")


@query("secret_token_refs", " UNION ".join(f"SELECT page_id, '{n}' AS family, {_REF.format('t')} AS ref FROM (SELECT page_id, unnest(regexp_extract_all(html, '{p.replace(chr(39), chr(39) * 2)}')) AS t FROM pages)" for n, p in scan.SECRET_FAMILIES.items()))
def secret_token_refs(spark, d):
    """References of the families that any engine can match; secret_spans has all of them."""
    return scan.token_refs(table(spark, d, "pages"), "page_id", "html", scan.SECRET_FAMILIES)


@query("secret_spans")
def secret_spans(spark, d):
    """All families' matches that are neither code nor placeholders, at their places."""
    spans = F.explode(scan.span_columns(F.col("html"))).alias("s")
    return spread(table(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", "html", spans).select("page_id", "s.*", C.ref(F.substring("html", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("ref"))


_SUM = lambda families: " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}'))" for p in families.values())


@query("boundary_verdict", f"SELECT conv_id, s AS secrets_found, i AS injection_found, false AS oversize, CASE WHEN s > 0 THEN 'redact' WHEN i > 0 THEN 'flag' ELSE 'none' END AS action FROM (SELECT conv_id, sum({_SUM(scan.SECRET_FAMILIES)})::BIGINT AS s, sum({_SUM(scan.INJECTION_FAMILIES)})::BIGINT AS i FROM conversations GROUP BY 1)")
def boundary_verdict(spark, d):
    return scan.verdict(spread(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn"), "conv_id", "text").drop("secret_refs")


@query("boundary_redaction")
def boundary_redaction(spark, d):
    """Pages with their secrets and injections replaced."""
    return spread(table(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", scan.redact(F.col("html"), injections=True).alias("html"))


@query("merge_spans", f"""WITH {AUDIT}, s AS (SELECT session_id, k AS start, k + 3 + k % 5 AS "end" FROM e), m AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY start NULLS FIRST, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
    f AS (SELECT *, CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END AS new FROM m), i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY start NULLS FIRST, "end" DESC, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT session_id, min(start) AS start, max("end") AS "end", count(*) AS spans FROM i GROUP BY session_id, island""")  # fmt: skip
def merge_spans(spark, d):
    spans = audit_events(spark, d).select("session_id", F.col("k").alias("start"), (F.col("k") + 3 + F.col("k") % 5).alias("end"))
    return scan.merge_spans(spans, "session_id")


@query("value_ref", f"SELECT doc_id, {_REF.format('text')} AS ref FROM documents")
def value_ref(spark, d):
    return table(spark, d, "documents").select("doc_id", C.ref(F.col("text")).alias("ref"))


@query("structural_cap", f"SELECT p_partkey, CASE WHEN length(p_brand) <= 128 AND regexp_matches(p_brand, '^[A-Za-z][A-Za-z0-9_./:-]*$') THEN p_brand ELSE {_REF.format('p_brand')} END AS brand, CASE WHEN regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9_./:-]*$') THEN p_name ELSE {_REF.format('p_name')} END AS name FROM part")
def structural_cap(spark, d):
    return table(spark, d, "part").select("p_partkey", C.structural(F.col("p_brand"), "identifier").alias("brand"), C.structural(F.col("p_name"), "identifier").alias("name"))


@query("canonical_args", f"WITH {AUDIT} SELECT event_id, '{{\"k\":' || k || '}}' AS canon, {_REF.format(chr(39) + '{' + chr(34) + 'k' + chr(34) + ':' + chr(39) + ' || k || ' + chr(39) + '}' + chr(39))} AS args_hash FROM e")
def canonical_args(spark, d):
    return audit_events(spark, d).select("event_id", C.canonical(F.col("args")).alias("canon")).withColumn("args_hash", C.ref(F.col("canon")))


@query("identity_fingerprints", f"SELECT c_custkey, {_REF.format('c_name || chr(0) || c_custkey || chr(0)')} AS fingerprint FROM customer")
def identity_fingerprints(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.identity_fingerprint(F.col("c_name"), F.col("c_custkey"), F.lit(None)).alias("fingerprint"))


@query("origin_url_scrub")
def origin_url_scrub(spark, d):
    return table(spark, d, "pages").select("page_id", C.origin_url(F.col("url"), ["mcp", "sse", "api", "v1"]).alias("origin"))


@query("request_response", """WITH q AS (SELECT o_custkey AS k, o_orderkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), r AS (SELECT s_nationkey AS k, s_suppkey AS r, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
    SELECT coalesce(q.k, r.k) AS key, coalesce(q.n, r.n) AS occurrence, q AS request, r AS response, CASE WHEN q IS NOT NULL AND r IS NOT NULL THEN 'answered' WHEN q IS NOT NULL THEN 'unanswered' ELSE 'orphan_response' END AS status FROM q FULL JOIN r ON q.k = r.k AND q.n = r.n""")  # fmt: skip
def request_response(spark, d):
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("request"))
    r = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("key"), F.col("s_suppkey").alias("response"))
    return correlate.request_response(q, r, ["key"], "request", "response").select("key", "occurrence", "request", "response", "status")


@query("reconcile", """WITH o AS (SELECT l_orderkey AS k, max_by(l_linestatus, l_linenumber * 10 + (l_linestatus = 'O')::INT) AS outcome FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1), q AS (SELECT o_orderkey AS k, o_orderstatus AS decision FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT coalesce(q.k, o.k) AS action_id, decision, outcome, CASE WHEN outcome IS NULL THEN 'missing_outcome' WHEN decision IS NULL THEN 'unexpected_outcome' ELSE 'settled' END AS state FROM q FULL JOIN o ON q.k = o.k""")  # fmt: skip
def reconcile(spark, d):
    decided = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("action_id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("seq"))
    done = table(spark, d, "lineitem").where("l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("action_id"), F.col("l_linestatus").alias("status"), (F.col("l_linenumber") * 10 + (F.col("l_linestatus") == "O").cast("int")).alias("seq"))
    return correlate.reconcile(decided, done, ["action_id"], "seq")


@query("pre_post_pairs", f"""WITH {AUDIT}, x AS (SELECT * FROM e WHERE phase IS NOT NULL), y AS (SELECT user_id, seq, phase, min(seq) FILTER (phase = 'post') OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS post_seq FROM x) SELECT user_id, seq, post_seq FROM y WHERE phase = 'pre'""")
def pre_post_pairs(spark, d):
    return correlate.pre_post(audit_events(spark, d), ["user_id"]).drop("seconds")


@query("outcome_classes", f"WITH {AUDIT} SELECT CASE WHEN decision = 'deny' THEN 'denied' WHEN phase = 'pre' THEN 'unknown' WHEN is_error THEN 'error' ELSE 'success' END AS outcome, count(*) AS n FROM e GROUP BY 1")
def outcome_classes(spark, d):
    e = audit_events(spark, d)
    kind = correlate.outcome(F.coalesce(F.col("decision") == "deny", F.lit(False)), F.coalesce(F.col("phase") != "pre", F.lit(True)), F.col("is_error"))
    return e.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query("first_session_claim", f"WITH {AUDIT} SELECT session_id, min(seq) AS seq, min_by(event_id, seq) AS event_id, min_by(ts, seq) AS ts FROM e GROUP BY 1")
def first_session_claim(spark, d):
    return correlate.first_claim(audit_events(spark, d))


@query("silence_gaps", f"WITH {AUDIT}, g AS (SELECT chain_id, ts AS silent_from, lead(ts) OVER (PARTITION BY chain_id ORDER BY ts) AS silent_until FROM (SELECT DISTINCT chain_id, ts FROM e)) SELECT * FROM g WHERE epoch_us(silent_until) - epoch_us(silent_from) >= 21600000000")
def silence_gaps(spark, d):
    return replica.silence(audit_events(spark, d).select("chain_id", F.col("ts").alias("received_at")).distinct(), 6 * 3600)


@query("fork_compare", f"{_SEALED} SELECT chain_id, seq, sha256(hash) AS offered_hash, hash AS stored_hash FROM sealed WHERE event_id % 89 = 3")
def fork_compare(spark, d):
    stored = integrity.seal(chain_events(spark, d))
    number = F.get_json_object("event", "$.event_id").cast("long")
    offered = stored.withColumn("hash", F.when(number % 89 == 3, F.sha2("hash", 256)).otherwise(F.col("hash")))
    return replica.forks(stored, offered)


_GAPPED = f"WITH {CHAIN}, g AS (SELECT chain_id, seq FROM ch WHERE event_id % 311 <> 5)"


@query("lag_by_chain", f"{_GAPPED}, s AS (SELECT chain_id, max(seq) AS contiguous FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS n FROM g) WHERE n = seq GROUP BY 1) SELECT c.chain_id, max(c.seq) AS claimed, max(c.seq) - coalesce(max(contiguous), 0) AS lag FROM ch c LEFT JOIN s USING (chain_id) GROUP BY 1")
def lag_by_chain(spark, d):
    all_ = chain_events(spark, d)
    state = replica.chain_state(all_.where("event_id % 311 <> 5").withColumn("received_at", F.col("seq")))
    return replica.lag(all_.select("chain_id", F.col("seq").alias("claimed")), state)


@query("delivery_batches", f"{_GAPPED}, c AS (SELECT *, seq - row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS run FROM g), b AS (SELECT *, floor((row_number() OVER (PARTITION BY chain_id, run ORDER BY seq) - 1) / 16) AS part FROM c) SELECT chain_id, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS records FROM b GROUP BY chain_id, run, part")
def delivery_batches(spark, d):
    return replica.delivery_batches(chain_events(spark, d).where("event_id % 311 <> 5").withColumn("size", F.lit(40)), 16).drop("bytes")


@query("admission", f"""WITH RECURSIVE {AUDIT}, n AS (SELECT session_id, k, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM e),
    r AS (SELECT session_id, n, CASE WHEN k <= 120 THEN k ELSE 0 END AS held, k <= 120 AS a FROM n WHERE n = 1 UNION ALL SELECT n.session_id, n.n, r.held + CASE WHEN r.held + k <= 120 THEN k ELSE 0 END, r.held + k <= 120 FROM r JOIN n ON n.session_id = r.session_id AND n.n = r.n + 1)
    SELECT session_id, count(*) FILTER (a) AS kept, count(*) FILTER (NOT a) AS dropped_at_least FROM r GROUP BY 1""")  # fmt: skip
def admission(spark, d):
    return replica.admitted(audit_events(spark, d), "session_id", "seq", "k", 120)


_EVENTS = """j AS (SELECT event_id, session_id, kind, tool, server, k, user_id, 'sha256:' || sha256(k::VARCHAR) AS k_ref, '{"kind":"' || kind || '","tool":"' || tool || '","server":{"name":"' || server || '"},"identity":{"credential_fingerprints":[{"name":"T","ref":"sha256:' || sha256('who' || (user_id % 3)) || '"}]},"arguments":{"k":{"redacted":true,"ref":"sha256:' || sha256(k::VARCHAR) || '","len":2}},"note":"user u' || user_id || ' asks"}' AS event FROM e)"""


def _json_events(spark, d) -> DataFrame:
    lit, text = F.lit, lambda c: F.col(c).cast("string")
    parts = [lit('{"kind":"'), "kind", lit('","tool":"'), "tool", lit('","server":{"name":"'), "server", lit('"},"identity":{"credential_fingerprints":[{"name":"T","ref":"'), C.ref(F.concat(lit("who"), F.pmod("user_id", lit(3)).cast("string"))), lit('"}]},"arguments":{"k":{"redacted":true,"ref":"'), C.ref(text("k")), lit('","len":2}},"note":"user u'), text("user_id"), lit(' asks"}')]
    return spread(audit_events(spark, d).select("event_id", "session_id", "k", "user_id", F.concat(*parts).alias("event")), "event_id")


@query("event_blast_radius", f"""WITH {AUDIT}, {_EVENTS}, n AS (SELECT DISTINCT needle FROM (SELECT k::VARCHAR AS needle FROM e WHERE k < 20 UNION ALL SELECT 'ser u' || user_id || ' ' FROM e WHERE user_id % 10 = 3 UNION ALL SELECT 'SERVER_1' UNION ALL SELECT 'who2' UNION ALL SELECT '' UNION ALL SELECT 'u')),
    f AS (SELECT needle, event_id, session_id, 1 AS rank, '$.arguments.k' AS path, 'ref' AS matched_on FROM n JOIN j ON k_ref = 'sha256:' || sha256(needle)
    UNION ALL SELECT needle, event_id, session_id, 4, '$.identity.credential_fingerprints[0].ref', 'credential' FROM n JOIN j ON needle = 'who' || (user_id % 3)
    UNION ALL SELECT needle, event_id, session_id, 5, CASE WHEN kind IN ('tool_call', 'policy_decision') AND lower(needle) = tool THEN '$.tool' ELSE '$.server.name' END, 'name' FROM n JOIN j ON needle <> '' AND ((kind IN ('tool_call', 'policy_decision') AND lower(needle) = tool) OR lower(needle) = server)
    UNION ALL SELECT needle, event_id, session_id, 6, p, 'plain' FROM (SELECT needle, event_id, session_id, CASE WHEN contains(kind, needle) THEN '$.kind' WHEN contains(tool, needle) THEN '$.tool' WHEN contains(server, needle) THEN '$.server.name' WHEN contains('T', needle) THEN '$.identity.credential_fingerprints[0].name' WHEN contains('sha256:' || sha256('who' || (user_id % 3)), needle) THEN '$.identity.credential_fingerprints[0].ref' WHEN contains('user u' || user_id || ' asks', needle) THEN '$.note' END AS p FROM n, j WHERE needle <> '') WHERE p IS NOT NULL)
    SELECT needle, event_id, session_id, min_by(matched_on, rank) AS matched_on, min_by(path, rank) AS path FROM f GROUP BY 1, 2, 3""")  # fmt: skip
def event_blast_radius(spark, d):
    """All classes of matches in JSON events: references, credentials, names and plain texts."""
    e = _json_events(spark, d)
    needles = [e.where("k < 20").select(F.col("k").cast("string").alias("needle")), e.where("user_id % 10 = 3").select(F.concat(F.lit("ser u"), F.col("user_id").cast("string"), F.lit(" "))), spark.createDataFrame([("SERVER_1",), ("who2",), ("",), ("u",)], "needle string")]
    return search.touched(needles[0].union(needles[1]).union(needles[2]), written(search.event_index(e), "index"))


@query("hold_outcomes", """SELECT o_orderkey AS approval_id, CASE WHEN d < o_orderdate + INTERVAL 60 DAY THEN CASE WHEN o_orderstatus = 'O' THEN 'denied' ELSE 'approved' END WHEN o_orderdate + INTERVAL 60 DAY <= DATE '1997-01-01' THEN 'timeout' ELSE 'pending' END AS outcome
    FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")  # fmt: skip
def hold_outcomes(spark, d):
    """Orders as holds that their line items decide by shipping."""
    holds = table(spark, d, "orders").select(F.col("o_orderkey").alias("approval_id"), "o_orderstatus", F.expr("cast(o_orderdate as timestamp) + interval 60 days").alias("timeout_at"))
    decided = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("approval_id"), F.col("l_shipdate").cast("timestamp").alias("decided_at"))
    decided = decided.join(holds.select("approval_id", F.when(F.col("o_orderstatus") == "O", "denied").otherwise("approved").alias("decision")), "approval_id")
    return replica.hold_outcomes(holds.select("approval_id", "timeout_at"), decided, F.lit("1997-01-01").cast("timestamp"))


@query("enrolment", """WITH k AS (SELECT o_orderpriority AS tenant, 'key' || (o_custkey % 7) AS key, 'chain' || (o_orderkey % 3) AS chain_id, min(o_orderkey) AS first_seen FROM orders GROUP BY 1, 2, 3),
    n AS (SELECT tenant, key, row_number() OVER (PARTITION BY tenant ORDER BY min(first_seen), key) AS n FROM k GROUP BY 1, 2)
    SELECT tenant, key, chain_id, first_seen, row_number() OVER (PARTITION BY tenant, key ORDER BY first_seen, chain_id) > 1 AS sibling, n = 1 OR key = 'key5' AS trusted FROM k JOIN n USING (tenant, key)""")  # fmt: skip
def enrolment(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderpriority").alias("tenant"), F.concat(F.lit("key"), F.pmod("o_custkey", F.lit(7)).cast("string")).alias("key"), F.concat(F.lit("chain"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("chain_id"), F.col("o_orderkey").alias("first_seen"))
    return replica.enrolment(keys, keys.where("key = 'key5'").select("tenant", "key").distinct())


@query("delivery_status", """SELECT 'c' || (o_custkey % 50) AS chain_id, max_by(o_orderkey, o_orderkey) AS local_head, max_by(o_orderkey - o_custkey % 9, o_orderkey) AS next_seq, max_by(o_orderstatus, o_orderkey) AS state, max_by(o_clerk, o_orderkey) AS last_error, greatest(0, max_by(o_custkey % 9, o_orderkey) + 1) AS lag FROM (SELECT *, o_orderpriority AS o_clerk FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders)) GROUP BY 1""")
def delivery_status(spark, d):
    o = table(spark, d, "orders")
    behind = F.pmod("o_custkey", F.lit(9))
    return replica.delivery_status(o.select(F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("chain_id"), F.col("o_orderkey").alias("local_head"), (F.col("o_orderkey") - behind).alias("next_seq"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("last_error"), F.col("o_orderkey").alias("updated_at")))


@query("reconciliation", """WITH x AS (SELECT l_orderkey::VARCHAR AS action_id, l_linenumber::VARCHAR AS attempt_id, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)
    SELECT 'missing_outcome' AS list, action_id || ':d:' || attempt_id AS event_id, action_id, attempt_id FROM x WHERE p % 4 <> 0 AND s % 3 = 0 UNION ALL SELECT 'unknown_outcome', action_id || ':o:' || attempt_id, action_id, attempt_id FROM x WHERE s % 3 <> 0 AND p % 5 = 1
    UNION ALL SELECT 'missing_companion', action_id || ':o:' || attempt_id, action_id, attempt_id FROM x WHERE s % 3 = 1 AND p % 7 = 2 UNION ALL SELECT 'legacy', action_id || ':p:' || attempt_id, NULL, NULL FROM x WHERE p % 11 = 3""")  # fmt: skip
def reconciliation(spark, d):
    """Line items as attempts: a decision each, outcomes for two of three, some without their record."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("action_id"), F.col("l_linenumber").cast("string").alias("attempt_id")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    id_ = lambda mark: F.concat("action_id", F.lit(f":{mark}:"), "attempt_id").alias("event_id")
    null = lambda c: F.lit(None).cast("string").alias(c)
    ids = ("action_id", "attempt_id")
    base = lambda kind, phase, seq: (F.lit(kind).alias("kind"), F.lit(phase).cast("string").alias("phase"), F.lit(seq).alias("seq"), null("gateway_decision"))
    decisions = x.select(id_("d"), *base("action_lifecycle", "decision", 1), F.when(F.col("p") % 4 == 0, "deny").otherwise("allow").alias("decision"), null("outcome"), *ids, null("record_event_id"))
    record = F.when(F.col("s") % 3 == 1, F.when(F.col("p") % 7 == 2, F.lit("lost")).otherwise(F.concat("action_id", F.lit(":p:"), "attempt_id")))
    outcomes = x.where("s % 3 <> 0").select(id_("o"), *base("action_lifecycle", "outcome", 2), null("decision"), F.when(F.col("p") % 5 == 1, "unknown").otherwise("success").alias("outcome"), *ids, record.alias("record_event_id"))
    legacy = F.when(F.col("p") % 11 != 3, F.col("action_id"))
    records = x.select(id_("p"), *base("policy_decision", None, 0), null("decision"), null("outcome"), legacy.alias("action_id"), F.when(legacy.isNotNull(), F.col("attempt_id")).alias("attempt_id"), null("record_event_id"))
    return correlate.reconciliation(decisions.unionByName(outcomes).unionByName(records))


@query("tree_scrub")
def tree_scrub(spark, d):
    """JSON events with everything but known vocabulary replaced by references."""
    e = _json_events(spark, d)
    return e.select("event_id", redaction.scrub(F.col("event")).alias("event"), redaction.scrub(F.col("event"), lockdown=True).alias("locked"), redaction.request_hash(F.col("event")).alias("request_hash"), redaction.looks_secret(F.col("event")).alias("looks_secret"))


@query("stream_dedupe", "SELECT event_id, ts, user_id FROM events")
def stream_dedupe(spark, d):
    """Every row of events comes twice in the stream and is stored once."""
    path, out = f"{d}/events.parquet", shared_path(spark, "stream")
    rows = streams.read(spark, path, spark.read.parquet(path).schema).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    streams.run_to_end(streams.dedupe(rows.unionByName(rows), delay="60 days"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), shared_path(spark, "stream-state"))
    return spark.read.schema("event_id long, ts timestamp, user_id long").parquet(out).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")


@query("stream_session_summary", "SELECT user_id, count(*) AS events, min(ts) AS started_at, max(ts) AS last_event_at FROM events GROUP BY 1")
def stream_session_summary(spark, d):
    """Running activity by user over a stream, in complete mode."""
    path, out = f"{d}/events.parquet", shared_path(spark, "stream")
    rows = streams.read(spark, path, spark.read.parquet(path).schema)
    counted = rows.groupBy("user_id").agg(F.count("*").alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"))
    streams.run_to_end(counted, lambda b, i: b.write.mode("overwrite").parquet(out), shared_path(spark, "stream-state"), "complete")
    return spark.read.parquet(out)


@query("stream_ingest", "SELECT event_id, user_id FROM events")
def stream_ingest(spark, d):
    """Exactly-once commit of streamed records by micro-batch; each comes twice, and the state knows which ones are stored."""
    path, out = f"{d}/events.parquet", shared_path(spark, "stream")
    stateful.with_state_store(spark)
    rows = streams.read(spark, path, spark.read.parquet(path).schema).select("event_id", "user_id")
    streams.run_to_end(stateful.ingest_once(rows.unionByName(rows), ["event_id"]), stateful.by_batch(out), shared_path(spark, "stream-state"))
    return spark.read.schema("event_id long, user_id long").parquet(out).select("event_id", "user_id")


def _lines(spark, d) -> DataFrame:
    """A wire line for each event: requests, notifications, responses, batches and broken text."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    call = F.concat(F.lit('{"id":'), n, F.lit(',"method":"tools/call"}'))
    note = F.lit('{"id":null,"method":"notifications/progress"}')
    answer = F.concat(F.lit('{"id":"r'), n, F.lit('","result":{}}'))
    line = F.when(kind == "view", call).when(kind == "click", note).when(kind == "signup", answer).when(kind == "error", F.concat(F.lit("["), call, F.lit(","), note, F.lit(",7]"))).otherwise(F.concat(F.lit('{"id":'), n))
    return table(spark, d, "events").select("event_id", line.alias("line"))


_LINES = """l AS (SELECT event_id, CASE event_type WHEN 'view' THEN c WHEN 'click' THEN n WHEN 'signup' THEN '{"id":"r' || event_id || '","result":{}}' WHEN 'error' THEN '[' || c || ',' || n || ',7]' ELSE '{"id":' || event_id END AS line
    FROM (SELECT event_id, event_type, '{"id":' || event_id || ',"method":"tools/call"}' AS c, '{"id":null,"method":"notifications/progress"}' AS n FROM events))"""


@query("wire_lines", f"""WITH {_LINES}, m AS (SELECT event_id, 0 AS item, line AS m, json_valid(line) AS ok FROM l WHERE NOT coalesce(json_type(CASE WHEN json_valid(line) THEN line END) = 'ARRAY', false)
    UNION ALL SELECT event_id, i AS item, json_extract(line, '$[' || i || ']')::VARCHAR, true FROM (SELECT event_id, line, unnest(range(json_array_length(line)::BIGINT))::INT AS i FROM l WHERE json_valid(line) AND json_type(line) = 'ARRAY')),
    f AS (SELECT *, json_type(j) AS t, coalesce(json_type(j, '$.id') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE'), false) AS has_id, coalesce(json_type(j, '$.method') = 'VARCHAR', false) AS has_method FROM (SELECT *, CASE WHEN ok THEN m END AS j FROM m))
    SELECT event_id, item, CASE WHEN NOT ok THEN 'unparseable' WHEN t <> 'OBJECT' THEN 'other' WHEN has_method AND has_id THEN 'request' WHEN has_method THEN 'notification' WHEN has_id THEN 'response' ELSE 'other' END AS class,
    CASE WHEN has_id THEN json_extract_string(j, '$.id') END AS request_id, CASE WHEN has_method THEN json_extract_string(j, '$.method') END AS method FROM f""")  # fmt: skip
def wire_lines(spark, d):
    return capture.classify_lines(_lines(spark, d)).select("event_id", "item", "class", "request_id", "method")


def _attempts(spark, d) -> DataFrame:
    """Orders as recorded actions: an attempt for each line item, an outcome for those that were returned or whose part is divisible by seven."""
    lines = table(spark, d, "lineitem")
    items = dealt(lines, lines.count(), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_linestatus", "l_returnflag")])
    rows = items.select(
        F.col("l_orderkey").cast("string").alias("action_id"), F.col("l_linenumber").cast("string").alias("attempt_id"),
        F.concat(F.lit("s"), F.pmod("l_orderkey", F.lit(100)).cast("string")).alias("session_id"), F.concat(F.lit("run"), F.pmod("l_suppkey", F.lit(10)).cast("string")).alias("run_id"),
        F.when(F.col("l_partkey") % 5 == 1, "hook").otherwise("proxy").alias("source"), F.when(F.col("l_linestatus") == "O", "deny").otherwise("allow").alias("decision"),
        ((F.col("l_returnflag") == "R") | (F.col("l_partkey") % 7 == 0)).alias("done"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"),
    )
    phase = lambda name, place: F.struct((F.col("n") * 2 + place).alias("seq"), F.lit(name).alias("phase"), F.concat("action_id", F.lit(f":{name}:"), "attempt_id").alias("event_id"))
    phases = F.when(F.col("done"), F.array(phase("attempt", 0), phase("outcome", 1))).otherwise(F.array(phase("attempt", 0)))
    return rows.select("action_id", "attempt_id", "session_id", "run_id", "source", "decision", F.explode(phases).alias("p")).select("*", "p.*").drop("p")


def _runs(spark, d) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 10 < 3").select(F.concat(F.lit("run"), (F.col("s_suppkey") % 10).cast("string")).alias("run_id"), F.lit("2024-01-01").alias("started_at")).distinct()


_LOST = """x AS (SELECT l_orderkey::VARCHAR AS action_id, l_linenumber::VARCHAR AS attempt_id, 's' || (l_orderkey % 100) AS session_id, 'run' || (l_suppkey % 10) AS run_id, l_partkey % 5 = 1 AS hook, l_linestatus = 'O' AS deny, l_returnflag = 'R' OR l_partkey % 7 = 0 AS done, l_orderkey * 10 + l_linenumber AS n
    FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, max(l_linestatus) AS l_linestatus, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2))"""


@query("recovered_outcomes", f"""WITH {_LOST}, o AS (SELECT action_id, attempt_id, bool_or(done) AS done, max_by(struct_pack(session_id, run_id, hook, deny), n) AS e FROM x GROUP BY 1, 2)
    SELECT action_id, attempt_id, e.session_id AS session_id, e.run_id AS run_id, 'sha256:' || sha256(action_id || ':attempt:' || attempt_id || ':recovered-outcome') AS event_id, CASE WHEN e.deny THEN 'denied' ELSE 'unknown' END AS outcome, 'recorder_exit' AS reason FROM o
    WHERE NOT done AND (e.run_id IN (SELECT 'run' || (s_suppkey % 10) FROM supplier WHERE s_suppkey % 10 < 3) OR (e.hook AND e.session_id IN (SELECT 's' || (c_custkey % 100) FROM customer WHERE c_custkey % 4 = 0)))""")  # fmt: skip
def recovered_outcomes(spark, d):
    ended = table(spark, d, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("s"), F.pmod("c_custkey", F.lit(100)).cast("string")).alias("session_id"))
    attempts = dealt(_attempts(spark, d), 2 * table(spark, d, "lineitem").count(), "action_id", "attempt_id")
    return capture.recovered_outcomes(attempts, _runs(spark, d), ended)


@query("recovery_gaps", f"""WITH {_LOST}, f AS (SELECT run_id, min_by(session_id, n) AS session_id FROM x GROUP BY 1), r AS (SELECT DISTINCT 'run' || (s_suppkey % 10) AS run_id FROM supplier WHERE s_suppkey % 10 < 3)
    SELECT 'sha256:' || sha256(run_id || ':coverage-gap') AS event_id, run_id, session_id, '2024-01-01' AS ts, 'recorder_exit' AS reason, 0::BIGINT AS dropped_at_least FROM r LEFT JOIN f USING (run_id)""")  # fmt: skip
def recovery_gaps(spark, d):
    return capture.recovery_gaps(_attempts(spark, d), _runs(spark, d))


@query("bundle_verdicts", f"""{_SEALED}, b AS (SELECT chain_id, count(*) AS n, min(seq) AS lo, max(seq) AS hi, max_by(hash, seq) AS head FROM sealed GROUP BY 1)
    SELECT chain_id AS bundle_id, failed IS NULL AS ok, failed FROM (SELECT chain_id, CASE WHEN n % 5 = 0 THEN 'event_count' WHEN n % 5 = 1 THEN 'to_seq' WHEN n % 5 = 2 THEN 'head_hash' WHEN n % 5 = 3 THEN 'public_key' END AS failed FROM b)""")  # fmt: skip
def bundle_verdicts(spark, d):
    """Each chain as one bundle, most with a manifest that claims something else."""
    records = integrity.seal(chain_events(spark, d)).withColumnRenamed("chain_id", "bundle_id")
    b = records.groupBy("bundle_id").agg(F.count("*").alias("n"), F.min("seq").alias("from_seq"), F.max("seq").alias("hi"), F.max_by("hash", "seq").alias("head"))
    fault = lambda i, good, bad: F.when(F.col("n") % 5 == i, bad).otherwise(good)
    to_seq, head = fault(1, F.col("hi"), F.col("hi") + 1), fault(2, F.col("head"), F.reverse("head"))
    claims = b.select("bundle_id", fault(0, F.col("n"), F.col("n") + 1).alias("event_count"), "from_seq", to_seq.alias("to_seq"), head.alias("head_hash"), to_seq.alias("signature_seq"), head.alias("signature_hash"), F.lit("AB").alias("public_key"), fault(3, F.lit("ab"), F.lit("cd")).alias("pem_key"), F.lit("pem").alias("public_key_pem"), F.lit("pem").alias("pem_file"))
    return integrity.bundle_verdicts(claims, integrity.manifest_problems(claims, records))


@query("guarded_refs", f"""SELECT page_id, CASE WHEN contains(html, 'documentation') THEN {_REF.format("'[brokered-credential]'")} ELSE {_REF.format('html')} END AS ref FROM pages WHERE html IS NOT NULL""")
def guarded_refs(spark, d):
    return table(spark, d, "pages").where("html is not null").select("page_id", redaction.guarded_ref(F.col("html"), ["documentation"]).alias("ref"))


@query("credential_fingerprints", f"""SELECT c_custkey, 'API_TOKEN' AS name, {_REF.format("c_name")} AS ref FROM customer WHERE length(c_name) >= 8 UNION ALL SELECT c_custkey, 'db_password', {_REF.format("c_mktsegment")} FROM customer WHERE length(c_mktsegment) >= 8""")
def credential_fingerprints(spark, d):
    env = F.create_map(F.lit("API_TOKEN"), "c_name", F.lit("HOME"), "c_name", F.lit("db_password"), "c_mktsegment", F.lit("OWN_SECRET"), "c_name")
    found = redaction.credential_fingerprints(env, "OWN_")
    return table(spark, d, "customer").select("c_custkey", F.explode(found).alias("f")).select("c_custkey", "f.name", "f.ref")
