"""Records, signatures, logs, searches, redaction and intake on small fixtures."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from auditlake.functions import canonical as C
from auditlake.functions import ed25519
from auditlake.operators import correlate, integrity, redaction, replica, search
from auditlake.sources import logs

H = lambda i: f"{i:064x}"
REF = lambda t: C.REF + hashlib.sha256(t.encode()).hexdigest()


def sealed(spark, n=6, chain="c", last="session_end"):
    events = [(chain, i, json.dumps({"kind": last if i == n else "rpc", "n": i}, separators=(",", ":"))) for i in range(1, n + 1)]
    return integrity.seal(spark.createDataFrame(events, "chain_id string, seq long, event string"))


def test_malformed_records_take_no_part(spark):
    r = sealed(spark).withColumn("position", F.col("seq"))
    assert integrity.verify(r).count() == 0
    broken = r.withColumn("event", F.when(F.col("seq") == 3, "[1]").otherwise(F.col("event"))).withColumn("hash", F.when(F.col("seq") == 6, "xyz").otherwise(F.col("hash")))
    found = {(x.seq, x.problem) for x in integrity.verify(broken).collect()}
    assert found == {(3, "malformed_record"), (6, "malformed_record"), (4, "seq_gap"), (4, "prev_hash_mismatch")}
    (v,) = integrity.verdicts(broken, integrity.verify(broken)).collect()
    assert (v.checked, v.head_seq, v.problems, v.ok) == (4, 5, 4, False)


def test_order_is_that_of_reading(spark):
    r = sealed(spark, 4).collect()
    rows = [(x.chain_id, x.seq, x.prev_hash, x.hash, x.event, p) for p, x in enumerate([r[0], r[1], r[1], r[0], r[2]])]
    read = spark.createDataFrame(rows, integrity.SEALED + ", position int")
    found = sorted((x.seq, x.problem) for x in integrity.verify(read).collect())
    assert found == [(1, "duplicate_seq"), (1, "prev_hash_mismatch"), (2, "duplicate_seq"), (2, "prev_hash_mismatch"), (3, "prev_hash_mismatch"), (3, "seq_gap")]


def _sign(seed: bytes, message: bytes) -> tuple[str, str]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)

    def packed(p):
        z = pow(p[2], -1, ed25519._P)
        x, y = p[0] * z % ed25519._P, p[1] * z % ed25519._P
        return (y | (x & 1) << 255).to_bytes(32, "little")

    key = packed(ed25519._times(a, ed25519._BASE))
    r = int.from_bytes(hashlib.sha512(h[32:] + message).digest(), "little") % ed25519._ORDER
    top = packed(ed25519._times(r, ed25519._BASE))
    k = int.from_bytes(hashlib.sha512(top + key + message).digest(), "little") % ed25519._ORDER
    return key.hex(), (top + ((r + k * a) % ed25519._ORDER).to_bytes(32, "little")).hex()


def test_ed25519_vectors():
    key = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    signature = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert ed25519.verify(b"", key, signature) and not ed25519.verify(b"x", key, signature)
    assert not ed25519.verify(b"", key, signature[:-1] + b"\xff") and not ed25519.verify(b"", b"\xff" * 32, signature)
    for i in range(3):
        k, s = _sign(bytes([i] * 32), b"m%d" % i)
        assert ed25519.verify(b"m%d" % i, bytes.fromhex(k), bytes.fromhex(s)) and not ed25519.verify(b"n", bytes.fromhex(k), bytes.fromhex(s))


def test_signature_verdicts(spark):
    records = sealed(spark, 6)
    hashes = {r.seq: r.hash for r in records.collect()}

    def signed(seq, h=None, prefix="p", **change):
        h = h or hashes.get(seq, H(seq))
        key, s = _sign(b"k" * 32, f"{prefix}\n{seq}\n{h}".encode())
        row = {"chain_id": "c", "seq": seq, "chain_hash": h, "algo": "ed25519", "public_key": key, "signature": s} | change
        return tuple(row.values())

    def verdicts(*rows, **kw):
        table = spark.createDataFrame(list(rows), "chain_id string, seq long, chain_hash string, algo string, public_key string, signature string")
        return sorted((r.problem, r.seq, r.warning) for r in integrity.signature_verdicts(table, records, "p", **kw).collect())

    assert verdicts(signed(2), signed(6)) == []
    assert verdicts(signed(6, prefix="q")) == [("no_valid_signature", 6, False), ("signature_invalid", 6, False), ("unsigned_session_end", 6, False)]
    assert verdicts(signed(6, prefix="q"), allow_unsigned=True) == [("no_valid_signature", 6, True), ("signature_invalid", 6, False), ("unsigned_session_end", 6, True)]
    assert verdicts(signed(3)) == [("unsigned_session_end", 6, False)]
    assert verdicts(signed(9)) == [("truncated_after_signature", 9, False)]
    assert verdicts(signed(6), signed(4, h=H(7))) == [("signature_chain_mismatch", 4, False)]
    assert verdicts(signed(6), signed(2, algo="rsa"), signed(0)) == [("signature_invalid", 0, False), ("signature_invalid", 2, False)]
    assert verdicts(signed(6), expected_key="AB" * 32)[0] == ("no_valid_signature", 6, False)
    plain = sealed(spark, 6, last="rpc")
    hashes = {r.seq: r.hash for r in plain.collect()}
    records = plain
    assert verdicts(signed(3)) == [("unsigned_tail", 6, True)]


def test_append_guard(spark):
    r = sealed(spark)
    heads = logs.heads(r.where("seq <= 3"), C.GENESIS_HASH)
    assert integrity.append_guard(r.where("seq > 3"), heads).count() == 0
    assert integrity.append_guard(r.where("seq > 4"), heads).count() == 1
    assert integrity.append_guard(r.where("seq in (4, 6)"), heads).count() == 1
    assert integrity.append_guard(r, heads.limit(0)).count() == 0


def test_logs(spark, tmp_path):
    good = [json.dumps({"seq": i, "prev_hash": H(i), "hash": H(i + 1), "event": {"b": 1, "a": i}}) for i in range(1, 4)]
    (tmp_path / "a.jsonl").write_text("\n".join([good[0], "", good[1], '{"seq": 3, "ha']) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join([good[0], "broken", *good[1:]]))
    log = logs.chain_log(spark, str(tmp_path)).collect()
    states = {f: [r.status for r in sorted((x for x in log if x.file.endswith(f)), key=lambda r: r.line)] for f in ("a.jsonl", "b.jsonl")}
    assert states == {"a.jsonl": ["ok", "ok", "torn_tail"], "b.jsonl": ["ok", "corrupt", "ok", "ok"]}
    until = logs.chain_log_until_bad(spark, str(tmp_path)).collect()
    assert sorted((r.file[-7:], r.seq, r.event) for r in until) == [("a.jsonl", 1, '{"a":1,"b":1}'), ("a.jsonl", 2, '{"a":2,"b":1}'), ("b.jsonl", 1, '{"a":1,"b":1}')]


def test_large_logs_are_read_by_blocks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"seq": i, "event": {"t": "x" * 200}}) + "\n" for i in range(1, 500)) + "{")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        log = logs.chain_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 1 or log.select("seq").count() == 500
        rows = sorted(log.collect(), key=lambda r: r.line)
        assert [r.seq for r in rows] == [*range(1, 500), None] and rows[-1].status == "torn_tail" and {r.status for r in rows[:-1]} == {"ok"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_other_sources(spark, tmp_path):
    (tmp_path / "holds").mkdir()
    (tmp_path / "holds/1.json").write_text(json.dumps({"approval_id": "a1", "status": "pending", "timeout_at": "2024"}))
    (tmp_path / "holds/2.json").write_text("{broken")
    (tmp_path / "holds/3.json").write_text(json.dumps({"approval_id": "a 3", "status": "pending"}))
    assert [r.approval_id for r in logs.holds(spark, str(tmp_path / "holds")).collect()] == ["a1"]
    (tmp_path / "client.json").write_text(json.dumps({"mcpServers": {"fs": {"url": "https://fs.example:1/x", "tools": [{"name": "read"}, {"name": "write"}]}, "bare": {}}}))
    assert sorted((r.server, r.host, r.tool) for r in logs.tool_catalog(spark, str(tmp_path / "client.json")).collect()) == [("bare", None, None), ("fs", "fs.example", "read"), ("fs", "fs.example", "write")]
    (h,) = logs.policy_fingerprints(spark, str(tmp_path / "client.json")).collect()
    assert h.policy_hash == C.REF + hashlib.sha256((tmp_path / "client.json").read_bytes()).hexdigest()
    signatures = spark.createDataFrame([("c", 1, 9), ("c", 3, 2), ("d", 2, 1)], "chain_id string, sig_id long, seq long")
    assert {(r.chain_id, r.seq) for r in logs.latest_signatures(signatures).collect()} == {("c", 2), ("d", 1)}
    for b, n in (("b1", 2), ("b2", 1)):
        (tmp_path / "bundles" / b).mkdir(parents=True)
        (tmp_path / "bundles" / b / "manifest.json").write_text(json.dumps({"event_count": 2, "from_seq": 1, "to_seq": n, "head_hash": H(n)}, indent=1))
        (tmp_path / "bundles" / b / "events.jsonl").write_text("".join(json.dumps({"seq": i, "prev_hash": H(i - 1), "hash": H(i), "event": {"k": i}}) + "\n" for i in range(1, n + 1)))
    records, manifests = logs.bundles(spark, str(tmp_path / "bundles"))
    full = manifests.select("*", F.lit(None).cast("string").alias("pem_key"), F.lit(None).cast("string").alias("pem_file"))
    problems = {(r.bundle_id, r.check) for r in integrity.manifest_problems(full, records).collect() if r.check in ("event_count", "from_seq", "to_seq", "head_hash")}
    assert problems == {("b2", "event_count")}
    rows = spark.createDataFrame([("c", i, "s1" if i % 2 else "s2", f"r{i % 3}") for i in range(1, 10)], "chain_id string, seq long, session_id string, run_id string")
    assert [r.seq for r in logs.records_between(rows, 3, 8, "s1").collect()] == [3, 5, 7]
    assert {r.run_id: r.records for r in logs.counts_by_run(rows).collect()} == {"r0": 3, "r1": 3, "r2": 3}


def test_event_index(spark):
    event = {
        "kind": "tool_call", "tool": "Read", "server": {"name": "FS"}, "result_hash": REF("out"), "args_hash": REF("no"),
        "identity": {"credential_fingerprints": [{"name": "A", "ref": REF("cred")}]},
        "gateway": {"boundary": {"secret_refs": [REF("s0"), REF("s1")]}},
        "arguments": {REF("key"): 1, "a b": {"redacted": True, "ref": REF("leaf"), "len": 4, "secret_refs": [REF("inner")]}, "l": ["x", {"deep": "find me here"}]},
    }
    rows = [(1, "s", json.dumps(event)), (2, "s", json.dumps({"kind": "rpc", "method": REF("long name"), "server": {"name": "other"}})), (3, "t", "{"), (4, None, None), (5, "t", "[]"), (6, "u", json.dumps({"kind": "policy_decision", "tool": "t", "args_hash": REF("no")}))]
    index = search.event_index(spark.createDataFrame(rows, "event_id long, session_id string, event string"))
    wanted = ["out", "no", "cred", "s1", "key", "leaf", "inner", "read", "fs", "find me", "d me", "", "long name", "x", "absent"]
    got = {(r.needle, r.event_id): (r.matched_on, r.path) for r in search.touched(spark.createDataFrame([(w,) for w in wanted], "needle string"), index).collect()}
    assert got == {
        ("out", 1): ("result_hash", "$.result_hash"), ("no", 6): ("args_hash", "$.args_hash"), ("cred", 1): ("credential", "$.identity.credential_fingerprints[0].ref"),
        ("s1", 1): ("ref", "$.gateway.boundary.secret_refs[1]"), ("key", 1): ("ref", f"$.arguments['{REF('key')}']#key"), ("leaf", 1): ("ref", "$.arguments['a b']"), ("inner", 1): ("ref", "$.arguments['a b'].secret_refs[0]"),
        ("read", 1): ("name", "$.tool"), ("fs", 1): ("name", "$.server.name"), ("find me", 1): ("plain", "$.arguments.l[1].deep"), ("d me", 1): ("plain", "$.arguments.l[1].deep"), ("long name", 2): ("ref", "$.method"), ("x", 1): ("plain", "$.arguments.l[0]"),
    }


def test_plain_needles_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 30))) for _ in range(80)]
    needles = ["".join(rng.choices("abé ", k=rng.randint(1, 9))) for _ in range(40)] + ["", "𝄞"]
    index = spark.createDataFrame([(i, "s", 0, "plain", "$", t) for i, t in enumerate(texts)], "event_id long, session_id string, place int, matched_on string, path string, key string")
    got = {(r.needle, r.event_id) for r in search.touched(spark.createDataFrame([(n,) for n in needles], "needle string"), index).collect()}
    assert got == {(n, i) for n in set(needles) for i, t in enumerate(texts) if n and n in t}


def test_scrubbed_trees(spark):
    tree = {"type": "text", "role": "king", "name": "x", "tools": [{"name": "read_file"}], "method": "tools/call", "free": "words", "n": 1.5, "ok": True, "none": None, "password=hunter2hunter2": 1, "level": "AKIA" + "A" * 16, "list": ["a"]}
    s = redaction.scrubbed(tree)
    gone = lambda t: {"redacted": True, "ref": REF(t), "len": len(t)}
    assert s == {"type": "text", "role": gone("king"), "name": gone("x"), "tools": [{"name": "read_file"}], "method": "tools/call", "free": gone("words"), "n": 1.5, "ok": True, "none": None, REF("password=hunter2hunter2"): 1, "level": gone("AKIA" + "A" * 16), "list": [gone("a")]}
    assert redaction.scrubbed({"free": "words", "k": "AKIA" + "A" * 16}, "off") == {"free": "words", "k": gone("AKIA" + "A" * 16)}
    assert redaction.locked(s)["type"] == gone("text") and redaction.locked({"redacted": True, "ref": "sha256:no", "len": 1})["ref"] == gone("sha256:no") and redaction.locked(gone("a")) == gone("a")
    deep = "leaf"
    for _ in range(40):
        deep = [deep]
    out = redaction.scrubbed(deep)
    for _ in range(33):
        (out,) = out
    assert out["redacted"] and set(out) == {"redacted", "ref", "len"}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None), (4, '"AKIA' + "A" * 16 + '"')], "n int, j string")
    got = {r.n: (r.a, r.s) for r in rows.select("n", redaction.scrub(F.col("j")).alias("a"), redaction.looks_secret(F.col("j")).alias("s")).collect()}
    assert json.loads(got[1][0]) == s and got[2] == (None, False) and got[3] == (None, False) and json.loads(got[4][0]) == gone("AKIA" + "A" * 16) and got[4][1]
    assert rows.where("n = 1").select(redaction.request_hash(F.lit('{"b": 1, "a": [2]}')).alias("h")).first().h == REF('{"a":[2],"b":1}')


def test_command_lines():
    out, refs = redaction.command_line(["run", "--api-key", "k3y", "--token=abc", "NAME=plain", "DB_PASSWORD=x y", "postgres://u:p%20w@h/db", "--verbose", "AKIA" + "A" * 16])
    assert out == ["run", "--api-key", REF("k3y"), "--token=" + REF("abc"), "NAME=plain", "DB_PASSWORD=" + REF("x y"), f"postgres://{REF('u:p%20w')}@h/db", "--verbose", REF("AKIA" + "A" * 16)]
    assert refs == [REF("k3y"), REF("abc"), REF("x y"), REF("u:p%20w"), REF("p%20w"), REF("u"), REF("AKIA" + "A" * 16)]


def test_column_functions(spark):
    rows = spark.createDataFrame([("mcp__fs__read__all",), ("Bash",), ("mcp____x",)], "t string")
    server, tool = C.tool_parts(F.col("t"))
    assert [tuple(r) for r in rows.select(server, tool).collect()] == [("fs", "read__all"), ("", "Bash"), ("", "mcp____x")]
    (r,) = spark.range(1).select(C.scrub_keys(F.create_map(F.lit("ok"), F.lit(1), F.lit("no key"), F.lit(2), F.lit("token"), F.lit(3)), "token").alias("m"), C.secret_refs(F.lit("a AKIAX b AKIAX c ghp_"), ["AKIA.", "gh._"]).alias("s")).collect()
    assert r.m == {"ok": 1, REF("no key"): 2, REF("token"): 3} and r.s == [REF("AKIAX"), REF("ghp_")]


def test_correlation_fixtures(spark):
    calls = spark.createDataFrame([(1, 0, 10), (1, 5, 7), (1, 10, 12), (2, 0, None), (2, 3, 4)], "id int, s int, e int")
    assert {(r.id, r.s) for r in correlate.in_flight(calls, ["id"], "s", "e").collect()} == {(1, 5)}
    catalog = spark.createDataFrame([("a", "t1", "ha"), ("a", "t2", "ha"), ("b", "t2", "hb"), ("c", "t3", "hc")], "server string, tool string, host string")
    asked = spark.createDataFrame([("a", "zz"), ("?", "t1"), ("?", "t2"), ("c", "t1")], "server string, tool string")
    assert {(r.server, r.tool): r.host for r in correlate.origins(asked, catalog).collect()} == {("a", "zz"): "ha", ("?", "t1"): "ha", ("?", "t2"): None, ("c", "t1"): "hc"}
    stored = spark.createDataFrame([("e1", "x"), ("e2", "y")], "event_id string, v string")
    assert sorted(map(tuple, correlate.with_pending(stored, spark.createDataFrame([("e2", "z"), ("e3", "w"), ("e3", "w")], "event_id string, v string")).collect())) == [("e1", "x"), ("e2", "y"), ("e3", "w")]
    markers = spark.createDataFrame([("s", "1", "2024-01-01 00:00:00"), ("s", "2", "2024-01-01 00:00:00"), ("s", "3", "2024-01-02 10:00:00")], "session_id string, request_id string, started_at string")
    settled = spark.createDataFrame([("s", "2")], "session_id string, request_id string")
    assert [r.request_id for r in correlate.stale(markers, settled, F.lit("2024-01-02 12:00:00")).collect()] == ["1"]
    decided = correlate.decisions_of_calls(spark.createDataFrame([("c1", "d1"), ("c2", None)], "call string, decision_id string"), spark.createDataFrame([("d1", "deny", "r")], "event_id string, decision string, rule_id string"))
    assert {(r.call, r.decided) for r in decided.collect()} == {("c1", "deny"), ("c2", None)}


def test_intake(spark):
    record = {"seq": 1, "prev_hash": H(1), "hash": H(2), "event": "{}"}
    good = {"protocol": 1, "chain_id": H(1), "key": H(2), "base_hash": H(3), "from_seq": 1, "to_seq": 1, "head_seq": 1, "head_hash": H(2), "records": [record], "body": "b", "body_digest": hashlib.sha256(b"b").hexdigest()}
    cases = [({}, None), ({"protocol": 2}, "unsupported protocol"), ({"key": "x"}, "key"), ({"from_seq": 0}, "heartbeat"), ({"from_seq": 0, "to_seq": 0, "records": []}, None), ({"to_seq": 2}, "count"), ({"from_seq": 2, "to_seq": 1}, "range"), ({"records": [record | {"event": "[]"}]}, "record shape"), ({"records": None}, "records"), ({"head_hash": None}, "head"), ({"body": "c"}, "body digest differs")]
    shape = "n int, protocol int, chain_id string, key string, base_hash string, from_seq long, to_seq long, head_seq long, head_hash string, records array<struct<seq:bigint,prev_hash:string,hash:string,event:string>>, body string, body_digest string"
    names = [c.split()[0] for c in shape.replace("array<struct<seq:bigint,prev_hash:string,hash:string,event:string>>", "x").split(", ")]
    rows = spark.createDataFrame([tuple((good | c | {"n": i})[k] for k in names) for i, (c, _) in enumerate(cases)], shape)
    assert [r.reason for r in replica.batch_faults(rows, 1).orderBy("n").collect()] == [want for _, want in cases]
    stored = spark.createDataFrame([("c", i, H(i)) for i in range(1, 5)], "chain_id string, seq long, hash string")
    signatures = spark.createDataFrame([("c", 2, H(2), "s"), ("c", 2, H(2), "s"), ("c", 3, H(3), "t"), ("c", 4, H(9), "u"), ("d", 1, H(1), "v")], "chain_id string, seq long, chain_hash string, signature string")
    assert [(r.chain_id, r.attested_seq, r.signatures) for r in replica.attested(signatures, stored).collect()] == [("c", 3, 2)]
    sizes = spark.createDataFrame([("c", i, s) for i, s in [(1, 5), (2, 5), (3, 50), (4, 1), (6, 1), (7, 1), (8, 1)]], "chain_id string, seq long, size long")
    assert sorted((r.from_seq, r.to_seq, r.bytes) for r in replica.delivery_batches(sizes, 2, 10).collect()) == [(1, 2, 10), (3, 3, 50), (4, 4, 1), (6, 7, 2), (8, 8, 1)]
    runs = spark.createDataFrame([("r", i, s) for i, s in enumerate([6, 9, 3, 2, 1])], "run string, n int, bytes int")
    assert [(r.kept, r.dropped_at_least) for r in replica.admitted(runs, "run", "n", "bytes", 10).collect()] == [(3, 2)]
    arrivals = spark.createDataFrame([(c, t) for c in ("c", "f") for t in ("2024-01-01 00:00:00", "2024-01-01 00:10:00")], "chain_id string, received_at string")
    found = replica.silence(arrivals, 180, F.lit("2024-01-01 01:00:00"), spark.createDataFrame([("f",)], "chain_id string"))
    assert [(r.chain_id, r.silent_from[11:16]) for r in found.orderBy("silent_from").collect()] == [("c", "00:00"), ("c", "00:10")]
    owners = spark.createDataFrame([("c", "k", "t")], "chain_id string, key string, tenant string")
    assert [r.key for r in replica.ownership(spark.createDataFrame([("c", "k", "t"), ("c", "x", "t"), ("new", "x", "u")], "chain_id string, key string, tenant string"), owners).collect()] == ["x"]
