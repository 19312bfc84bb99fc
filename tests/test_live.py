"""Streams with state, growing logs, range-split links, self-checks, evictions and rules as data, against batch results and brute force."""

import hashlib
import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auditlake.functions import canonical as C
from auditlake.functions import ed25519
from auditlake.operators import correlate, integrity, policy, replica, search
from auditlake.plans import registry
from auditlake.sources import logs, tail
from auditlake.streaming import stateful, streams

RECORD = "chain_id string, seq long, prev_hash string, hash string"


def _chain(name, n, start=1, prev=C.GENESIS_HASH):
    out = []
    for i in range(start, start + n):
        h = hashlib.sha256(f"{prev}/{name}/{i}".encode()).hexdigest()
        out.append((name, i, prev, h))
        prev = h
    return out


def _problems(df):
    return sorted((r.chain_id, r.seq, r.problem) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_links_in_ranges_equal_the_window(spark, parts):
    rng = random.Random(parts)
    rows = []
    for name in ("a", "b", "c", None):
        chain = [list(r) for r in _chain(name, 300 if name == "a" else 7)]
        for r in rng.sample(chain, len(chain) // 5):
            r[rng.choice([2, 3])] = "0" * 64
        chain = [r for r in chain if rng.random() > 0.1]
        chain.insert(len(chain) // 2, chain[0])
        rows += [(*r, i) for i, r in enumerate(chain)]
    df = spark.createDataFrame(rows, RECORD + ", position long").repartition(5)
    order = lambda found: sorted(found, key=str)
    assert order(_tuple(integrity.link_problems(df, parts=parts))) == order(_tuple(integrity.link_problems(df)))
    empty = df.limit(0)
    assert integrity.link_problems(empty, parts=parts).count() == 0


def _tuple(df):
    return [(r.chain_id, r.seq, r.problem) for r in df.collect()]


def test_one_chain_uses_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("all").alias("chain_id"), (F.col("id") + 1).alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").alias("position"))
    df = df.withColumn("prev_hash", F.when(F.col("seq") == 1, C.GENESIS_HASH).otherwise(F.sha2((F.col("position") - 1).cast("string"), 256)))
    from auditlake.operators.ranges import with_previous

    out = with_previous(df, "chain_id", "position", ["seq", "hash"], 8, "before")
    assert out.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() > 1
    assert integrity.link_problems(df, parts=8).count() == 0


def _event_chain(name, n, broken=()):
    out, prev = [], C.GENESIS_HASH
    for i in range(1, n + 1):
        event = f'{{"n":{i}}}'
        h = hashlib.sha256(f"{prev}\n{event}".encode()).hexdigest()
        out.append((name, i, prev, h, '{"n":0}' if i in broken else event))
        prev = h
    return out


def test_self_checks_together_are_one_check(spark, tmp_path):
    rows = _event_chain("good", 30) + [r for r in _event_chain("bad", 30, {12}) if r[1] != 21] + _event_chain("late", 9, {1})
    schema = RECORD + ", event string"
    path = f"{tmp_path}/log"
    batches = [lambda r: r[1] <= 10 and r[0] != "late", lambda r: 10 < r[1] <= 20, lambda r: r[1] > 20 or r[0] == "late"]
    reached, found = spark.createDataFrame([], integrity.REACHED), []
    for i, chosen in enumerate(batches):
        integrity.lay_out(spark.createDataFrame([r for r in rows if chosen(r)], schema), path, i)
        later = integrity.laid_out(spark, path, i - 1)
        assert {os.path.basename(os.path.dirname(f)) for f in later.inputFiles()} >= {f"batch={i}"}
        assert f"PartitionFilters: [isnotnull(batch" in later._jdf.queryExecution().executedPlan().toString()
        problems, reached = integrity.self_check(later, reached)
        found += _problems(problems)
    whole = integrity.verify(spark.createDataFrame(rows, schema), "seq")
    assert sorted(found) == _problems(whole) and found
    assert {(r.chain_id, r.seq, r.sound_seq, r.broken) for r in reached.collect()} == {("good", 30, 30, False), ("bad", 30, 11, True), ("late", 9, None, True)}


def _run(stream, out, state, split=None, *more):
    streams.run_to_end(stream, stateful.by_batch(out, *more, split=split), state)


def _files(spark, path, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_chains_are_admitted_by_their_state(spark, tmp_path):
    a, b = _chain("a", 6), _chain("b", 4)
    other = _chain("a", 2, 7, "f" * 64)
    parts = [a[:3] + b[:2] + [("c", 2, C.GENESIS_HASH, "1" * 64), ("d", 1, "2" * 64, "3" * 64), ("g", None, None, None)], a[1:6], b[2:3] + [b[3][:2] + ("9" * 64, b[3][3])], other, _chain("a", 1, 7, a[-1][3]), b[2:4], [("c", 1, C.GENESIS_HASH, "5" * 64), ("c", 1, C.GENESIS_HASH, "6" * 64)]]
    stream = stateful.ingest_chains(_files(spark, f"{tmp_path}/in", parts, RECORD))
    out, refused, state = f"{tmp_path}/out", f"{tmp_path}/refused", f"{tmp_path}/state"
    write = stateful.by_batch(out, refused, split=stateful.admitted_and_refused)

    def failing(batch, number):
        write(batch, number)
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        streams.run_to_end(stream, failing, state)
    streams.run_to_end(stateful.ingest_chains(spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), write, state)
    stored = sorted((r.chain_id, r.seq, r.prev_hash, r.hash) for r in spark.read.schema(RECORD).parquet(out).collect())
    assert stored == sorted(a + b)
    got = sorted((r.chain_id, r.seq, r.reason, r.hash, r.stored_hash or "") for r in spark.read.schema(stateful.INGESTED).parquet(refused).collect())
    want = [("a", 7, "fork", other[0][3], a[-1][3]), ("a", 7, "fork", _chain("a", 1, 7, a[-1][3])[0][3], ""), ("b", 4, "bad_link", b[3][3], ""), ("c", 1, "fork", "6" * 64, "5" * 64), ("c", 2, "gap", "1" * 64, ""), ("d", 1, "bad_genesis", "3" * 64, "")]
    assert got == sorted(want)


T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
END = datetime(2099, 1, 1, tzinfo=timezone.utc)


def test_silence_is_told_once_and_ends_with_traffic(spark, tmp_path):
    at = lambda *minutes: [T0 + timedelta(minutes=m) for m in minutes]
    arrivals = {"a": at(0, 1, 30, 31, 90), "b": at(0, 3, 5, 8), "c": at(2), "fork": at(0, 50)}
    parts = [[(c, t) for c, ts in arrivals.items() for t in ts if lo <= (t - T0).seconds / 60 < hi] for lo, hi in ((0, 5), (5, 31), (31, 60), (60, 999))]
    parts[1] = parts[1][::-1]
    now = T0 + timedelta(minutes=95)
    schema = "chain_id string, received_at timestamp"
    stream = _files(spark, f"{tmp_path}/in", [*parts, [(None, now)]], schema)
    forked = spark.createDataFrame([("fork",)], "chain_id string")
    alerts = stateful.silence_alerts(stream, 600, forked=forked)
    _run(alerts, f"{tmp_path}/out", f"{tmp_path}/state")
    told = spark.read.schema(stateful.OUTAGES).parquet(f"{tmp_path}/out")
    rows = told.collect()
    assert len([r for r in rows if r.state == "open"]) == len({(r.chain_id, r.silent_from) for r in rows if r.state == "open"})
    every = spark.createDataFrame([(c, t) for c, ts in arrivals.items() for t in ts], schema)
    want = replica.silence(every, 600, F.lit(now), forked)
    key = lambda df: sorted((r.chain_id, r.silent_from, r.silent_until) for r in df.collect())
    assert key(stateful.outages(told, F.lit(now))) == key(want) and len(key(want)) == 4


def test_live_correlation_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    asked = [(f"s{i % 3}", i, T0 + timedelta(seconds=7 * i)) for i in range(120) if i % 11]
    answered = [(f"s{i % 3}", i if i % 13 else i + 1000, T0 + timedelta(seconds=7 * i + 3)) for i in range(120) if i % 4]
    late = [(f"s{i % 3}", i, T0 + timedelta(seconds=7 * i + 900)) for i in range(0, 120, 4)]
    q, r = "session string, id long, asked_at timestamp", "session string, id long, answered_at timestamp"
    cut = lambda rows: [rows[:40], rows[40:80], rows[80:], [(None, None, END)]]
    answers = sorted(answered + late, key=lambda x: x[2])
    rng.shuffle(asked[:40])
    calls = stateful.live_request_response(_files(spark, f"{tmp_path}/q", cut(asked), q), _files(spark, f"{tmp_path}/r", cut(answers), r), ["session", "id"], "60 seconds", "30 minutes")
    _run(calls.where("id is not null"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((x.session, x.id, x.status, x.duration_ms or 0.0) for x in spark.read.schema(calls.schema).parquet(f"{tmp_path}/out").collect())
    timely = [a for a in answered]
    batch = correlate.request_response(spark.createDataFrame(asked, q), spark.createDataFrame(timely, r), ["session", "id"], "asked_at", "answered_at")
    want = [(x.session, x.id, x.status, (x.answered_at - x.asked_at).total_seconds() * 1000 if x.status == "answered" else 0.0) for x in batch.collect()]
    assert got == sorted(want + [(s, i, "orphan_response", 0.0) for s, i, _ in late])


def test_holds_are_settled_as_in_the_batch(spark, tmp_path):
    rng = random.Random(6)
    at = lambda m: T0 + timedelta(minutes=m)
    holds = [(f"h{i}", at(i), at(i + 20)) for i in range(40)]
    decisions = [(f"h{i}", at(i + rng.choice([1, 5, 19, 20, 25])), rng.choice(["approved", "denied", "cancelled"])) for i in range(0, 40, 2) for _ in range(rng.choice([1, 1, 3]))] + [("h0", at(5), "approved"), ("h0", at(5), "cancelled"), ("lost", at(3), "denied")]
    decisions.sort(key=lambda r: (r[1], rng.random()))
    h, d = "approval_id string, created_at timestamp, timeout_at timestamp", "approval_id string, decided_at timestamp, decision string"
    cut = lambda rows, end: [rows[: len(rows) // 2], rows[len(rows) // 2 :], [end]]
    out = stateful.live_hold_outcomes(_files(spark, f"{tmp_path}/h", cut(holds, (None, at(55), at(99))), h), _files(spark, f"{tmp_path}/d", cut(decisions, (None, at(55), "denied")), d), "60 minutes")
    _run(out.where("approval_id is not null"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out").count() == 0  # the watermark hasn't passed anything yet
    for name, row in (("h", (None, at(115), at(999))), ("d", (None, at(115), "denied"))):
        spark.createDataFrame([row], h if name == "h" else d).write.mode("append").parquet(f"{tmp_path}/{name}")
    again = stateful.live_hold_outcomes(*(spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n, s in (("h", h), ("d", d))), "60 minutes")
    _run(again.where("approval_id is not null"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.approval_id, r.outcome) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    batch = replica.hold_outcomes(spark.createDataFrame(holds, h), spark.createDataFrame(decisions, d), F.lit(at(55)))
    assert got == sorted((r.approval_id, r.outcome) for r in batch.where("outcome <> 'pending'").collect()) and {"timeout", "approved"} <= {o for _, o in got}


def test_a_growing_log_is_read_once(spark, tmp_path):
    folder, out, state = tmp_path / "logs", f"{tmp_path}/out", f"{tmp_path}/state"
    folder.mkdir()
    line = lambda i: json.dumps({"seq": i, "prev_hash": "p", "hash": f"h{i}", "event": {"é": i}}, ensure_ascii=False)
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    go = lambda: _run(tail.tail(spark, str(folder)), out, state)
    a.write_text(line(1) + "\n\n" + line(2) + "\n" + line(3)[:9], encoding="utf8")
    go()
    rows = lambda: sorted(((os.path.basename(r.file), r.seq, r.hash, r.status) for r in logs.tailed_chain_log(spark.read.schema("file string, start long, value string").parquet(out)).collect()), key=str)
    assert rows() == [("a.jsonl", 1, "h1", "ok"), ("a.jsonl", 2, "h2", "ok")]
    with a.open("a", encoding="utf8") as f:
        f.write(line(3)[9:] + "\r\n" + "{broken\n" + line(4) + "\n")
    b.write_text(line(9) + "\n", encoding="utf8")
    go()
    go()
    batch = [(os.path.basename(r.file), r.seq, r.hash, r.status) for r in logs.chain_log(spark, str(folder)).collect()]
    assert sorted(rows(), key=str) == sorted(batch, key=str) and len(batch) == 6
    b.write_text("", encoding="utf8")
    with pytest.raises(Exception, match="cut or replaced"):
        go()


def test_ranges_of_a_log_hold_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "_SPLIT", 50)
    monkeypatch.setattr(tail, "_STEP", 7)
    rng = random.Random(1)
    for n in range(60):
        lines = ["x" * rng.choice([0, 1, 3, 48, 49, 50, 51, 130]) for _ in range(rng.randrange(12))]
        text = "".join(x + "\n" for x in lines) + "torn" * (n % 2)
        (tmp_path / "f.jsonl").write_text(text)
        reader = tail.TailReader({"path": str(tmp_path)})
        end = reader.latestOffset()
        got = [v for p in reader.partitions({}, end) for batch in reader.read(p) for v in zip(batch["start"].to_pylist(), batch["value"].to_pylist())]
        at, want = 0, []
        for x in lines:
            if x:
                want.append((at, x))
            at += len(x) + 1
        assert got == want


def _evicted(rows, limit):
    moves = sorted([(q, True, q, p) for q, _, p in rows] + [(e, False, q, p) for q, e, p in rows if e is not None])
    free, kept, out = [], [], []
    for at, opens, q, p in moves:
        if opens:
            if len(free) + len(kept) >= limit:
                out.append(((free or kept).pop(0), at))
            (kept if p else free).append(q)
        else:
            for held in (free, kept):
                if q in held:
                    held.remove(q)
    return out


def test_evictions_equal_brute_force(spark):
    rng = random.Random(7)
    rows, want = [], []
    for s in ("x", "y", "z", None):
        places = rng.sample(range(1000), 400)
        pairs = [(min(a, b), max(a, b)) for a, b in zip(places[::2], places[1::2])]
        one = [(a, None if rng.random() < 0.1 else b if s != "z" else a + 0.5, rng.random() < 0.3) for a, b in pairs]
        one = [(2 * a, None if b is None else int(2 * b), p) for a, b, p in one]
        rows += [(s, *r) for r in one]
        want += [(s, q, at) for q, at in _evicted(one, 25)]
    df = spark.createDataFrame(rows, "session string, asked long, answered long, gateway boolean").repartition(3)
    got = [(r.session, r.asked, r.evicted_at) for r in correlate.evictions(df, "session", "asked", "answered", 25, "gateway").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and got
    assert correlate.evictions(df.limit(0), "session", "asked", "answered").count() == 0


def test_rules_as_data_decide_as_rules_as_code(spark):
    from auditlake.plans.live import DOCUMENTS

    cases = ['{"k":"5"}', '{"k":5,"to":["u1"]}', '{"to":["u9"]}', "{", None, '["u9"]', '{"k":{"a":1}}', '{"note":"server"}', '{"k":"' + "5" * 4097 + '"}', json.dumps({"k": ["a"] * 257}), '{"k":true}', '{"to":["u95"],"k":"x"}']
    calls = [(i, s, t, a) for i, (a, s, t) in enumerate((a, s, t) for a in cases for s in ("server_0", "server_1", "server_4", None) for t in ("tool_3", "x/y", None))]
    df = spark.createDataFrame(calls, "n int, server string, tool string, args string")
    table = policy.rule_table(spark, DOCUMENTS)
    for name, doc in DOCUMENTS.items():
        rules, default = policy.rules_of(doc)
        columns = ("n", "action", "rule", "reason", "fail_closed", "error_code")
        want = sorted(tuple(r[c] for c in columns) for r in policy.evaluate(df, rules, default).collect())
        got = sorted(tuple(r[c] for c in columns) for r in policy.evaluate_table(df.withColumn("policy_hash", F.lit(name)), table).collect())
        assert [str(x) for x in got] == [str(x) for x in want]
    lost = policy.evaluate_table(df.withColumn("policy_hash", F.lit(None).cast("string")), table).select("action", "error_code", "fail_closed").distinct().collect()
    assert [tuple(r) for r in lost] == [("deny", policy.BROKEN, True)]
    none = policy.evaluate_table(df.withColumn("policy_hash", F.lit("h")), policy.rule_table(spark, {"h": {"mcp": {"default": "hold"}}}))
    assert {(r.action, r.fail_closed) for r in none.collect()} == {("hold", False)}


def test_plain_texts_are_found_in_long_texts(spark):
    import time

    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh \n", k=1_000_000))
    needles = [text[5000:5040], text[4090:4100], text[-9:], "zz", "abz", text[8191:8193], "é𝄞", "𝄞x", "q" * 5000, ""]
    texts = [(1, "s", "$.a", text), (2, "s", "$.b", "héé𝄞xyz"), (3, "t", "$.c", "q" * 9000), (4, "t", "$.d", ""), (5, "t", "$.e", "abz")]
    n, t = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "event_id int, session_id string, path string, text string")
    empty = spark.createDataFrame([], "event_id int, session_id string, matched_on string, path string, key string")
    began = time.time()
    got = {(r.needle, r.event_id) for r in search.touched(n, empty, t).where("matched_on = 'plain'").collect()}
    assert got == {(x, i) for x in needles if x for i, _, _, s in texts if x in s} and time.time() - began < 60


def test_signatures_of_known_keys():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = ed25519.public_key(seed)
    assert key.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    for message in (b"", b"head\n1\nabc"):
        assert ed25519.verify(message, key, ed25519.sign(message, seed)) and not ed25519.verify(message + b"x", key, ed25519.sign(message, seed))
    assert registry.QUERIES
