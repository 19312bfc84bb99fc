"""Wire lines, recovery, protected values and bundles on small fixtures."""

import hashlib

from pyspark.sql import functions as F

from auditlake.operators import capture, integrity, redaction


def _ref(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_lines(spark):
    lines = ['{"id":1,"method":"a"}', '{"method":"a"}', '{"id":"x","result":1}', '{"id":true,"method":"a"}', '[{"id":2,"method":"b"},{"method":"c"},3]', "[]", "{", None, '"text"', '{"id":9}' + " " * 100]
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {(r.n, r.item): (r["class"], r.request_id, r.method) for r in capture.classify_lines(rows, most_bytes=100).collect()}
    assert got == {
        (0, 0): ("request", "1", "a"), (1, 0): ("notification", None, "a"), (2, 0): ("response", "x", None), (3, 0): ("notification", None, "a"),
        (4, 0): ("request", "2", "b"), (4, 1): ("notification", None, "c"), (4, 2): ("other", None, None),
        (6, 0): ("unparseable", None, None), (7, 0): ("unparseable", None, None), (8, 0): ("other", None, None), (9, 0): ("oversized", None, None),
    }


def test_recovery_is_done_once(spark):
    schema = "action_id string, attempt_id string, phase string, seq long, event_id string, decision string, run_id string, session_id string, source string"
    events = spark.createDataFrame([("a", "1", "attempt", 1, "e1", "deny", "r1", "s1", "proxy"), ("b", "1", "attempt", 2, "e2", None, "r2", "s2", "hook"), ("c", "1", "attempt", 3, "e3", None, "r2", "s3", "proxy"), ("d", "1", "attempt", 4, "e4", None, "r1", "s1", "proxy"), ("d", "1", "outcome", 5, "e5", None, "r1", "s1", "proxy")], schema)
    dead = spark.createDataFrame([("r1", "t"), ("r9", "u")], "run_id string, started_at string")
    ended = spark.createDataFrame([("s2",), ("s3",)], "session_id string")
    lost = capture.recovered_outcomes(events, dead, ended)
    assert {(r.action_id, r.event_id, r.outcome) for r in lost.collect()} == {("a", _ref("e1:recovered-outcome"), "denied"), ("b", _ref("e2:recovered-outcome"), "unknown")}
    again = events.unionByName(lost.withColumn("phase", F.lit("outcome")).withColumn("seq", F.lit(9).cast("long")).drop("outcome", "reason"), allowMissingColumns=True)
    assert capture.recovered_outcomes(again, dead, ended).count() == 0
    gaps = capture.recovery_gaps(events, dead)
    assert {(r.run_id, r.session_id, r.ts) for r in gaps.collect()} == {("r1", "s1", "t"), ("r9", None, "u")}
    noted = events.unionByName(gaps.select("event_id", "run_id", "session_id"), allowMissingColumns=True)
    assert capture.recovery_gaps(noted, dead).count() == 0


def test_protected_values_have_one_reference(spark):
    rows = spark.createDataFrame([(1, "s3cr3t"), (2, "Bearer long-secret-value"), (3, "has s3cr3t inside"), (4, None), (5, "")], "n int, t string")
    got = {r.n: r.r for r in rows.select("n", redaction.guarded_ref(F.col("t"), ["s3cr3t", "long-secret-value", ""]).alias("r")).collect()}
    one = _ref("[brokered-credential]")
    assert got == {1: one, 2: one, 3: _ref("has s3cr3t inside"), 4: None, 5: _ref("")}


def test_manifests(spark):
    columns = "bundle_id string, event_count long, from_seq long, to_seq long, head_hash string, signature_seq long, signature_hash string, public_key string, pem_key string, public_key_pem string, pem_file string"
    claims = spark.createDataFrame([("good", 2, 1, 2, "h2", 2, "h2", "AB", "ab", "p", "p"), ("cut", 3, 1, 3, "h3", 3, "h3", "ab", "ab", "p", "q"), ("none", 1, 1, 1, "h", 1, "h", "ab", "ab", "p", "p")], columns)
    records = spark.createDataFrame([(b, n, f"h{n}") for b in ("good", "cut") for n in (1, 2)], "bundle_id string, seq long, hash string")
    problems = integrity.manifest_problems(claims, records)
    assert {(r.bundle_id, r.check) for r in problems.collect()} == {("cut", "event_count"), ("cut", "to_seq"), ("cut", "head_hash"), ("cut", "public_key_pem"), ("none", "event_count")}
    assert {(r.bundle_id, r.ok, r.failed) for r in integrity.bundle_verdicts(claims, problems).collect()} == {("good", True, None), ("cut", False, "event_count"), ("none", False, "event_count")}
