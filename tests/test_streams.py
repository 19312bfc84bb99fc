"""Streamed commits over several micro-batches that overlap, leave gaps and fork."""

from auditlake.functions.canonical import GENESIS_HASH
from auditlake.plans import registry
from auditlake.streaming import streams


def test_a_key_is_kept_once_over_all_batches(spark, tmp_path):
    out = f"{tmp_path}/out"
    write = streams.commit_new(out, ["event_id"])
    batches = [[1, 2, 2, None], [2, 3, None], [4]]
    for number, ids in enumerate([*batches, batches[2]]):
        write(spark.createDataFrame([(i, 0) for i in ids], "event_id long, user_id long"), min(number, 2))
    write(spark.createDataFrame([(i, 0) for i in batches[0]], "event_id long, user_id long"), 0)
    assert sorted(str(r.event_id) for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "4", "None"]


def test_batches_of_chains_are_admitted_or_refused(spark, tmp_path):
    out, refused = f"{tmp_path}/out", f"{tmp_path}/refused"
    write = streams.commit_chains(out, refused)

    def record(chain, seq, fork=""):
        return chain, seq, GENESIS_HASH if seq == 1 else f"{chain}{seq - 1}{fork}", f"{chain}{seq}{fork}"

    first = [record("a", 1), record("a", 2), record("b", 1), record("c", 2), ("d", 1, "elsewhere", "d1"), record("f", 1), ("g", 1, GENESIS_HASH, "g1"), ("g", 2, "other", "g2")]
    second = [record("a", 2), record("a", 3), record("b", 3), record("c", 1), ("f", 1, GENESIS_HASH, "rewritten"), record("f", 2), record("h", 1), ("h", 1, GENESIS_HASH, "rewritten")]
    third = [record("a", 4, "x"), record("b", 2), record("f", 2), record("h", 1)]
    for number, rows in ((0, first), (1, second), (1, second), (2, third)):
        write(spark.createDataFrame(rows, "chain_id string, seq long, prev_hash string, hash string"), number)
    assert sorted((r.chain_id, r.seq) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1), ("f", 1)]
    got = sorted((r.batch, r.chain_id, r.reason) for r in spark.read.parquet(refused).collect())
    assert got == [(0, "c", "gap"), (0, "d", "bad_genesis"), (0, "g", "bad_link"), (1, "b", "gap"), (1, "f", "fork"), (1, "h", "fork"), (2, "a", "fork"), (2, "f", "fork"), (2, "h", "fork")]


def test_sealed_chains_stream_in_whole(spark):
    d = "/root/testdata/sf0.001"
    want = registry.QUERIES["seal_chain"](spark, d)
    assert sorted(map(tuple, registry.QUERIES["stream_chain_ingest"](spark, d).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
