"""Equal rows in large numbers, and how plans grow with their tables."""

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from auditlake.functions import canonical as C
from auditlake.operators import search
from auditlake.plans import live, records, registry
from auditlake.sources import adapters, shared
from auditlake.streaming import stateful


def test_equal_spans_are_merged_alike(spark, tmp_path):
    n = F.col("id")
    props = F.concat(F.lit('{"k": '), (n * 7919 % 100).cast("string"), F.lit("}"))
    ts = F.timestamp_seconds(F.lit(1704067200) + n % 30 * 86400).cast("timestamp_ntz").alias("ts")
    events = spark.range(300_000).select(n.alias("event_id"), ts, (n * 31 % 1500).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), props.alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["merge_spans"](spark, str(tmp_path))
    got.select("session_id", "start", "end", "spans").write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    con.sql(f"CREATE TABLE want AS {registry.SQL['merge_spans']}")
    con.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    apart = lambda a, b: con.sql(f"SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b})").fetchall()[0][0]
    assert con.sql("SELECT sum(spans) FROM got").fetchall()[0][0] == 300_000
    assert (apart("want", "got"), apart("got", "want")) == (0, 0)


def _many_events(spark, n: int):
    """Events that all hold the same text, and a key of their own."""
    event = F.concat(F.lit('{"kind":"tool_call","note":"same text","own":{"redacted":true,"len":1,"ref":"'), C.ref(F.col("id").cast("string")), F.lit('"}}'))
    return spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 7).cast("string").alias("session_id"), event.alias("event"))


def _most_in_a_task(df) -> int:
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_a_text_of_all_events_is_met_by_many_tasks(spark, monkeypatch, sent):
    for module in (shared, search):
        monkeypatch.setattr(module, "ROWS_PER_TASK", 500, raising=False)
    for name, value in (("_FREQUENT", 100), ("_SHARE", 1.0), ("_MOST_BROADCAST", sent)):
        monkeypatch.setattr(search, name, value, raising=False)
    needles = spark.createDataFrame([("same",), ("text",), ("tool_",), ("absent",), ("",)], "needle string").union(spark.range(0, 2000, 2).select(F.col("id").cast("string")))
    got = search.touched(needles, shared.written(search.event_index(_many_events(spark, 2000)), "index"))
    counts = {r.matched_on: r["count"] for r in got.groupBy("matched_on").count().collect()}
    assert counts == {"plain": 6000, "ref": 1000}
    assert got.select("needle", "event_id").distinct().count() == 7000
    assert _most_in_a_task(got) < 1000


def test_attempts_are_made_by_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 500, raising=False)
    attempts = registry._attempts(spark, "/root/testdata/sf0.001")
    assert _most_in_a_task(attempts) < 1500
    assert attempts.where("phase = 'attempt'").count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()


def test_a_slice_of_many_files_is_one_micro_batch(spark, tmp_path):
    parts = [spark.range(i * 8, i * 8 + 8).repartition(4) for i in range(2)]
    live._fed(spark, {f"{tmp_path}/in": parts}, lambda s: s, stateful.by_batch(f"{tmp_path}/out"), f"{tmp_path}/state")
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 8
    assert sorted((r.batch, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(i // 8, i) for i in range(16)]


def test_rows_are_spread_over_all_tasks_without_a_sort(spark):
    some = adapters.spread(spark.range(10_000, numPartitions=1).select(F.col("id").alias("event_id")), "event_id")
    assert _most_in_a_task(some) < 3500
    assert some.distinct().count() == 10_000
    for df in (some, records._with_secrets(spark, "/root/testdata/sf0.001"), registry.QUERIES["secret_redaction"](spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "RoundRobinPartitioning" not in plan  # dealing rows in turn sorts what a task has read


def test_no_task_writes_a_whole_slice_of_chains(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        for part in live._offered(spark, "/root/testdata/sf0.001", sound=False)[:2]:
            assert _most_in_a_task(part) < 0.6 * part.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


class _State:
    """A state of a processor that counts the calls to it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _call(self, key, value=None):
        self.calls += 1
        return self.held.get(key) if value is None else self.held.update({key: value})

    def get(self):
        return self._call(())

    def update(self, value):
        self._call((), value)

    def containsKey(self, key):
        return self._call(key) is not None

    getValue = updateValue = _call

    def getValueState(self, name, *kinds):
        return self.__dict__.setdefault(name, _State())

    getMapState = getValueState


def test_a_chain_calls_its_state_for_blocks_of_records():
    handle, chain = _State(), stateful._Chain()
    chain.init(handle)
    record = lambda seq, hash_=None: Row(chain_id="c", seq=seq, prev_hash=f"h{seq - 1}" if seq > 1 else C.GENESIS_HASH, hash=hash_ or f"h{seq}")
    offer = lambda rows: [(r.seq, r.hash, r.reason, r.stored_hash) for r in chain.handleInputRows(("c",), iter(rows), None)]
    end = 0
    for start, stop in ((1, 700), (690, 700), (500, 1024), (1025, 1026), (3, 3000)):  # ends within blocks and at their edges, and overlaps
        assert offer(record(i) for i in range(start, stop + 1)) == [(i, f"h{i}", None, None) for i in range(end + 1, stop + 1)]
        end = stop
    assert sum(s.calls for s in (handle.head, *[s for n, s in vars(handle).items() if n in ("hashes", "blocks")])) < 100
    assert offer([record(3002)]) == [(3002, "h3002", "gap", None)]
    assert offer(record(i, "x" if i in (2, 512, 513, 3000) else None) for i in range(1, 3001)) == [(i, "x", "fork", f"h{i}") for i in (2, 512, 513, 3000)]
    assert offer([record(3001)]) == [(3001, "h3001", "fork", None)]
