"""Fleet replication checks over batches and chain state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_state(records: DataFrame) -> DataFrame:
    """Each chain's contiguous prefix, stored head and last arrival."""
    w = Window.partitionBy("chain_id").orderBy("seq")
    r = records.dropDuplicates(["chain_id", "seq"]).withColumn("n", F.row_number().over(w))
    return r.groupBy("chain_id").agg(F.count("*").alias("records"), F.max("seq").alias("head_seq"), F.max(F.when(F.col("seq") == F.col("n"), F.col("seq"))).alias("contiguous"), F.max("received_at").alias("last_seen"))


def forks(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered records that differ from the stored ones."""
    return offered.select("chain_id", "seq", F.col("hash").alias("offered_hash")).join(stored.select("chain_id", "seq", F.col("hash").alias("stored_hash")), ["chain_id", "seq"]).where("offered_hash <> stored_hash")


def new_records(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """The suffix to commit: what is not stored yet."""
    return offered.join(stored.select("chain_id", "seq"), ["chain_id", "seq"], "left_anti")


def silence(arrivals: DataFrame, seconds: int, now: Column | None = None, forked: DataFrame | None = None) -> DataFrame:
    """Outages: times without traffic of a chain of at least so many seconds, one row each; the open tail counts against ``now``. Forked chains are left out."""
    if forked is not None:
        arrivals = arrivals.join(forked.select("chain_id").distinct(), "chain_id", "left_anti")
    w = Window.partitionBy("chain_id").orderBy("received_at")
    after = F.coalesce(F.lead("received_at").over(w), now) if now is not None else F.lead("received_at").over(w)
    return arrivals.select("chain_id", F.col("received_at").alias("silent_from"), after.alias("silent_until")).where(F.unix_micros(F.col("silent_until").cast("timestamp")) - F.unix_micros(F.col("silent_from").cast("timestamp")) >= seconds * 1_000_000)


def lag(claims: DataFrame, state: DataFrame) -> DataFrame:
    """How far each chain's stored prefix is behind its newest claimed head."""
    newest = claims.groupBy("chain_id").agg(F.max("claimed").alias("claimed"))
    return newest.join(state.select("chain_id", "contiguous"), "chain_id", "left").select("chain_id", "claimed", F.greatest(F.lit(0), F.col("claimed") - F.coalesce("contiguous", F.lit(0))).alias("lag"))


_BATCHES = "chain_id string, from_seq long, to_seq long, records long, bytes long"


def _batched(most: int, most_bytes: int):
    """Greedy batches of rows in order of chain and seq."""

    def run(batches):
        now, out = None, []  # [chain, from, to, records, bytes]
        for batch in batches:
            out = []
            for chain, seq, size in zip(*(batch[c].to_pylist() for c in ("chain_id", "seq", "size"))):
                if now and now[0] == chain and seq == now[2] + 1 and now[3] < most and now[4] + size <= most_bytes:
                    now[2], now[3], now[4] = seq, now[3] + 1, now[4] + size
                else:
                    if now:
                        out.append(tuple(now))
                    now = [chain, seq, seq, 1, size]
            if out:
                yield _rows(out)
        if now:
            yield _rows([tuple(now)])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4))], ["chain_id", "from_seq", "to_seq", "records", "bytes"])


def delivery_batches(records: DataFrame, most: int = 512, most_bytes: int = 1 << 20) -> DataFrame:
    """Contiguous records (chain_id, seq, size) in batches of at most ``most`` and ``most_bytes``, one record at least."""
    rows = records.select("chain_id", F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"))
    return rows.repartition("chain_id").sortWithinPartitions("chain_id", "seq").mapInArrow(_batched(most, most_bytes), _BATCHES)


#: The records and bytes of a batch, and the bytes of a batch of one record.
MAX_RECORDS, MAX_BYTES, MAX_SINGLE_BYTES = 5000, 8 << 20, 32 << 20


def batch_faults(batches: DataFrame, protocol: int, most_records: int = MAX_RECORDS, most_bytes: int = MAX_BYTES, most_single: int = MAX_SINGLE_BYTES) -> DataFrame:
    """batches with the reason for which each is refused, or null: the first check that fails.

    A batch holds so many records and bytes at most; one of a single record, which can't be split, may be larger.

    Columns: protocol, chain_id, key, base_hash, from_seq, to_seq, head_seq, head_hash, records array<struct<seq, prev_hash, hash, event>>,
    body, body_digest. Seq 0 to 0 without records is a heartbeat.
    """
    hash64 = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    least = lambda c, n: F.coalesce(c >= n, F.lit(False))
    n, beat = F.size("records"), (F.col("from_seq") == 0) | (F.col("to_seq") == 0)
    good = lambda r: least(r["seq"], 1) & hash64(r["prev_hash"]) & hash64(r["hash"]) & F.coalesce(F.schema_of_variant(F.try_parse_json(r["event"])).startswith("OBJECT"), F.lit(False))
    tests = {
        "body digest differs": ~F.coalesce(F.sha2(F.encode("body", "UTF-8"), 256) == F.col("body_digest"), F.lit(False)),
        "unsupported protocol": ~F.coalesce(F.col("protocol") == protocol, F.lit(False)),
        "chain_id": ~hash64(F.col("chain_id")),
        "key": ~hash64(F.col("key")),
        "base_hash": ~hash64(F.col("base_hash")),
        "from_seq": ~least(F.col("from_seq"), 0),
        "to_seq": ~least(F.col("to_seq"), 0),
        "records": F.col("records").isNull(),
        "heartbeat": beat & ((F.col("from_seq") != 0) | (F.col("to_seq") != 0) | (n != 0)),
        "range": ~beat & (F.col("to_seq") < F.col("from_seq")),
        "count": ~beat & (n != F.col("to_seq") - F.col("from_seq") + 1),
        "record shape": ~F.coalesce(F.forall("records", good), F.lit(False)),
        "head": ~(least(F.col("head_seq"), 0) & hash64(F.col("head_hash"))),
        "too large": (n > most_records) | (F.octet_length("body") > F.when(n <= 1, most_single).otherwise(most_bytes)),
    }
    return batches.withColumn("reason", F.coalesce(*[F.when(t, F.lit(r)) for r, t in tests.items()]))


def attested(signatures: DataFrame, stored: DataFrame) -> DataFrame:
    """Each chain's greatest seq that a signature over the stored hash attests; repeated signatures count once."""
    once = signatures.dropDuplicates(["chain_id", "seq", "signature"])
    return once.join(stored.select("chain_id", "seq", F.col("hash").alias("chain_hash")), ["chain_id", "seq", "chain_hash"], "left_semi").groupBy("chain_id").agg(F.max("seq").alias("attested_seq"), F.count("*").alias("signatures"))


def enrolment(keys: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """(tenant, key, chain_id) by first_seen: a tenant's first key is trusted, later ones unless acknowledged are stored unattested; sibling: another chain had the key before."""
    first = keys.groupBy("tenant", "key").agg(F.min("first_seen").alias("key_seen"))
    nth = first.withColumn("n", F.row_number().over(Window.partitionBy("tenant").orderBy("key_seen", "key")))
    known = acknowledged.select("tenant", "key", F.lit(True).alias("acknowledged")).distinct()
    trust = nth.join(known, ["tenant", "key"], "left").select("tenant", "key", ((F.col("n") == 1) | F.coalesce("acknowledged", F.lit(False))).alias("trusted"))
    chains = keys.groupBy("tenant", "key", "chain_id").agg(F.min("first_seen").alias("first_seen"))
    sibling = F.row_number().over(Window.partitionBy("tenant", "key").orderBy("first_seen", "chain_id")) > 1
    return chains.withColumn("sibling", sibling).join(trust, ["tenant", "key"])


def hold_outcomes(holds: DataFrame, decisions: DataFrame, now: Column, ends: DataFrame | None = None) -> DataFrame:
    """Each hold's outcome: the first decision (approved, denied or cancelled) by its deadline, else timeout once that has passed, else pending.

    With ``ends`` (session_id, ended_at) the end of a hold's session settles it as session_end, unless a decision came before.
    """
    if ends is not None:
        last = ends.groupBy("session_id").agg(F.min("ended_at").alias("decided_at"))
        over = holds.join(last, "session_id").select("approval_id", "decided_at", F.lit("session_end").alias("decision"))
        decisions = decisions.select("approval_id", "decided_at", "decision").unionByName(over)
    timely = holds.select("approval_id", "timeout_at").join(decisions, "approval_id").where("decided_at < timeout_at")
    first = timely.groupBy("approval_id").agg(F.min_by("decision", F.struct("decided_at", "decision")).alias("first"))
    outcome = F.coalesce("first", F.when(F.col("timeout_at") <= now, "timeout").otherwise("pending"))
    return holds.join(first, "approval_id", "left").select("approval_id", outcome.alias("outcome"))


def delivery_status(reports: DataFrame) -> DataFrame:
    """Each chain's latest report (local_head, next_seq, state, last_error, updated_at) with its lag."""
    last = reports.groupBy("chain_id").agg(F.max_by(F.struct("local_head", "next_seq", "state", "last_error"), "updated_at").alias("r")).select("chain_id", "r.*")
    return last.withColumn("lag", F.greatest(F.lit(0), F.col("local_head") - (F.col("next_seq") - 1)))


def _admitted(cap: int):
    def run(batches):
        group, held = object(), 0
        for batch in batches:
            flags = []
            for g, size in zip(batch["g"].to_pylist(), batch["size"].to_pylist()):
                if g != group:
                    group, held = g, 0
                keep = held + size <= cap
                held += size if keep else 0
                flags.append(keep)
            yield pa.RecordBatch.from_arrays([batch["g"], pa.array(flags, pa.bool_())], ["g", "admitted"])

    return run


def admitted(records: DataFrame, by: str, order: str, size: str, cap: int) -> DataFrame:
    """Records kept under a byte cap a run, and what was dropped; what is dropped takes no room."""
    rows = records.select(F.col(by).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    kind = f"g {records.schema[by].dataType.simpleString()}, admitted boolean"
    told = rows.repartition("g").sortWithinPartitions("g", "o").select("g", "size").mapInArrow(_admitted(cap), kind)
    return told.groupBy(F.col("g").alias(by)).agg(F.count_if("admitted").alias("kept"), F.count_if(~F.col("admitted")).alias("dropped_at_least"))


def ownership(batches: DataFrame, owners: DataFrame) -> DataFrame:
    """Batches of chains that belong to another key or tenant."""
    return batches.alias("b").join(owners.alias("o"), "chain_id").where("b.key <> o.key or b.tenant <> o.tenant").select("b.*")
