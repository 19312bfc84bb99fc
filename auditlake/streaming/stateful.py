"""Streams that keep a state for each key: chains that are ingested, chains that fall silent, requests that wait for their response.

State lives in the state store, which the checkpoint holds: a micro-batch reads and writes the state of its own keys only, so
its time doesn't grow with what is stored, and after a loss the batch runs again from the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.canonical import GENESIS_HASH

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """State of the processors below is kept by RocksDB: it may be larger than memory."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


def ingest_once(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, over all that the stream has brought and will bring: the keys are the state."""
    return events.dropDuplicates(keys)


def by_batch(*paths: str, split: Callable[[DataFrame], list[DataFrame]] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer: a folder for each batch below each path, overwritten when the batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        parts = split(batch.persist()) if split else [batch]
        for path, part in zip(paths, parts):
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if split:
            batch.unpersist()

    return write


INGESTED = "chain_id string, seq long, prev_hash string, hash string, reason string, stored_hash string"


#: Hashes of a chain that its state keeps as one entry: each entry that is read or written is a call to the state store.
_BLOCK = 512


class _Chain(StatefulProcessor):
    """A chain's head and hashes, the latter by blocks of ``_BLOCK`` seqs; admits a suffix or nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, hash string, forked boolean")
        self.blocks = handle.getMapState("blocks", "block long", "hashes array<string>")

    def _block(self, number: int) -> list[str]:
        return list(self.blocks.getValue((number,))[0]) if self.blocks.containsKey((number,)) else []

    def _store(self, seq: int, hashes: list[str]) -> None:
        """Hashes that follow the one of seq; all up to it are stored."""
        for number in range(seq // _BLOCK, -(-(seq + len(hashes)) // _BLOCK)):
            start = max(number * _BLOCK, seq)
            old = self._block(number) if start > number * _BLOCK else []
            self.blocks.updateValue((number,), ([*old, *hashes[start - seq : (number + 1) * _BLOCK - seq]],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (chain,) = key
        seq, hash_, forked = self.head.get() or (0, GENESIS_HASH, False)
        offered = sorted({(r.seq, r.hash, r.prev_hash) for r in rows if r.seq is not None and r.hash is not None}, key=lambda r: (r[0], r[1], r[2] or ""))
        refusal = lambda r, reason, known=None: Row(chain_id=chain, seq=r[0], prev_hash=r[2], hash=r[1], reason=reason, stored_hash=known)
        if forked:
            yield from (refusal(r, "fork") for r in offered[:1])
            return
        branches, number, block = [], None, []
        for r, after in zip(offered, [*offered[1:], None]):
            known = None
            if 0 < r[0] <= seq:  # in order of seq, so that each block is read once
                if number != (r[0] - 1) // _BLOCK:
                    number = (r[0] - 1) // _BLOCK
                    block = self._block(number)
                known = block[(r[0] - 1) % _BLOCK]
            if known is not None and known != r[1]:
                branches.append(refusal(r, "fork", known))
            elif after is not None and after[0] == r[0]:
                branches.append(refusal(after, "fork", r[1]))
        new = [r for r in offered if r[0] > seq or r[0] < 1]
        if not branches and new:
            first = new[0]
            if first[0] != seq + 1 or new[-1][0] - first[0] + 1 != len(new):
                yield refusal(first, "gap")
                return
            if first[2] != hash_:
                if seq == 0:
                    yield refusal(first, "bad_genesis")
                    return
                branches.append(refusal(first, "fork", hash_))
            broken = [b for a, b in zip(new, new[1:]) if b[2] != a[1]]
            if not branches and broken:
                yield refusal(broken[0], "bad_link")
                return
        if branches:
            self.head.update((seq, hash_, True))
            yield from branches
            return
        self._store(seq, [r[1] for r in new])
        for r in new:
            yield Row(chain_id=chain, seq=r[0], prev_hash=r[2], hash=r[1], reason=None, stored_hash=None)
        if new:
            self.head.update((new[-1][0], new[-1][1], False))

    def close(self) -> None:
        pass


def ingest_chains(records: DataFrame) -> DataFrame:
    """Offered chain records (chain_id, seq, prev_hash, hash) as they are admitted, by a chain's state.

    A chain's new suffix is admitted (reason is null) or nothing of it. Records that are stored already must be the same and are
    not returned again; otherwise the chain has forked: each offered record that differs comes out with the stored hash beside its
    own, both branches, and the chain is refused from then on. The suffix must start right after the head (gap), link to it
    (bad_genesis at the start; a fork later) and within itself (bad_link). Rows without a seq or hash are left out.
    """
    with_state_store(records.sparkSession)
    rows = records.select("chain_id", F.col("seq").cast("long").alias("seq"), "prev_hash", "hash")
    return rows.groupBy("chain_id").transformWithState(_Chain(), INGESTED, "Append", "None")


def admitted_and_refused(batch: DataFrame) -> list[DataFrame]:
    """What ``ingest_chains`` gave, apart: records to store, and refusals."""
    return [batch.where("reason is null").select("chain_id", "seq", "prev_hash", "hash"), batch.where("reason is not null")]


def _time(us: int | None) -> datetime | None:
    return None if us is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


OUTAGES = "chain_id string, silent_from timestamp, silent_until timestamp, state string"


class _Silence(StatefulProcessor):
    """Arrivals of a chain that the watermark hasn't passed yet, the last one that it has, and whether its silence was told."""

    def __init__(self, seconds: int):
        self.limit = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, told boolean")
        self.waiting = handle.getListState("waiting", "at long")

    def _advance(self, chain: str, arrived: list[int], watermark: int) -> Iterator[Row]:
        last, told = self.last.get() or (None, False)
        waiting = sorted([r[0] for r in self.waiting.get()] + arrived)
        later = [t for t in waiting if t > watermark]
        for t in waiting[: len(waiting) - len(later)]:
            if last is not None and t - last >= self.limit:
                yield self._row(chain, last, t, "closed")
            if last is None or t > last:
                last, told = t, False
        if last is not None and not told and watermark - last >= self.limit:
            told = True
            yield self._row(chain, last, None, "open")
        self.waiting.clear()
        if later:
            self.waiting.put([(t,) for t in later])
        if last is not None:
            self.last.update((last, told))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = later[:1] + ([last + self.limit] if last is not None and not told else [])
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))

    @staticmethod
    def _row(chain: str, start: int, end: int | None, state: str) -> Row:
        return Row(chain_id=chain, silent_from=_time(start), silent_until=_time(end), state=state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._advance(key[0], [r.at for r in rows], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def silence_alerts(arrivals: DataFrame, seconds: int, delay: str = "0 seconds", forked: DataFrame | None = None) -> DataFrame:
    """Outages of chains over a stream of arrivals (chain_id, received_at): one row when a silence is noticed, one when it ends.

    A chain is silent once the watermark is ``seconds`` past its last arrival: a row with state open and no end, once an outage.
    The next arrival closes it: a row with both ends, which also comes where the silence ended before it was noticed. Arrivals may be
    late by ``delay``. Chains of ``forked`` are left out.
    """
    with_state_store(arrivals.sparkSession)
    if forked is not None:
        arrivals = arrivals.join(forked.select("chain_id").distinct(), "chain_id", "left_anti")
    rows = arrivals.select("chain_id", "received_at", F.unix_micros("received_at").alias("at")).withWatermark("received_at", delay)
    return rows.groupBy("chain_id").transformWithState(_Silence(seconds), OUTAGES, "Append", "EventTime")


def outages(alerts: DataFrame, now) -> DataFrame:
    """The alerts so far as ``replica.silence`` has outages: one row each, what is still open until ``now``."""
    return alerts.groupBy("chain_id", "silent_from").agg(F.max("silent_until").alias("silent_until")).select("chain_id", "silent_from", F.coalesce("silent_until", now).alias("silent_until"))


def live_request_response(requests: DataFrame, responses: DataFrame, keys: list[str], within: str, delay: str = "0 seconds") -> DataFrame:
    """Requests (keys, asked_at) with their responses (keys, answered_at) as both arrive: answered, unanswered or orphan_response.

    An id is used once. A response counts up to ``within`` after its request; one that comes later, or before it, is an orphan, and the
    request unanswered. Both are told when the watermark has passed the time in which the other could come; until then rows wait
    in the state, so it is bounded by what arrives in that time.
    """
    q, r = requests.withWatermark("asked_at", delay).alias("q"), responses.withWatermark("answered_at", delay).alias("r")
    timely = (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    same = [F.col(f"q.{k}") == F.col(f"r.{k}") for k in keys]
    joined = q.join(r, [*same, timely], "full_outer")
    status = F.when(F.col("asked_at").isNull(), "orphan_response").when(F.col("answered_at").isNull(), "unanswered").otherwise("answered")
    ids = [F.coalesce(F.col(f"q.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    took = F.unix_micros("answered_at") - F.unix_micros("asked_at")
    return joined.select(*ids, "asked_at", "answered_at", (took / 1000).alias("duration_ms"), status.alias("status"))


SETTLED = "approval_id string, outcome string, settled_at timestamp"


class _Hold(StatefulProcessor):
    """A hold's deadline and its first decision so far; told once, when the watermark has passed what settles it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at long, told boolean")
        self.first = handle.getValueState("first", "at long, decision string")

    def _settle(self, approval: str, watermark: int) -> Iterator[Row]:
        deadline, told = self.deadline.get() or (None, False)
        if deadline is None or told:
            return
        first = self.first.get()
        timely = first is not None and first[0] < deadline
        at, outcome = (first[0], first[1]) if timely else (deadline, "timeout")
        if watermark >= at:
            self.deadline.update((deadline, True))
            self.first.clear()
            yield Row(approval_id=approval, outcome=outcome, settled_at=_time(at))
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        deadline, told = self.deadline.get() or (None, False)
        first = self.first.get()
        for r in rows:
            if r.decision is None:
                deadline = r.until if deadline is None else min(deadline, r.until)
            elif first is None or (r.at, r.decision) < tuple(first):
                first = (r.at, r.decision)
        if deadline is not None:
            self.deadline.update((deadline, told))
        if first is not None and not told:
            self.first.update(tuple(first))
        yield from self._settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def live_hold_outcomes(holds: DataFrame, decisions: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Holds (approval_id, created_at, timeout_at) as they are settled by decisions (approval_id, decided_at, decision), or by their deadline.

    The first decision before the deadline wins, whatever the order in which they arrive within ``delay``; ties go to the lesser
    word. A hold is told once, with the time that settled it: what ``replica.hold_outcomes`` says of all that aren't pending.
    """
    with_state_store(holds.sparkSession)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = lambda kind: F.lit(None).cast(kind)
    asked = holds.select("approval_id", F.col("created_at").cast("timestamp").alias("time"), none("long").alias("at"), none("string").alias("decision"), us("timeout_at").alias("until"))
    said = decisions.select("approval_id", F.col("decided_at").cast("timestamp").alias("time"), us("decided_at").alias("at"), "decision", none("long").alias("until")).where("decision is not null")
    rows = asked.unionByName(said).withWatermark("time", delay)
    return rows.groupBy("approval_id").transformWithState(_Hold(), SETTLED, "Append", "EventTime")
