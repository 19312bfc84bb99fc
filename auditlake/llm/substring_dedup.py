"""Substring dedup by fixed-block anchors.

Documents are dealt into groups of a few MB. Each group lays non-overlapping blocks of half a window over its documents
(the reference index) and probes with every rolling window of that length; both meet in hash buckets. A match of a
whole window always holds one aligned block, so a block hash that is met nowhere else rules out every window over it.
Hits are extended to both sides, word by word, to all whole windows over them: each window is identified by 128 bits of two
hashes of its words, and the earliest document that holds it owns it. Runs of windows that start earlier elsewhere are the
maximal exact repeats, and their words go. A group sends each hash once, however often it repeats, so a hot passage costs one entry a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .storage import small_batches

OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"
_LAST = np.iinfo(np.int64).max


def _ordered(docs: pa.Table) -> pa.Table:
    """By doc_id, then text; null ids last."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class _Group:
    """The words of a group of documents, in document order, with hashes of its windows."""

    def __init__(self, docs: pa.Table, window: int):
        self.docs = _ordered(docs)
        self.data, self.offsets = T.utf8(self.docs["text"])
        self.data = self.data[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        parts = [T.split(d, o) + (d,) for _, _, d, o in T.chunks(self.data, self.offsets)]
        counts = [np.diff(f) for _, _, f, _ in parts]
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        self.words = np.concatenate([T.word_hashes(d, s, e) for s, e, _, d in parts]) if parts else np.zeros(0, np.uint64)
        self.long = T.fits(self.first, window)

    def ids(self) -> np.ndarray:
        return self.docs["doc_id"].cast(pa.int64()).fill_null(_LAST).to_numpy()


def _anchors(group: _Group, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all rolling blocks within documents of a window or more, their starts, and which lie on the grid."""
    block = window // 2
    inside = T.fits(group.first, block)
    lengths = np.diff(group.first)
    inside &= np.repeat(lengths >= window, lengths)[: len(inside)]
    at = np.flatnonzero(inside)
    start = np.repeat(group.first[:-1], lengths)[at]
    return T.rolling(group.words, block)[at], at, (at - start) % block == 0


def _bucketed(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), keys.astype(np.uint32)


def _probes(window: int, buckets: int):
    def run(key, docs):
        keys, _, grid = _anchors(_Group(docs, window), window)
        once, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        block = np.zeros(len(once), bool)
        block[back[grid]] = True
        bucket, low = _bucketed(once, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, low, block, many = bucket[order], low[order], block[order], (counts > 1)[order]
        here, at = np.unique(bucket, return_index=True)
        at = np.append(at, len(bucket))
        rows = [(int(b), low[i:j].tobytes(), np.packbits(block[i:j]).tobytes(), np.packbits(many[i:j]).tobytes()) for b, i, j in zip(here, at, at[1:])]
        b, k, m, n = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"bucket": pa.array(b, pa.int64()), "g": pa.array([key[0].as_py()] * len(rows), pa.int64()), "keys": pa.array(k, pa.binary()), "block": pa.array(m, pa.binary()), "many": pa.array(n, pa.binary())})

    return run


def _met(table):
    """Of one bucket: for each group, its keys that some block has and that stand at two places or more."""
    keys = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
    bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(table[name].to_pylist(), keys)])
    _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    block, many = np.zeros(len(count), bool), np.zeros(len(count), bool)
    block[back[bits("block") > 0]] = True
    many[back[bits("many") > 0]] = True
    hit = (block & (many | (count > 1)))[back]
    bucket, out, at = table["bucket"][0].as_py(), [], 0
    for g, k in zip(table["g"].to_pylist(), keys):
        if (mine := k[hit[at : at + len(k)]]).size:
            out.append((g, mine.tobytes()))
        at += len(k)
    g, k = zip(*out) if out else ((), ())
    return pa.table({"g": pa.array(g, pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "keys": pa.array(k, pa.binary())})


def _windows(group: _Group, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window."""
    return T.rolling(group.words, window, salt=0x5851F42D4C957F2D), T.rolling(group.words, window, salt=0x14057B7EF767814F)


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs with equal ones side by side, each first one first, and where a new pair begins."""
    order = np.argsort(a, kind="stable")
    same = a[order[1:]] == a[order[:-1]]
    if (same & (b[order[1:]] != b[order[:-1]])).any():  # two pairs that share a half
        order = np.lexsort((np.arange(len(a)), b, a))
        same = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    return order, np.concatenate([[True], ~same])[: len(a)]


def _first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place of each distinct pair."""
    order, new = _runs(a, b)
    return order[new]


def _among(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray) -> np.ndarray:
    """Which of the pairs are among the known ones."""
    likely = np.flatnonzero(np.isin(a, known_a))
    order, new = _runs(np.concatenate([known_a, a[likely]]), np.concatenate([known_b, b[likely]]))
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # the first of each run: a known one if there is any
    known = np.zeros(len(order), bool)
    known[order] = lead < len(known_a)
    out = np.zeros(len(a), bool)
    out[likely] = known[len(known_a) :]
    return out


def _owner_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (T.mix(keys ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)).astype(np.int64)


def _candidates(window: int, buckets: int):
    def run(key, docs, met):
        group = _Group(docs, window) if docs.num_rows else None
        rows = []
        if group is not None and met.num_rows and len(group.words) >= window:
            keys, at, _ = _anchors(group, window)
            bucket, low = _bucketed(keys, buckets)
            known = np.concatenate([np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, k in zip(met["bucket"].to_pylist(), met["keys"].to_pylist())])
            hit = np.zeros(len(group.words) + 1, np.int64)
            hit[at[np.isin(low.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32)), known)]] = 1
            sums = np.concatenate([[0], np.cumsum(hit)])
            starts = np.arange(len(group.long))
            near = sums[starts + window - window // 2 + 1] > sums[starts]
            at = np.flatnonzero(group.long & near)
            a, b = (h[at] for h in _windows(group, window))
            where = _first(a, b)
            once, check = a[where], b[where]
            ids = group.ids()[T.rows_of(group.first)[at[where]]]
            bucket = _owner_bucket(once, buckets)
            order = np.lexsort((ids, bucket))
            once, check, ids, bucket = once[order], check[order], ids[order], bucket[order]
            here, at = np.unique(bucket, return_index=True)
            at = np.append(at, len(bucket))
            for b, i, j in zip(here, at, at[1:]):
                own, count = np.unique(ids[i:j], return_counts=True)
                rows.append((int(b), once[i:j].tobytes(), check[i:j].tobytes(), own.tobytes(), count.astype(np.uint32).tobytes()))
        b, k, v, d, c = zip(*rows) if rows else ((), (), (), (), ())
        return pa.table({"bucket": pa.array(b, pa.int64()), "g": pa.array([key[0].as_py()] * len(rows), pa.int64()), "keys": pa.array(k, pa.binary()), "checks": pa.array(v, pa.binary()), "ids": pa.array(d, pa.binary()), "counts": pa.array(c, pa.binary())})

    return run


def _owned_elsewhere(table):
    """Of one bucket: for each group, its windows that a smaller doc_id of another group holds (of equal ones, the lesser group)."""
    keys, checks = ([np.frombuffer(k, np.uint64) for k in table[c].to_pylist()] for c in ("keys", "checks"))
    ids = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)) for d, c in zip(table["ids"].to_pylist(), table["counts"].to_pylist())])
    group = np.repeat(table["g"].to_numpy(), [len(k) for k in keys])
    every, check = np.concatenate(keys), np.concatenate(checks)
    order = np.lexsort((group, ids, check, every))
    later = np.zeros(len(every), bool)
    later[order[1:]] = (every[order[1:]] == every[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    out, at = [], 0
    for g, k, c in zip(table["g"].to_pylist(), keys, checks):
        mine = later[at : at + len(k)]
        if mine.any():
            out.append((g, k[mine].tobytes(), c[mine].tobytes()))
        at += len(k)
    g, k, c = zip(*out) if out else ((), (), ())
    return pa.table({"g": pa.array(g, pa.int64()), "keys": pa.array(k, pa.binary()), "checks": pa.array(c, pa.binary())})


def _kept(window: int):
    def run(docs, later):
        group = _Group(docs, window)
        gone = np.zeros(len(group.words) + 1, np.int64)
        at = np.flatnonzero(group.long)
        if at.size:
            a, b = (h[at] for h in _windows(group, window))
            repeat = np.ones(len(a), bool)
            repeat[_first(a, b)] = False
            if later.num_rows:
                repeat |= _among(a, b, *(np.concatenate([np.frombuffer(k, np.uint64) for k in later[c].to_pylist()]) for c in ("keys", "checks")))
            np.add.at(gone, at[repeat], 1)
            gone[window:] -= gone[:-window].copy() if len(gone) > window else 0
        covered = np.cumsum(gone)[:-1] > 0
        raw, out, spans = group.data.tobytes(), [], []
        for i in range(group.docs.num_rows):
            words = raw[group.offsets[i] : group.offsets[i + 1]].split()
            mask = covered[group.first[i] : group.first[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            if len(edge):
                words = [w for a, b in zip([0, *edge[1::2]], [*edge[::2], len(words)]) for w in words[a:b]]
            out.append(b" ".join(words))
        counts = np.diff(group.first)
        removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[group.first]) if len(covered) else np.zeros(len(counts), np.int64)
        return pa.table({"doc_id": group.docs["doc_id"].cast(pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(out, pa.binary()).cast(pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    return run


def remove_repeats(docs: DataFrame, window: int = 20, group_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """Drop every word covered by a window of ``window`` words that also starts earlier in the corpus.

    Earlier: a smaller doc_id, or the same document and an earlier start. Needs columns doc_id and text; others are
    ignored. Null texts have no words. Rows that share a doc_id count as separate documents in an order that a hash of their text
    gives; rows with a null doc_id come after all others. Empty tables give no rows. Groups of documents and buckets of hashes
    have so many bytes of text (from 4 to 16 MB and from 16 to 64 MB as the table grows), which bounds a task. Returns doc_id, n_words, n_removed, kept_text
    (kept words joined by a space) and removed (word spans, end exclusive).
    """
    if window < 4 or window % 2:
        raise ValueError("window must be even and at least 4")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sized = lambda given, low: given or min(4 * low, max(low, total // 1024))
    groups, buckets = total // sized(group_bytes, 4 << 20) + 1, total // sized(bucket_bytes, 16 << 20) + 1
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long"))
    by_group = dealt.groupBy("g")
    probes = by_group.applyInArrow(_probes(window, buckets), "bucket long, g long, keys binary, block binary, many binary")
    met = probes.groupBy("bucket").applyInArrow(_met, "g long, bucket long, keys binary")
    found = by_group.cogroup(met.groupBy("g")).applyInArrow(_candidates(window, buckets), "bucket long, g long, keys binary, checks binary, ids binary, counts binary")
    later = found.groupBy("bucket").applyInArrow(_owned_elsewhere, "g long, keys binary, checks binary")
    return by_group.cogroup(later.groupBy("g")).applyInArrow(_kept(window), OUT)
