"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt to buckets by vector length, longest first, and queries to chunks of like length; both are rows of one
matrix each. Buckets meet the queries in rounds of 1, 1, 2, 4, ... buckets. After a round each query's k-th best score, over
its own length and a bucket's greatest, is the cosine that the bucket has to reach. Chunks are sent only to buckets that one of
their queries can reach; there a cosine above 1 drops the query, one close to 1 leaves vectors that agree in the query's
largest coordinates, a lower one those that are long enough; their products are verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

OUT = "query_id long, rank int, vec_id long, score long"
_BLOCK = "bucket int, place int, width int, longest double, ids binary, matrix binary, kind string"
_BEST = "chunk long, ids binary, scores binary, wide boolean"
_STATE = "chunk long, width int, need double, ids binary, matrix binary, kind string, best_ids binary, best_scores binary, wide boolean"
_CLOSE = 0.9  # local cosine from which coordinates prune
_TOP, _LOW = (1 << 63) - 1, -(1 << 63)


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(1))


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The matrix in the smallest type that holds it."""
    lo, hi = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    return matrix.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def _blocks(rows: int):
    """Matrices of up to ``rows`` vectors of one width, in the order of the input."""

    def emit(bucket, place, width, ids, parts):
        matrix = np.concatenate(parts)
        norm = _norms(matrix)
        order = np.argsort(-norm, kind="stable")
        matrix = _narrow(matrix[order])
        values = ([bucket], [place], [width], [float(norm.max(initial=0))], [np.concatenate(ids)[order].tobytes()], [matrix.tobytes()], [matrix.dtype.str])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.string()))], ["bucket", "place", "width", "longest", "ids", "matrix", "kind"])

    def run(batches):
        from pyspark import TaskContext

        bucket, place, held, width, ids, parts = TaskContext.get().partitionId(), 0, 0, None, [], []
        for batch in batches:
            size = batch["width"].to_numpy()
            edges = np.flatnonzero(np.diff(size)) + 1
            for a, b in zip([0, *edges], [*edges, len(size)]):
                while a < b:
                    if held and (width != size[a] or held >= rows):
                        yield emit(bucket, place, width, ids, parts)
                        place, held, ids, parts = place + 1, 0, [], []
                    width = int(size[a])
                    end = min(b, a + rows - held)
                    ids.append(batch["vec_id"].slice(a, end - a).to_numpy())
                    parts.append(batch["v"].slice(a, end - a).flatten().to_numpy().reshape(end - a, width))
                    held, a = held + end - a, end
        if held:
            yield emit(bucket, place, width, ids, parts)

    return run


class _Search:
    """A chunk of queries, each with its k + 1 best (score, -vec_id) so far: its own row may be among them."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
        self.whole, self.k = queries, k
        self.q = queries.astype(np.float64)
        self.norm = _norms(queries)
        self.ids, self.scores = list(ids), list(scores)
        self.floor = np.array([s[k] if len(s) > k else -np.inf for s in self.scores], np.float64)
        self.lead = np.argsort(-np.abs(self.q), axis=1)[:, :4]

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        norm = _norms(matrix)  # longest first
        reach = self.norm * norm[0] * (1 + 1e-9)
        live = np.flatnonzero(~(self.floor > reach))
        local = np.where(reach > 0, self.floor / np.where(reach > 0, reach, 1), -1)
        big = int((norm * self.norm.max(initial=0) >= 2.0**52).sum())  # products beyond exact doubles, the longest
        kind = np.float32 if norm[0] * self.norm.max(initial=0) < 2.0**23 else np.float64
        c = matrix.astype(kind)
        if big:
            for i in live:
                self.keep(i, ids[:big], matrix[:big].astype(object) @ self.whole[i].astype(object))
            ids, matrix, norm, c = ids[big:], matrix[big:], norm[big:], c[big:]
            if not len(ids):
                return
        close = (local > _CLOSE)[live]
        for i in live[close]:  # coordinates: what the largest four leave is bounded by the lengths of the rest
            use = int(np.searchsorted(-norm, -self.floor[i] / self.norm[i] * (1 - 1e-9), "right"))
            lead = self.lead[i]
            some = c[:use, lead].astype(np.float64)
            rest = np.sqrt(np.maximum(0, norm[:use] ** 2 - (some**2).sum(1))) * np.sqrt(max(0.0, self.norm[i] ** 2 - (self.q[i, lead] ** 2).sum()))
            near = np.flatnonzero((some @ self.q[i, lead] + rest) * (1 + 1e-9) + 1e-6 >= self.floor[i])
            self.keep(i, ids[near], matrix[near].astype(np.int64) @ self.whole[i].astype(np.int64))
        for at in range(0, len(far := live[~close]), 256):
            some = far[at : at + 256]
            least = np.where(self.norm[some] > 0, self.floor[some] / np.maximum(self.norm[some], 1e-300), -np.inf).min()
            use = int(np.searchsorted(-norm, -least * (1 - 1e-9), "right")) if least > 0 else len(norm)
            scores = self.q[some].astype(kind) @ c[:use].T
            if use > self.k + 1:
                cut = np.maximum(np.partition(scores, use - self.k - 1, axis=1)[:, use - self.k - 1], self.floor[some])
            else:
                cut = self.floor[some]
            row, column = np.nonzero(scores >= cut[:, None])
            at_row = np.searchsorted(row, np.arange(len(some) + 1))
            found = scores[row, column].astype(np.int64)
            for n, i in enumerate(some):
                a, b = at_row[n], at_row[n + 1]
                if a < b:
                    self.keep(i, ids[column[a:b]], found[a:b])

    def keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        if scores.dtype == object:  # exact integers of any size
            order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[: self.k + 1]
        else:
            order = np.lexsort((ids, -scores))[: self.k + 1]
        self.ids[i], self.scores[i] = ids[order], scores[order]
        if len(order) > self.k:
            least = float(scores[order[-1]]) if scores.dtype != object else np.nextafter(float(scores[order[-1]]), -np.inf)
            self.floor[i] = max(self.floor[i], least)

    def clear(self) -> None:
        """Forget what was found, but for how much it takes to be among the best."""
        self.ids, self.scores = [np.zeros(0, np.int64)] * len(self.ids), [np.zeros(0, np.int64)] * len(self.ids)


def _packed(search: _Search) -> tuple[bytes, bytes, bool]:
    """Ids and scores of each query, behind their count; scores as decimal texts if any leaves 64 bits."""
    count = np.array([len(x) for x in search.ids], np.int64)
    ids = np.concatenate([count, *search.ids]).astype(np.int64)
    wide = any(x.dtype == object and any(not _LOW <= s <= _TOP for s in x) for x in search.scores)
    if wide:
        return ids.tobytes(), ",".join(str(int(s)) for x in search.scores for s in x).encode(), True
    return ids.tobytes(), np.concatenate([np.zeros(0, np.int64), *[np.array([int(s) for s in x], np.int64) if x.dtype == object else x for x in search.scores]]).tobytes(), False


def _unpacked(queries: int, ids: bytes, scores: bytes, wide: bool) -> tuple[list, list]:
    every = np.frombuffer(ids, np.int64)
    count, every = every[:queries], every[queries:]
    values = np.array([int(s) for s in scores.split(b",")] if scores else [], object) if wide else np.frombuffer(scores, np.int64)
    cuts = np.cumsum(count)[:-1]
    return np.split(every, cuts), np.split(values, cuts)


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["matrix"], row["kind"]).reshape(-1, row["width"])


def _search_of(row: dict, k: int) -> _Search:
    queries = _matrix(row)
    return _Search(queries, *_unpacked(len(queries), row["best_ids"], row["best_scores"], row["wide"]), k)


def _met(k: int):
    """A chunk of queries against the blocks of one bucket: each query's best there."""

    def run(key, chunk, blocks):
        out = []
        if blocks.num_rows:
            for row in chunk.to_pylist():
                search = _search_of(row, k)
                search.clear()
                for block in sorted(blocks.to_pylist(), key=lambda b: b["place"]):
                    search.meet(np.frombuffer(block["ids"], np.int64), _matrix(block))
                out.append((row["chunk"], *_packed(search)))
        columns = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], names=["chunk", "ids", "scores", "wide"])

    return run


def _merged(k: int):
    """A chunk with what its buckets have found."""

    def run(key, chunk, found):
        row = chunk.to_pylist()[0]
        search = _search_of(row, k)
        for f in found.to_pylist():
            for i, (ids, scores) in enumerate(zip(*_unpacked(len(search.ids), f["ids"], f["scores"], f["wide"]))):
                if len(ids):
                    search.keep(i, ids, scores)
        need = np.where(search.floor > 0, search.floor / np.maximum(search.norm, 1e-300), 0.0).min(initial=np.inf)
        ids, scores, wide = _packed(search)
        return pa.table({"chunk": [row["chunk"]], "width": pa.array([row["width"]], pa.int32()), "need": [float(need)], "ids": [row["ids"]], "matrix": [row["matrix"]], "kind": [row["kind"]], "best_ids": [ids], "best_scores": [scores], "wide": [wide]})

    return run


def _answers(k: int, none: int):
    """The k best of each query, without its own row; the id ``none`` stands for null."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                search = _search_of(row, k)
                rows = []
                for q, vector, ids, scores in zip(np.frombuffer(row["ids"], np.int64).tolist(), search.whole, search.ids, search.scores):
                    own = sum(int(x) * int(x) for x in vector)
                    entries = [(int(i), int(s)) for i, s in zip(ids, scores)]
                    if (q, own) in entries:
                        entries.remove((q, own))
                    rows += [(q, n, None if i == none else i, min(max(s, _LOW), _TOP)) for n, (i, s) in enumerate(entries[:k], 1)]
                columns = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "rank", "vec_id", "score"])

    return run


def _unused(rows: DataFrame) -> int:
    """An id that no row has, greater than all where there is one."""
    n, most = rows.agg(F.count("*"), F.max("vec_id")).first()
    if most is None or most < _TOP:
        return 0 if most is None else most + 1
    free = rows.sparkSession.range(n + 1).withColumnRenamed("id", "vec_id").join(rows, "vec_id", "left_anti")
    return free.agg(F.min("vec_id")).first()[0]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, bucket_rows: int = 4096, chunk_rows: int = 2048) -> DataFrame:
    """Each query's k rows of ``vectors`` with the largest integer inner product, ties to the smaller vec_id.

    Both have vec_id and v (array<bigint>), and the queries are rows of ``vectors``; a query meets every row but its own, so also
    others of its vec_id. Rows with a null vector, no or null components take no part; neither do candidates of another
    width than the query's. Repeated rows are candidates and queries each. Rows without a vec_id are candidates with a null id, behind
    all others in ties, but no queries. Scores are exact and ordered as such; those beyond
    64 bits are then held at the ends of that range. Other columns are ignored, empty tables give no rows. Buckets and chunks
    have at least ``bucket_rows`` and ``chunk_rows`` rows, and grow with the tables up to 16 times as many, which bounds a task.
    Returns query_id, rank (from 1), vec_id, score.
    """
    fit = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<bigint>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0))
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))

    every = materialize(fit(vectors).withColumn("width", F.size("v")).withColumn("norm", length), "vectors")
    none = _unused(every)
    named = every.withColumn("vec_id", F.coalesce("vec_id", F.lit(none)))

    def dealt(wide: DataFrame, least: int, name: str) -> tuple[DataFrame, int]:
        """Blocks in order of width and falling length, and the number of buckets they are in."""
        n = wide.count()
        rows = min(16 * least, max(least, n // 64))
        buckets = max(1, -(-n // rows))
        order = ("width", F.desc("norm"), F.xxhash64("vec_id"))
        blocks = wide.repartitionByRange(buckets, *order).sortWithinPartitions("width", F.desc("norm"), "vec_id").select("vec_id", "v", "width").mapInArrow(_blocks(rows), _BLOCK)
        return materialize(blocks, name + "-blocks"), buckets

    blocks, buckets = dealt(named, bucket_rows, "vectors")
    asking = fit(queries).where("vec_id is not null").withColumn("width", F.size("v")).withColumn("norm", length)
    asked, _ = dealt(materialize(asking, "queries"), chunk_rows, "queries")
    buckets = (blocks.agg(F.max("bucket")).first()[0] or 0) + 1
    nothing = lambda kind: F.lit(b"").cast("binary").alias(kind)
    chunk = F.col("bucket").cast("long") * (1 << 20) + F.col("place")
    zeros = F.unhex(F.repeat(F.lit("00"), F.length("ids")))  # nothing found yet by any query
    state = asked.select(chunk.alias("chunk"), "width", F.lit(0.0).alias("need"), "ids", "matrix", "kind", zeros.alias("best_ids"), nothing("best_scores"), F.lit(False).alias("wide"))
    summary = blocks.groupBy("bucket", "width").agg(F.max("longest").alias("longest"))
    low = 0
    while low < buckets:
        high = min(buckets, max(1, 2 * low))
        asking = state.select("chunk", "width", "need", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("bucket"))
        reached = asking.join(summary, ["bucket", "width"]).where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("chunk", "bucket", "width")
        reached = materialize(reached, "reached")
        here = blocks.where(F.col("bucket").between(low, high - 1)).join(reached, ["bucket", "width"]).select("chunk", "bucket", "place", "width", "ids", "matrix", "kind")
        sent = state.join(reached.select("chunk", "bucket"), "chunk")
        found = sent.groupBy("chunk", "bucket").cogroup(here.groupBy("chunk", "bucket")).applyInArrow(_met(k), _BEST)
        state = materialize(state.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_merged(k), _STATE), "state")
        low = high
    return state.mapInArrow(_answers(k, none), OUT)
