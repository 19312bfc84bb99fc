"""Hard negatives by Four-Russians scoring.

Candidates become blocks of bit planes: plane p holds bit p of every component, eight components to a byte, and the last plane
counts negatively, as in two's complement. For each anchor and each group of eight dimensions a table holds the sums of the
anchor's components over all 256 subsets of the group. A candidate's byte is an index into it; the entries found, shifted by
their plane and added, are the exact inner product. Anchors meet the blocks in cells of bounded size: the first round finds
each anchor's positives, the second, with their scores, its negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

BLOCK, CHUNK, CELL = 1024, 512, 8  # candidates of a block, anchors of a chunk, blocks of a cell
_BLOCK = "block long, width int, rows binary, ids array<bigint>, labels binary, planes int, bits binary"
_STEP = 64  # anchors scored at once
_WIDE = 1 << 200  # above any score of 64-bit components: makes wide scores sortable texts of bytes


def bit_planes(matrix: np.ndarray) -> np.ndarray:
    """(planes, groups of eight dimensions, rows) bytes of an integer matrix; the last plane is the sign's."""
    least, most = int(matrix.min(initial=0)), int(matrix.max(initial=0))
    planes = max(most.bit_length(), (-least - 1).bit_length() if least < 0 else 0) + 1
    return np.stack([np.packbits(((matrix >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(planes)])


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups of eight dimensions, anchors, 256): the sum of an anchor's components over each subset of a group."""
    n, width = anchors.shape
    groups = -(-width // 8)
    padded = np.zeros((n, groups * 8), kind)
    padded[:, :width] = anchors
    table = np.zeros((groups, n, 256), kind)
    for i in range(8):  # subsets with component i: those without, and it
        table[:, :, 1 << i : 2 << i] = table[:, :, : 1 << i] + padded.reshape(n, groups, 8)[:, :, i].T[:, :, None]
    return table


def scores(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inner products of each anchor with each row, exact."""
    planes, groups, rows = bits.shape
    wide = np.int64 if table.dtype == np.int32 else table.dtype
    total = np.zeros((table.shape[1], rows), wide)
    for p in range(planes):
        part = np.zeros((table.shape[1], rows), table.dtype)
        for g in range(groups):
            part += np.take(table[g], bits[p, g], axis=1)
        shifted = part.astype(wide) * (1 << p)
        total = total - shifted if p == planes - 1 else total + shifted
    return total


def _blocks(size: int):
    def run(batches):
        from pyspark import TaskContext

        block, task = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            width = batch["width"].to_numpy()
            order = np.argsort(width, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(width[order])) + 1) if len(order) else []:
                for i in range(0, len(some), size):
                    at = pa.array(some[i : i + size])
                    w, n = int(width[some[0]]), len(at)
                    bits = bit_planes(batch["v"].take(at).flatten().to_numpy().reshape(n, w).astype(np.int64))
                    values = (task + block, w, batch["row"].take(at).to_numpy().tobytes(), batch["vec_id"].take(at).to_pylist(), batch["label"].take(at).to_numpy().tobytes(), len(bits), bits.tobytes())
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "width", "rows", "ids", "labels", "planes", "bits"])
                    block += 1

    return run


class _Cell:
    """Some blocks of one width, in the order of vec_id, null last."""

    def __init__(self, blocks: list[dict], width: int):
        groups = -(-width // 8)
        ids = [i for b in blocks for i in b["ids"]]
        none = np.array([i is None for i in ids], bool)
        ids = np.array([0 if i is None else i for i in ids], np.int64)
        by = np.lexsort((ids, none))
        self.ids, self.none = ids[by], none[by]
        self.rows, self.labels = (np.concatenate([np.frombuffer(b[c], np.int64) for b in blocks])[by] for c in ("rows", "labels"))
        self.blocks = [np.frombuffer(b["bits"], np.uint8).reshape(b["planes"], groups, len(b["ids"])) for b in blocks]
        self.by = by

    def scores(self, anchors: np.ndarray, exact: bool) -> np.ndarray:
        kind = object if exact else np.int32 if abs(anchors).max(initial=0) < 1 << 27 else np.int64
        table = subset_sums(anchors, kind)
        return np.concatenate([scores(table, bits) for bits in self.blocks], axis=1)[:, self.by]


def _first(values: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n greatest allowed values of each row, ties to the smaller column."""
    if values.dtype == object:
        found = [(i, j) for i in range(len(values)) for j in sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j: (-values[i, j], j))[:n]]
        return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    low = np.iinfo(values.dtype).min
    held = np.where(allowed, values, low)
    if held.shape[1] > n:
        cut = np.partition(held, held.shape[1] - n, axis=1)[:, held.shape[1] - n]
        allowed = allowed & (held >= cut[:, None])
    row, column = np.nonzero(allowed)
    by = np.lexsort((column, -held[row, column], row))
    row, column = row[by], column[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < n], column[rank < n]


def _arrow(score: list, exact: bool) -> pa.Array:
    return pa.array([(_WIDE + int(s)).to_bytes(26, "big") for s in score], pa.binary()) if exact else pa.array(score, pa.int64())


def _cells(anchors: pa.Table, blocks: pa.Table):
    """The anchors of a chunk and the blocks of a cell, by width."""
    held = blocks.to_pylist()
    width = anchors["width"].to_numpy()
    for w in {b["width"] for b in held} & set(width.tolist()):
        cell = _Cell([b for b in held if b["width"] == w], w)
        at = np.flatnonzero(width == w)
        for i in range(0, len(at), _STEP):
            some = anchors.take(pa.array(at[i : i + _STEP])).combine_chunks()
            matrix = some["v"].combine_chunks().flatten().to_numpy().reshape(len(some), w).astype(np.int64)
            yield cell, some, matrix


def _positives(n: int, exact: bool):
    def run(key, anchors, blocks):
        parts = [], [], [], []
        for cell, some, matrix in _cells(anchors, blocks):
            rows, labels = some["row"].to_numpy(), some["label"].to_numpy()
            product = cell.scores(matrix, exact)
            i, j = _first(product, (labels[:, None] == cell.labels) & (rows[:, None] != cell.rows), n)
            for part, values in zip(parts, (rows[i], cell.ids[j], cell.none[j], product[i, j])):
                part += values.tolist()
        return pa.table({"row": pa.array(parts[0], pa.int64()), "positive_id": pa.array(parts[1], pa.int64(), mask=np.array(parts[2], bool)), "score": _arrow(parts[3], exact)})

    return run


def _negatives(n: int, low: int, high: int, exact: bool):
    def run(key, anchors, blocks):
        parts = [], [], [], [], [], [], []
        for cell, some, matrix in _cells(anchors, blocks):
            product, other = cell.scores(matrix, exact), some["label"].to_numpy()[:, None] != cell.labels
            found = some["positives"].to_pylist()
            for slot in range(max((len(f) for f in found), default=0)):
                has = np.array([len(f) > slot for f in found])
                score = [(f[slot]["score"] if len(f) > slot else 0) for f in found]
                score = np.array([int.from_bytes(s, "big") - _WIDE if isinstance(s, bytes) else s for s in score], product.dtype)[:, None]
                i, j = _first(product, other & has[:, None] & (low * score <= 100 * product) & (100 * product <= high * score), n)
                rows = some["row"].to_numpy()[i]
                for part, values in zip(parts, (rows, [slot] * len(i), cell.ids[j], cell.none[j], product[i, j])):
                    part += list(values) if isinstance(values, list) else values.tolist()
                parts[5].extend(found[k][slot]["positive_id"] for k in i)
                parts[6].extend(score[i, 0].tolist())
        columns = {"row": pa.array(parts[0], pa.int64()), "slot": pa.array(parts[1], pa.int32()), "positive_id": pa.array(parts[5], pa.int64()), "positive_score": _arrow(parts[6], exact), "negative_id": pa.array(parts[2], pa.int64(), mask=np.array(parts[3], bool)), "score": _arrow(parts[4], exact)}
        return pa.table(columns)

    return run


def _narrow(batches):
    """Wide scores as longs, held at the ends of that range."""
    hold = lambda b: min(max(int.from_bytes(b, "big") - _WIDE, -(1 << 63)), (1 << 63) - 1)
    for batch in batches:
        scores = [pa.array([hold(b) for b in batch[c].to_pylist()], pa.int64()) for c in ("positive_score", "negative_score")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("anchor_id", "positive_id", "rank", "negative_id")), *scores], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def mine(vectors: DataFrame, anchor: F.Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label (numbers) and v (array<bigint>); ``anchor`` is a condition over vec_id that says which rows are
    anchors. Scores are exact inner products; higher ones come first, ties by smaller vec_id, null last. An anchor's positives
    are its first ``positives`` other rows of its label; the negatives of a positive are the first ``negatives`` rows of another
    label with low * positive_score <= 100 * score <= high * positive_score. Rows with a null label, vector or component take no
    part, nor does a row for an anchor of another width. Rows without a vec_id can be positives or negatives, with a null id;
    repeated rows are rows each, and anchors each. Scores beyond 64 bits are compared as they are and returned at the ends of that
    range. Other columns are ignored; an empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v")).where("label is not null and v is not null and not exists(v, x -> x is null)")
    rows = materialize(fit.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v", F.size("v").alias("width"), F.coalesce(anchor, F.lit(False)).alias("anchor")), "vectors")
    size = F.greatest(F.abs(F.array_max("v").cast("decimal(20)")), F.abs(F.array_min("v").cast("decimal(20)")))
    most, asked, width = rows.agg(F.max(size), F.count_if("anchor"), F.max("width")).first()
    exact = int(most or 0) ** 2 * max(1, width or 0) * 128 >= 1 << 62
    blocks = materialize(rows.select("row", "vec_id", "label", "v", "width").mapInArrow(_blocks(BLOCK), _BLOCK), "blocks")
    chunks, cells = max(1, -(-asked // CHUNK)), max(1, -(-blocks.count() // CELL))
    held = rows.where("anchor").select("row", "vec_id", "label", "v", "width", F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    there = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))).withColumn("chunk", every(chunks)).groupBy("chunk", "cell")
    met = lambda anchors: anchors.withColumn("cell", every(cells)).groupBy("chunk", "cell").cogroup(there)
    score = "binary" if exact else "long"
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last(F.col("negative_id" if "slot" in by else "positive_id")))

    found = met(held).applyInArrow(_positives(positives, exact), f"row long, positive_id long, score {score}")
    found = found.withColumn("slot", F.row_number().over(best("row"))).where(F.col("slot") <= positives)
    listed = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_id", "score"))).alias("positives"))
    known = materialize(held.join(listed, "row"), "positives")
    out = met(known.drop("vec_id")).applyInArrow(_negatives(negatives, low, high, exact), f"row long, slot int, positive_id long, positive_score {score}, negative_id long, score {score}")
    out = out.withColumn("rank", F.row_number().over(best("row", "slot"))).where(F.col("rank") <= negatives)
    out = out.join(known.select("row", F.col("vec_id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
    if not exact:
        return out
    return out.mapInArrow(_narrow, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
