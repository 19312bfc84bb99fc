"""Near-duplicate documents by SimHash, with Burkhard-Keller trees over shards of the fingerprints.

A fingerprint is posted under some of its bit blocks, so many that two fingerprints within the radius share a post: with
radius 3 and four blocks, one block at least is equal. Posts are dealt to shards of about ``SHARD`` fingerprints, a fuller
shard to chunks. Each chunk's tree keys a node's children by their Hamming distance to it; a search at a node of distance d
follows the edges from d - radius to d + radius only. Trees stand in a table and the join sends each to the fingerprints that
are searched in it: through the driver, as Spark's broadcasts go, all fingerprints would pass. A search returns no pairs but
a forest that ties what it linked, so a dense group gives as many rows as it has fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import connected_components
from .storage import materialize, small_batches

WIDTH, RADIUS, SEED, SHARD = 3, 3, 42, 4096
_RUN = 1 << 17  # shingles hashed at once


def _votes(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A fingerprint of each text: the bits that over half of its shingles' hashes have."""
    data = T.LOWER[data]
    starts, ends, first = T.split(data, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])  # of each word when one space stands behind each
    joined = np.full(at[-1], 0x20, np.uint8)
    inside = ~T.SEPARATORS[data]
    joined[np.delete(np.arange(at[-1]), at[1:] - 1)] = data[inside]
    text, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    words = np.diff(first)
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    row = np.repeat(np.arange(len(words)), shingles)
    begin = first[row] + np.arange(bounds[-1]) - bounds[row]
    a, b = at[begin], at[np.minimum(begin + width, first[row + 1])] - 1
    ones = np.zeros((len(words), 64), np.int64)
    for i in range(0, len(row), _RUN):
        hashes = np.fromiter((digest(text[x:y], seed) for x, y in zip(a[i : i + _RUN].tolist(), b[i : i + _RUN].tolist())), np.uint64, min(_RUN, len(row) - i))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some, at_row = np.unique(row[i : i + _RUN], return_index=True)
        ones[some] += np.add.reduceat(bits, at_row, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of each row; texts without words have zero."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            marks = [_votes(d, o, width, seed) for _, _, d, o in T.chunks(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, fingerprint long")


class Tree:
    """A Burkhard-Keller tree over distinct 64-bit values, as arrays: a node's children lie together, in the order of their keys."""

    def __init__(self, values: np.ndarray):
        self.values = values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        children, edges, level = [], [], np.arange(1, n)
        owner = np.zeros(len(level), np.int64)  # the node below which each value of the level still has to go
        while len(level):
            key = np.bitwise_count(values[level] ^ values[owner]).astype(np.int64)
            by = np.lexsort((level, key, owner))
            level, owner, key = level[by], owner[by], key[by]
            child = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])
            children.append(level[child])
            edges.append(owner[child] * 128 + key[child])
            owner = level[child][np.cumsum(child) - 1]
            level, owner = level[~child], owner[~child]
        none = [np.zeros(0, np.int64)]
        self.child, self.edge = np.concatenate(children or none), np.concatenate(edges or none)
        by = np.argsort(self.edge)
        self.child, self.edge = self.child[by], self.edge[by]  # edges: the parent's place and the child's key

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) places of all pairs within the radius."""
        if not len(self.values) or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        hits = []
        while len(query):
            far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = far <= radius
            hits.append((query[near], node[near]))
            low = np.searchsorted(self.edge, node * 128 + np.maximum(far - radius, 0), "left")
            count = np.searchsorted(self.edge, node * 128 + far + radius, "right") - low
            query, low, total = np.repeat(query, count), np.repeat(low, count), np.cumsum(count)
            node = self.child[low + np.arange(len(low)) - np.repeat(total - count, count)]
        return tuple(np.concatenate(x) for x in zip(*hits))


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Ties a and b in a forest of labels, whose roots label themselves and are the least of their trees."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(deeper := label[label], label):
            label[:] = deeper


def _forest(tree: Tree, others: np.ndarray | None, radius: int, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values that tie what links between the tree and the others (without others: within the tree) tie."""
    n = len(tree.values)
    values = tree.values if others is None else np.concatenate([tree.values, others])
    queries, shift = (tree.values, 0) if others is None else (others, n)
    label = np.arange(len(values))
    for i in range(0, len(queries), step):
        query, node = tree.within(queries[i : i + step], radius)
        _union(label, query + i + shift, node)
    tied = np.flatnonzero(label != np.arange(len(values)))
    return values[tied], values[label[tied]]


def _links(radius: int):
    def run(batches):
        for batch in batches:
            for held, sought in zip(batch["held"].to_pylist(), batch["sought"].to_pylist()):
                tree = Tree(np.frombuffer(held, np.uint64))
                a, b = _forest(tree, None if sought is None else np.frombuffer(sought, np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _packed(key, table):
    return pa.table({"shard": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int64()), "held": pa.array([np.unique(table["fingerprint"].to_numpy()).view(np.uint64).tobytes()], pa.binary())})


def _posts(n: int, radius: int, shard: int) -> list[int]:
    """Masks of bit blocks of which two fingerprints within the radius share one: the fewest blocks that leave about a shard in a post."""
    for blocks in range(radius + 1, radius + 5):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in some) for some in combinations(range(blocks), blocks - radius)]
        if n >> min(m.bit_count() for m in masks) < shard:
            break
    return masks


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints (column fingerprint) that tie the same ones as all links within the radius."""
    n = distinct.count()
    masks = _posts(n, radius, shard)
    shards = max(1, -(-n * len(masks) // shard))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    posts = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks)])
    entries = distinct.select("fingerprint", F.explode(posts).alias("post")).select("fingerprint", F.pmod("post", F.lit(shards)).alias("shard")).distinct()
    entries = materialize(entries, "posts")
    full = entries.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / (2.0 * shard)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("chunks"))
    packed = materialize(entries.join(full, "shard").select("shard", chunk.alias("chunk"), "fingerprint").groupBy("shard", "chunk").applyInArrow(_packed, "shard long, chunk long, held binary"), "trees")
    alone = packed.select("held", F.lit(None).cast("binary").alias("sought"))
    split = packed.groupBy("shard").count().where("count > 1").select("shard")
    crowded = materialize(packed.join(split, "shard", "left_semi"), "crowded")
    other = crowded.select("shard", F.col("chunk").alias("later"), F.col("held").alias("sought"))
    pairs = crowded.join(other, "shard").where("chunk < later").select("held", "sought")
    return alone.unionByName(pairs.repartition(max(1, -(-n // shard)))).mapInArrow(_links(radius), "a long, b long") if crowded.limit(1).count() else alone.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row.

    Texts are lower-cased from A to Z and shingled by three words; with fewer, all words are one shingle, without any (null, empty
    or blank texts) the fingerprint is zero, which links like any other. Rows link where their fingerprints differ in ``radius``
    bits at most; a component's id is the least doc_id of its rows. Repeated rows are rows each; rows without a doc_id link as well
    and name a component only if no other row does, with null. Other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(materialize(links(distinct.select("fingerprint"), radius), "near"))
    tied = distinct.join(found, distinct["fingerprint"] == found["id"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    named = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    owner = tied.join(named, "component").select("fingerprint", "component_id")
    return rows.join(owner, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
