"""Near-duplicate documents by a signature-coordinate inverted join.

Every distinct shingle set gets a MinHash signature. A set is posted under its (coordinate, value) pairs, rarest
first, and only as many of them as a pair of sets above the match threshold must share (the prefix); pairs that no other
set has are skipped. Within a posting the sets are tied to one leader a round, chosen by another hash each time, and
only while posting members are in different components. What is left after the star rounds is dealt to crowds (sets that
postings tie together) and, by size, to blocks of bounded length; blocks meet in pairs, as one row each, where the sizes
allow a link. Pairs whose signatures agree in too few coordinates go, the rest is confirmed on the full sets. So a group
of n copies costs about n comparisons, and none of its links that could join two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import connected_components
from .storage import materialize, small_batches


def _sets(texts: pa.ChunkedArray | pa.Array, width: int):
    """For runs of rows: (first row, end row, hashes of distinct shingles sorted within each row, bounds)."""
    data, offsets = T.utf8(texts)
    for i, j, d, o in T.chunks(data, offsets):
        d = T.LOWER[d]
        starts, ends, first = T.split(d, o)
        words = T.word_hashes(d, starts, ends)
        inside = T.fits(first, width)
        shingles, row = T.rolling(words, width)[inside], T.rows_of(first)[: len(inside)][inside]
        for r in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width)):  # the whole sequence as one
            n = int(first[r + 1] - first[r])
            shingles, row = np.append(shingles, T.rolling(words[first[r] : first[r + 1]], n, salt=n)), np.append(row, r)
        order = np.lexsort((shingles, row))
        shingles, row = shingles[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])
        shingles, row = shingles[new], row[new]
        yield i, j, shingles, np.searchsorted(row, np.arange(j - i + 1))


def _signatures(width: int, coordinates: int):
    rng = np.random.default_rng(20240611)
    factor, shift = rng.integers(0, 1 << 63, (2, coordinates), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            sizes, digests, marks = [], [], []
            for _, _, shingles, at in _sets(batch["text"], width):
                n, full = np.diff(at), np.flatnonzero(np.diff(at))
                signature = np.zeros((len(n), coordinates), np.int32)
                digest = np.zeros((len(n), 2), np.uint64)
                if full.size:
                    for c in range(coordinates):
                        least = np.minimum.reduceat(shingles * factor[c] + shift[c], at[full])
                        signature[full, c] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for k, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
                        digest[full, k] = np.add.reduceat(T.mix(shingles ^ np.uint64(salt)), at[full])
                sizes.append(n)
                digests.append(digest)
                marks.append(signature)
            if sizes:
                size, digest, mark = np.concatenate(sizes), np.concatenate(digests).view(np.int64), np.concatenate(marks)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, mark.size + 1, coordinates), pa.int32()), pa.array(mark.ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists], ["doc_id", "n", "d1", "d2", "signature"])

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            blobs = []
            for i, j, shingles, at in _sets(batch["text"], width):
                blobs += [shingles[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
            if blobs:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(blobs, pa.binary())], ["doc_id", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch["x"].to_pylist(), batch["y"].to_pylist()
            ok = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("a", "b", "in_a", "in_b")), pa.array(ok, pa.bool_())], ["a", "b", "in_a", "in_b", "linked"])

    return run


_BLOCK = 128
_PAIR = ("a", "b", "in_a", "in_b")  # two sets and their components


def _signature_block(key, table):
    ids = table["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    marks = np.array(table["signature"].to_pylist(), np.int32)[order]
    return pa.table({"block": [key[0].as_py()], "crowd": [key[1].as_py()], "level": pa.array([key[2].as_py()], pa.int32()), "outside": [any(table["outside"].to_pylist())], "ids": pa.array([ids[order].tobytes()], pa.binary()), "components": pa.array([table["component"].to_numpy()[order].tobytes()], pa.binary()), "signatures": pa.array([marks.tobytes()], pa.binary())})


def _set_block(key, table):
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    blobs = table["shingles"].to_pylist()
    blobs = [blobs[i] for i in order]
    return pa.table({"block": [key[0].as_py()], "components": pa.array([table["component"].to_numpy()[order].tobytes()], pa.binary()), "sizes": pa.array([np.array([len(b) // 8 for b in blobs], np.int64).tobytes()], pa.binary()), "shingles": pa.array([b"".join(blobs)], pa.binary())})


def _agreeing(agree: int):
    """Of each pair of blocks: the pairs in different components whose signatures agree enough."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                (x, c, s), (y, d, t) = (tuple(np.frombuffer(row[f"{f}_{k}"], kind) for f, kind in (("ids", np.int64), ("components", np.int64), ("signatures", np.int32))) for k in (1, 2))
                s, t = s.reshape(len(x), -1), t.reshape(len(y), -1)
                same = np.zeros((len(x), len(y)), np.int32)
                for i in range(s.shape[1]):
                    same += s[:, i, None] == t[None, :, i]
                i, j = np.nonzero((same >= agree) & (c[:, None] != d[None, :]))
                if i.size:
                    rows.append((row["block_1"], row["block_2"], [dict(zip(_PAIR, p)) for p in zip(x[i].tolist(), y[j].tolist(), c[i].tolist(), d[j].tolist())]))
            if rows:
                a, b, p = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(p, pa.list_(pa.struct([(k, pa.int64()) for k in _PAIR])))], ["block_1", "block_2", "pairs"])

    return run


def _linked_blocks(percent: int):
    """The components that links between the sets of two blocks join, by one product of their incidence matrices over common shingles."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts, sizes, sets = ([np.frombuffer(row[f"{f}_{k}"], kind) for k in (1, 2)] for f, kind in (("components", np.int64), ("sizes", np.int64), ("shingles", np.uint64)))
                common = np.intersect1d(sets[0], sets[1])
                total = np.zeros((len(parts[0]), len(parts[1])), np.float32)
                for at in range(0, len(common), 8192):
                    part, held = common[at : at + 8192], []
                    for n, shingles in zip(sizes, sets):
                        place = np.minimum(np.searchsorted(part, shingles), len(part) - 1)
                        hit = part[place] == shingles
                        matrix = np.zeros((len(n), len(part)), np.float32)
                        matrix[np.repeat(np.arange(len(n)), n)[hit], place[hit]] = 1
                        held.append(matrix)
                    total += held[0] @ held[1].T
                union = sizes[0][:, None] + sizes[1][None, :] - total
                i, j = np.nonzero((100 * total >= percent * union) & (parts[0][:, None] != parts[1][None, :]))
                if i.size:
                    x, y = np.unique(np.stack([parts[0][i], parts[1][j]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(x.copy()), pa.array(y.copy())], ["in_a", "in_b"])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the lesser id first."""
    side = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(f"in_{x}").alias("in_a"), F.col(f"in_{y}").alias("in_b"))
    return pairs.select(F.when(F.col("a") < F.col("b"), side("a", "b")).otherwise(side("b", "a")).alias("p")).select("p.*").distinct()


class _Join:
    """Candidate pairs of sets, round by round."""

    def __init__(self, docs: DataFrame, signed: DataFrame, width: int, percent: int, coordinates: int, agree: int):
        self.percent, self.agree = percent, agree
        tokens = signed.select("doc_id", F.explode(F.transform("signature", lambda v, i: F.xxhash64(i, v))).alias("token"))
        shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
        ranked = tokens.join(shared, "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
        prefix = coordinates - agree + 1  # of all coordinates, those that nobody else has come first
        keep = F.size("t") - (coordinates - prefix)
        posted = ranked.where(keep > 0).select("doc_id", F.explode(F.slice("t", F.lit(1), keep)).alias("t")).select("doc_id", "t.token")
        together = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
        self.postings = materialize(posted.join(together, "token"), "postings")
        ids = self.postings.select("doc_id").distinct()
        self.signatures = signed.select("doc_id", "n", "signature")
        self.sets = materialize(docs.join(ids, "doc_id", "left_semi").mapInArrow(_full_sets(width), "doc_id long, shingles binary"), "sets")
        self.tested: DataFrame | None = None
        self.labels = ids.select("doc_id", F.col("doc_id").alias("component"))

    def merge(self, links: DataFrame) -> None:
        """Components that links join become one; only components meet here, not the documents in them."""
        joined = connected_components(links, "in_a", "in_b").select(F.col("id").alias("component"), F.col("component").alias("root"))
        self.labels = materialize(self.labels.join(joined, "component", "left").select("doc_id", F.coalesce("root", "component").alias("component")), "labels")

    def unsettled(self) -> DataFrame:
        """Postings that still join different components, with each member's component. Those settled once stay so."""
        named = self.postings.select("doc_id", "token").join(self.labels, "doc_id")
        mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
        self.postings = materialize(named.join(mixed, "token"), "unsettled")
        return self.postings

    def stars(self, postings: DataFrame, turn: int) -> DataFrame:
        order = F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")
        leaders = postings.groupBy("token").agg(F.min_by(F.struct("doc_id", "component"), F.struct(order, F.col("doc_id"))).alias("l"))
        return self.pairs(postings.join(leaders, "token").select("doc_id", "component", F.col("l.doc_id").alias("other"), F.col("l.component").alias("theirs")))

    def rest(self, postings: DataFrame) -> DataFrame:
        """Links between different components of what star rounds left, by pairs of blocks within a crowd."""
        least = postings.groupBy("token").agg(F.min("doc_id").alias("other"))
        ties = postings.join(least, "token").select("doc_id", "other").distinct()
        crowds = connected_components(ties, "doc_id", "other").select(F.col("id").alias("doc_id"), F.col("component").alias("crowd"))
        left = postings.select("doc_id", "component").distinct().join(crowds, "doc_id").join(self.signatures, "doc_id")
        main = left.groupBy("crowd", "component").agg(F.count("*").alias("k")).groupBy("crowd").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
        size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / self.percent)) + 1e-9).cast("int")  # sets that link are at most one level apart
        left = left.join(main, "crowd").withColumn("level", size)
        parts = left.groupBy("crowd", "level").agg(F.ceil(F.count("*") / _BLOCK).alias("parts"))
        block = F.struct("crowd", "level", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
        left = materialize(left.join(parts, ["crowd", "level"]).select("doc_id", "component", (F.col("component") != F.col("main")).alias("outside"), "signature", "crowd", "level", F.xxhash64(block).alias("block")), "crowds")
        blocks = left.groupBy("block", "crowd", "level").applyInArrow(_signature_block, "block long, crowd long, level int, outside boolean, ids binary, components binary, signatures binary")
        side = lambda k: blocks.select("crowd", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "level", "outside", "ids", "components", "signatures")))
        nearby = (F.col("level_2") == F.col("level_1") + 1) | ((F.col("level_2") == F.col("level_1")) & (F.col("block_1") <= F.col("block_2")))
        met = side(1).join(side(2), "crowd").where(nearby & (F.col("outside_1") | F.col("outside_2")))
        found = materialize(met.mapInArrow(_agreeing(self.agree), "block_1 long, block_2 long, pairs array<struct<a:bigint,b:bigint,in_a:bigint,in_b:bigint>>"), "agreeing")
        few = F.size("pairs") < _BLOCK
        single = found.where(few).select(F.explode("pairs").alias("p")).select("p.*")
        sets = left.select("doc_id", "component", "block").join(self.sets, "doc_id").groupBy("block").applyInArrow(_set_block, "block long, components binary, sizes binary, shingles binary")
        of = lambda k: sets.select(F.col("block").alias(f"block_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("components", "sizes", "shingles")))
        dense = found.where(~few).select("block_1", "block_2").join(of(1), "block_1").join(of(2), "block_2")
        linked = dense.mapInArrow(_linked_blocks(self.percent), "in_a long, in_b long")
        return self.links(_ordered(single)).unionByName(linked)

    def pairs(self, members: DataFrame) -> DataFrame:
        return _ordered(members.where("component <> theirs").select(F.col("doc_id").alias("a"), F.col("other").alias("b"), F.col("component").alias("in_a"), F.col("theirs").alias("in_b")))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Confirm those pairs that were not tested before: the components that they join."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        of = lambda table, column, id_, name: table.select(F.col("doc_id").alias(id_), F.col(column).alias(name))
        met = pairs.join(of(self.signatures, "signature", "a", "s"), "a").join(of(self.signatures, "signature", "b", "r"), "b")
        met = met.where(F.aggregate(F.zip_with("s", "r", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) >= self.agree).select(*_PAIR)
        met = met.join(of(self.sets, "shingles", "a", "x"), "a").join(of(self.sets, "shingles", "b", "y"), "b").select(*_PAIR, "x", "y")
        found = materialize(met.mapInArrow(_confirmed(self.percent), "a long, b long, in_a long, in_b long, linked boolean"), "pairs")
        done = found.where("not linked").select("a", "b")
        self.tested = done if self.tested is None else self.tested.unionByName(done)
        return found.where("linked").select("in_a", "in_b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, coordinates: int = 32, agree: int = 12, stars: int = 2) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Words are lower-cased (A-Z) and split at ASCII white space; a set holds the distinct runs of ``width`` words, or the
    whole sequence if shorter. Documents without words (null, empty, white space) have empty sets and link with
    nothing. Pairs whose signatures agree in fewer than ``agree`` of ``coordinates`` are not looked at: at the threshold that
    misses about one pair in a million. Rows that share a doc_id are one document with the greatest text; rows with a null
    doc_id stand alone with a null component. Returns doc_id, n_shingles, component_id, kept.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.where(F.col("doc_id").isNotNull())
    signed = materialize(docs.mapInArrow(_signatures(width, coordinates), "doc_id long, n long, d1 long, d2 long, signature array<int>"), "signatures")
    if signed.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count():
        keyed = keyed.groupBy("doc_id").agg(F.max("text").alias("text"))
        signed = materialize(keyed.mapInArrow(_signatures(width, coordinates), "doc_id long, n long, d1 long, d2 long, signature array<int>").unionByName(signed.where("doc_id is null")), "signatures")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    full = signed.where("n > 0").join(classes.select("rep", F.lit(True).alias("first")), F.col("doc_id") == F.col("rep"), "left_semi")
    join = _Join(keyed, full.select("doc_id", "n", "signature"), width, percent, coordinates, agree)
    for turn in range(stars + 1):
        postings = join.unsettled()
        if postings.limit(1).count() == 0:
            break
        join.merge(join.rest(postings) if turn == stars else join.links(join.stars(postings, turn)))
    members = signed.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    out = members.join(join.labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
