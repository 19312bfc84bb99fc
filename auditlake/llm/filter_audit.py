"""What five text filters remove alone and together, from a sparse document-term matrix.

Runs of documents of about ``SHARD_BYTES`` become shards: a CSR block (row bounds, columns, counts) over the shard's own words,
which stand in the order of their hashes. Each shard sends its distinct words once to the global dictionary, as one text for
each range of hashes; a range numbers its words, again in that order, and sends the numbers back as the block's columns. Row sums are the words of a document and entries of a row its distinct words, which decide filters A and B.
Rows then meet their labels and are counted by part and by the set of filters that they fail: 32 sets at most in a part, from
which all orders of the filters follow.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .storage import materialize, small_batches

FILTERS = "ABCDE"
SHARD_BYTES = 4 << 20
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3  # words; percent of words; percent of code points
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True
_ROW = "struct<doc_id:bigint,part:string,upper:bigint,points:bigint,marked:boolean,digest:binary>"
_SHARD = f"shard long, n_words long, words binary, docs array<{_ROW}>, bounds binary, columns binary, counts binary"
_WORDS_OF_RANGE = 1 << 19  # words that shards send to a range, about
_NUMBERED = "range long, shard long, numbers binary, words array<string>, shards array<bigint>"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words that stand apart in the bytes by separators, as an array."""
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[~T.SEPARATORS[data]])])


def _by_hash(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in the order of their hashes, the hashes, and where each of the given words has gone."""
    data, at = T.utf8(words)
    hashes = T.word_hashes(data, at[:-1], at[1:])
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words.take(pa.array(order)), hashes[order], place


def _joined(words: pa.Array) -> bytes:
    return "\n".join(words.to_pylist()).encode()


def _packed(values: np.ndarray) -> bytes:
    """Differences of 32-bit values, compressed."""
    held = np.diff(values.astype(np.int32), prepend=np.int32(0)).tobytes()
    return len(held).to_bytes(8, "little") + pa.compress(held, codec="zstd", asbytes=True)


def unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True), np.int32), dtype=np.int32)


def _block(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and their matrix over those words: row bounds, columns, counts."""
    starts, ends, first = T.split(data, offsets)
    coded = _strings(data, starts, ends).dictionary_encode()
    words, _, place = _by_hash(coded.dictionary)
    n = max(1, len(words))
    cell = np.sort(T.rows_of(first) * n + place[coded.indices.to_numpy()])
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    row, column = np.divmod(cell[new], n)
    return words, np.searchsorted(row, np.arange(len(offsets))), column, np.diff(np.append(new, len(cell)))


def _shards(batches):
    from pyspark import TaskContext

    shard, task = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = T.utf8(batch["text"])
        ids, parts = batch["doc_id"].to_pylist(), batch["part"].to_pylist()
        for i, j, d, o in T.chunks(data, offsets, SHARD_BYTES):
            words, bounds, columns, counts = _block(d, o)
            upper, points = _sums((d >= 0x41) & (d <= 0x5A), o), _sums((d & 0xC0) != 0x80, o)
            marked = _sums(_MARKS[d], o) > 0
            docs = [{"doc_id": a, "part": p, "upper": u, "points": n, "marked": m, "digest": hashlib.sha256(d[o[k] : o[k + 1]]).digest()} for k, (a, p, u, n, m) in enumerate(zip(ids[i:j], parts[i:j], upper.tolist(), points.tolist(), marked.tolist()))]
            values = [task + shard, len(words), _joined(words), docs, bounds.astype(np.int64).tobytes(), _packed(columns), _packed(counts)]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("upper", pa.int64()), ("points", pa.int64()), ("marked", pa.bool_()), ("digest", pa.binary())])), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["shard", "n_words", "words", "docs", "bounds", "columns", "counts"])
            shard += 1


def _words(held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(held, np.uint8)
    return data, *T.split(data, np.array([0, len(data)]))[:2]


def _ranges(bits: int):
    """Each shard's words by the range that their hashes are in."""

    def run(batches):
        for batch in batches:
            for shard, held in zip(batch["shard"].to_pylist(), batch["words"].to_pylist()):
                data, starts, ends = _words(held)
                part = (T.word_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero(np.diff(part, prepend=-1))
                rows = [held[starts[a] : ends[b - 1]] for a, b in zip(at, [*at[1:], len(part)])]
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([shard] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["range", "shard", "words"])

    return run


def _numbered(key, table):
    """A range's words with the shards that have each, and for each shard the numbers of its own."""
    texts = table["words"].to_pylist()
    data, starts, ends = _words(b"\n".join(texts))
    coded = _strings(data, starts, ends).dictionary_encode()
    words, _, place = _by_hash(coded.dictionary)
    number = place[coded.indices.to_numpy()].astype(np.int32)
    cuts = np.cumsum([t.count(b"\n") + 1 for t in texts])[:-1]
    numbers = [n.tobytes() for n in np.split(number, cuts)]
    n = len(texts)
    values = ([key[0].as_py()] * (n + 1), [*table["shard"].to_pylist(), None], [*numbers, None], [*[None] * n, words.to_pylist()], [*[None] * n, np.bincount(number, minlength=len(words)).tolist()])
    return pa.table([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())))], names=["range", "shard", "numbers", "words", "shards"])


def _renumbered(batches):
    """Each block over the global numbers of its words, columns ascending within a row."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            numbers = [np.frombuffer(x["numbers"], np.int32).astype(np.int64) + (x["range"] << 32) for x in row["held"] or []]
            column = np.concatenate([np.zeros(0, np.int64), *numbers])[unpacked(row["columns"])]
            out.append(column.tobytes())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("shard", "docs", "bounds")), pa.array(out, pa.binary()), batch["counts"]], ["shard", "docs", "bounds", "columns", "counts"])


def _encoded(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The dictionary, the shards beside the numbers of their words, and the schema of the matrix."""
    small_batches(docs.sparkSession, rows=4096, size=SHARD_BYTES)
    text, part = F.coalesce("text", F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    shards = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("text")).mapInArrow(_shards, _SHARD), "shards")
    words = shards.agg(F.sum("n_words")).first()[0] or 0
    bits = max(6, (words // _WORDS_OF_RANGE).bit_length())
    sent = shards.where("n_words > 0").select("shard", "words").mapInArrow(_ranges(bits), "range long, shard long, words binary")
    numbered = materialize(sent.groupBy("range").applyInArrow(_numbered, _NUMBERED), "numbered")
    own = numbered.where("words is not null").select("range", F.posexplode(F.arrays_zip("words", "shards")).alias("place", "w"))
    dictionary = own.select("w.words", "w.shards", (F.shiftleft("range", 32) + F.col("place")).alias("number")).withColumnRenamed("words", "word")
    back = numbered.where("shard is not null").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("range", "numbers"))).alias("held"))
    kinds = {f.name: f.dataType.simpleString() for f in shards.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("shard", "docs", "bounds", "columns", "counts"))
    return dictionary, shards.drop("words", "n_words").join(back, "shard", "left"), schema


def matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary (word, number, shards that have it) of all words, and the matrix as CSR shards: shard, docs, bounds and columns (64-bit), counts (``unpacked``)."""
    dictionary, shards, schema = _encoded(docs)
    return dictionary, shards.mapInArrow(_renumbered, schema)


def _row_sums(batches):
    """Words (sum of a row) and distinct words (its entries) of each document, with what else the filters need."""
    for batch in batches:
        for row in batch.to_pylist():
            bounds = np.frombuffer(row["bounds"], np.int64)
            words, docs = _sums(unpacked(row["counts"]), bounds), row["docs"]
            arrays = [pa.array([x[c] for x in docs], k) for c, k in (("doc_id", pa.int64()), ("part", pa.string()), ("upper", pa.int64()), ("points", pa.int64()), ("marked", pa.bool_()), ("digest", pa.binary()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(words), pa.array(np.diff(bounds))], ["doc_id", "part", "upper", "points", "marked", "digest", "n_words", "n_distinct"])


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i set: fails FILTERS[i]), n, good, toxic: documents by part and failing set; see ``interactions``."""
    _, shards, _ = _encoded(docs)
    rows = shards.mapInArrow(lambda batches: _row_sums(_renumbered(batches)), "doc_id long, part string, upper long, points long, marked boolean, digest binary, n_words long, n_distinct long")
    fails = (F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), 100 * F.col("upper") > MOST_UPPER * F.col("points"), F.col("marked"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = materialize(rows.select("doc_id", "part", "digest", mask.alias("mask")), "rows")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    counted = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    named = counted.where("doc_id is not null").join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    marked = named.unionByName(counted.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    # Copies of a text differ in doc_id, part and labels alone: counts by part and labels, with the least doc_id of each and how often it stands there
    kinds = ("digest", "part", "mask", "good", "toxic")
    copies = marked.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    texts = copies.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "unnamed", "least")).alias("kinds"))
    kind = texts.select("first", F.explode("kinds").alias("k")).select("first", "k.*")
    original = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    sides = F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - original).alias("n")))
    side = kind.select("part", "good", "toxic", F.explode(sides).alias("s")).select("part", "good", "toxic", "s.*").where("n > 0")
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return side.groupBy("part", "mask").agg(F.sum("n").alias("n"), only("good"), only("toxic"))


def _steps() -> str:
    """Each step of each order: its filter's bit and those of the filters before."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return json.dumps([{"filter_order": "".join(o), "step": k + 1, "bit": bit[o[k]], "before": sum(bit[f] for f in o[:k])} for o in permutations(FILTERS) for k in range(len(o))])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order of the five, by part (the lang; null is the empty one).

    A document fails A with under 200 words, B where under half of its words are distinct, C where over 3 % of its code points are
    A to Z, D with any of #$%&*|, E where a smaller doc_id has the same text. Null texts are empty; an empty text fails A alone,
    and E as any other. Rows without a doc_id have no label, never fail E and make no other row fail it; rows that share a
    doc_id are documents each, and no copies of one another. Several labels of a doc_id count as one that holds any of their ones.
    Other columns are ignored. An empty table gives no rows; otherwise each part has 600: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    counted = flags(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = counted.select("part", "sets", F.explode(steps).alias("s")).select("part", "sets", "s.*")
    meets = lambda m, c: m.bitwiseAND(F.col(c)) != 0

    def total(count: str, test) -> F.Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda t, s: t + F.when(test(s["mask"]), s[count]).otherwise(0))

    here = lambda m: meets(m, "bit") & ~meets(m, "before")
    orders = lambda s: F.when(meets(s["mask"], "bit"), s["n"] * (F.lit(120) / F.bit_count(s["mask"])).cast("long")).otherwise(0)  # noqa: E731  orders in which the filter is the first of those that a set fails
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~meets(m, "bit") & ~meets(m, "before")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: meets(m, "bit") & meets(m, "before")).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate("sets", F.lit(0).cast("long"), lambda t, s: t + orders(s)).alias("shapley"),
    )
