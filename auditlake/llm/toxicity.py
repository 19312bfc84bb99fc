"""Toxicity by compression distance.

Two dictionaries are trained by zstandard, one on windows of toxic texts and one on windows of ordinary texts; both end in
the same base, trained on ordinary text, so that what they don't share tells. Most of a toxic text is ordinary, so training
goes by rounds: of each text in one half of the sample the windows are picked that the dictionaries of the other half tell
apart best, cut down to the stretch that does, and trained on again. A second pass learns from toxic texts that the first
doesn't explain.

A text is read as overlapping windows of letters, each letter widened to two bytes, since zstandard gives lengths in whole
bytes. A window's distance is its compressed length under the ordinary dictionary less that under the toxic one. The largest
distance of a text is turned into a probability by a monotone calibration on other labelled texts.
"""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SECOND = bytes((7 * b + 3) % 256 for b in range(256))
WINDOW, STEP = 128, 64  # letters
_STRETCH = 16
_BASE, _FIRST, _TOXIC, _ORDINARY = 1 << 18, 3 << 17, 1 << 13, 1 << 15  # bytes of the dictionaries


def _windows(text: bytes) -> list[bytes]:
    """Overlapping windows of a text: letters (ASCII ones in lower case) and single spaces, widened; one window at least."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    wide = bytearray(2 * len(folded))
    wide[::2], wide[1::2] = folded, folded.translate(_SECOND)
    return [bytes(wide[i : i + 2 * WINDOW]) for i in range(0, max(1, 2 * (len(folded) - WINDOW + STEP)), 2 * STEP)]


@dataclass(frozen=True)
class Model:
    """Dictionary contents, and the probability for each largest distance from 0 up."""

    toxic: bytes
    ordinary: bytes
    calibration: tuple[float, ...] = (0.0,)

    def distances(self) -> "Distances":
        return Distances(self.ordinary, self.toxic)

    def probability(self, distance: int) -> float:
        return self.calibration[min(distance, len(self.calibration) - 1)]


class Distances:
    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as Z

        def compressor(content: bytes):
            how = Z.ZstdCompressionParameters(window_log=21, hash_log=17, chain_log=17, search_log=4, min_match=5, target_length=32, strategy=Z.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
            book = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(compression_params=how)
            return Z.ZstdCompressor(dict_data=book, compression_params=how)

        self.ordinary, self.toxic = compressor(ordinary).compress, compressor(toxic).compress

    def of(self, window: bytes) -> int:
        return len(self.ordinary(window)) - len(self.toxic(window))

    def largest(self, text: bytes) -> int:
        """The largest distance of a text's windows, 0 at least."""
        return max(0, max(map(self.of, _windows(text))))


def _trained(windows: list[bytes], size: int) -> bytes:
    """A dictionary of up to ``size`` bytes and a quarter of the text, so that what stands in it once is left out; the text itself where it is too little to train on."""
    import zstandard as Z

    try:
        return Z.train_dictionary(max(1024, min(size, sum(map(len, windows)) // 4)), windows, k=2 * _STRETCH, d=8).as_bytes()
    except Z.ZstdError:
        return b"".join(windows)[-size:]


def _stretches(texts: list[list[bytes]], by: Distances, trim: float = 0.0, most: int = 8) -> list[bytes]:
    """Of each text's windows the few with the largest distances above 0, each cut to the stretch that has its distance.

    The share ``trim`` of texts with the largest distances is left out: those may be labelled wrongly.
    """
    out = []
    told = [sorted((-by.of(w), i) for i, w in enumerate(windows))[:most] for windows in texts]
    least = sorted((t[0][0] for t in told))[int(trim * len(told))] if told else 0
    for windows, far in zip(texts, told):
        for d, i in far if not trim or far[0][0] >= least else []:
            if d < 0:
                parts = [windows[i][a : a + 2 * _STRETCH] for a in range(0, max(1, len(windows[i]) - 2 * _STRETCH + 8), 8)]
                told = [by.of(p) for p in parts]
                best = [n for n, t in enumerate(told) if t == max(told)]
                out.append(parts[best[len(best) // 2]])
    return out


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]], rounds: int = 4, passes: int = 3) -> Model:
    """Dictionaries from the windows of labelled texts, not calibrated yet. Without texts of both kinds both are empty."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"")
    rng = random.Random(7)
    some = lambda texts, n: (lambda every: rng.sample(every, min(n, len(every))))([w for t in texts for w in t])
    base = _trained(some(ordinary, 20_000), _BASE)
    bad, good, left = b"", b"", toxic
    for _ in range(passes):
        halves, clean = (left[::2], left[1::2]), (ordinary[::2], ordinary[1::2])
        new, old = _trained(some(halves[0], 6000), _FIRST), _trained(some(clean[0], 6000), _FIRST)
        for turn in range(1, rounds + 1):
            by = Distances(good + old + base, bad + new + base)
            far, near = _stretches(halves[turn % 2], by), _stretches(clean[turn % 2][:600], by, 0.05)
            if len(far) < 20:
                break
            new, old = _trained(far, _TOXIC), _trained(near, _ORDINARY)
        bad, good = bad + new, good + old
        by = Distances(good + base, bad + base)
        usual = sorted(max(map(by.of, t)) for t in ordinary[:400])[int(0.98 * (min(len(ordinary), 400) - 1))]
        left = [t for t in left if max(map(by.of, t)) <= usual]
        if len(left) < 40:
            break
    return Model(bad + base, good + base)


def calibrated(model: Model, seen: dict[int, tuple[int, int]]) -> Model:
    """The model with probabilities from (ordinary, toxic) counts by largest distance: the monotone fit, by pooling neighbours."""
    if not seen:
        return model
    blocks: list[list[float]] = []  # [toxic, all, first distance]
    for d in sorted(seen):
        blocks.append([seen[d][1], sum(seen[d]), d])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t, n, _ = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += n
    value = [0.0] * (max(seen) + 1)
    for (t, n, d), end in zip(blocks, [*(b[2] for b in blocks[1:]), len(value)]):
        value[d:end] = [(t + 0.1) / (n + 0.2)] * (end - d)
    return Model(model.toxic, model.ordinary, tuple(value))


def _sampled(most: int):
    """Up to ``most`` windows of each text, in their order, chosen by the text's checksum."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"].fill_null("").cast(pa.binary()).to_pylist():
                windows = _windows(text)
                if len(windows) > most:
                    windows = [windows[i] for i in sorted(np.random.default_rng(zlib.crc32(text)).choice(len(windows), most, replace=False))]
                out.append(windows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(out, pa.list_(pa.binary()))], ["doc_id", "label", "windows"])

    return run


def _measured(model: Model):
    def run(batches):
        by = model.distances()
        for batch in batches:
            far = [by.largest(t) for t in batch["text"].fill_null("").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(far, pa.int32())], ["label", "distance"])

    return run


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 2000, ordinary: int = 4000, windows: int = 60) -> Model:
    """A model from the labelled documents.

    labels: doc_id, toxic (0 or 1; others and nulls are ignored, and so is a doc_id with both). The sample is bounded: so many
    toxic and ordinary doc_ids, the first in order of a hash, three of four for the dictionaries (up to ``windows`` windows
    of each of their texts come to the driver), the rest for the calibration (whole texts, measured where they are).
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").cast("int").alias("label"), F.max("toxic").cast("int").alias("other")).where("label = other")
    place = F.xxhash64("doc_id", F.lit(5))
    picked = [known.where(F.col("label") == label).orderBy(place, "doc_id").limit(most) for label, most in ((1, toxic), (0, ordinary))]
    sample = picked[0].unionByName(picked[1]).select("doc_id", "label", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0).alias("test"))
    texts = lambda test: docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample.where(F.col("test") == test).drop("test")), "doc_id")  # noqa: E731  # at most toxic + ordinary rows
    rows = texts(False).mapInArrow(_sampled(windows), "doc_id long, label int, windows array<binary>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.windows))
    model = train([r.windows for r in rows if r.label == 1], [r.windows for r in rows if r.label == 0])
    if not model.toxic:
        return model
    seen: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for r in texts(True).mapInArrow(_measured(model), "label int, distance int").groupBy("label", "distance").count().collect():
        seen[r.distance][r.label] += r["count"]
    return calibrated(model, seen)


def _scored(model: Model):
    def run(batches):
        by = model.distances() if model.toxic else None
        for batch in batches:
            texts = batch["text"].fill_null("").cast(pa.binary()).to_pylist()
            scores = [model.probability(by.largest(t)) if by else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score (0 to 1; replaces one of that name) for each whole text.

    Rows stay as they are, whatever their doc_id; null and empty texts get the score of a text without letters; an empty
    table stays empty. A model without both kinds of texts scores 0.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("score")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_scored(model), f"{kind}, score double")
