"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best-fit: a fixed number of open bins, in a bitset keyed by free space. A piece goes to the open
bin with the least free space that still holds it; if none does, a bin is opened, and if that is one too many the fullest
is closed first.

Texts are tokenised by chunks of a few MB, cut where the tokenizer's own first split always cuts: Arrow finds the distinct
parts of a chunk, the tokenizer encodes those that the task has not met, and the ids of all parts are gathered at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .storage import small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CHUNK = 2 << 20
_tokenizers: dict[str, object] = {}

#: Kinds of bytes: white space, ASCII letters, digits, other ASCII but apostrophes, apostrophes, bytes of other characters.
_SPACE, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(6)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[T.SEPARATORS] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _QUOTE
_KIND[0x80:] = _OTHER
#: Whether a part ends between two kinds. Letters, single digits and runs of marks are tokens of their own; what starts with an
#: apostrophe may be a contraction, and other characters may join with what stands before them.
_CUT = np.zeros((6, 6), bool)
_CUT[_SPACE, :] = _CUT[:, _SPACE] = True
for _a in (_LETTER, _DIGIT, _MARK):
    for _b in (_LETTER, _DIGIT, _MARK):
        _CUT[_a, _b] = _a != _b
_CUT[_DIGIT, _DIGIT] = _CUT[_LETTER, _QUOTE] = _CUT[_DIGIT, _QUOTE] = True


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all parts, and the index of each row's first part (n + 1 entries)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = _CUT[kind[:-1], kind[1:]]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    word = kind[edges[:-1]] != _SPACE
    starts = edges[:-1][word]
    return starts, edges[1:][word], np.searchsorted(starts, offsets)


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class Encoder:
    """Token ids of texts by way of their parts; the ids of up to ``most`` parts are kept, as long as the encoder lives.

    A text's ids are those of its parts, as no token crosses their bounds. A text with the string of a special token is
    encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.most = _tokenizer(path), most
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, parts: pa.Array) -> None:
        """Encode new parts, each once."""
        ids, ends, at = [self.ids], [self.bounds], int(self.bounds[-1])
        for i in range(0, len(parts), 10_000):
            some = parts[i : i + 10_000].cast(pa.string()).to_pylist()
            code = self.tokenizer.encode(" ".join(some), add_special_tokens=False)  # a space keeps two parts apart
            ids.append(np.array(code.ids, np.uint32))
            starts = np.fromiter((a for a, _ in code.offsets), np.int64, len(code.offsets))
            ends.append(np.searchsorted(starts, np.cumsum([len(w) + 1 for w in some])) + at)
            at += len(starts)
        self.known = pa.concat_arrays([self.known, parts])
        self.ids, self.bounds = np.concatenate(ids), np.concatenate(ends)

    def _codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each part among the known ones."""
        # parts and what stands between them, in turn: one Arrow array over the same bytes
        bounds = np.empty(2 * len(starts), np.int32)
        bounds[::2], bounds[1::2] = starts, ends
        spelled = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        codes = spelled.indices.to_numpy()[::2]
        held = np.zeros(len(spelled.dictionary), bool)
        held[codes] = True
        parts = spelled.dictionary.filter(pa.array(held))
        place = pc.index_in(parts, value_set=self.known)
        new = parts.filter(place.is_null())
        if len(new) and len(self.known) + len(new) > self.most:
            self._forget()
            place, new = pa.nulls(len(parts), pa.int32()), parts
        at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            self._learn(new)
        out = np.zeros(len(held), np.int64)
        out[held] = at
        return out[codes]

    def encode(self, column: pa.Array, end_id: int | None = None):
        """For runs of rows: (first row, end row, ids of all their texts, bounds of each text); ``end_id`` follows each text."""
        data, offsets = T.utf8(column)
        tail = [] if end_id is None else [end_id]
        for i, j, d, o in T.chunks(data, offsets, _CHUNK):
            d = T.LOWER[d]
            starts, ends, first = _parts(d, o)
            rows = j - i
            codes = self._codes(d, starts, ends) if len(starts) else np.zeros(0, np.int64)
            flat, bounds = self.ids, self.bounds
            if tail:  # the end token is one more part, after each row's own
                codes = np.insert(codes, first[1:], len(bounds) - 1)
                flat, bounds = np.append(flat, np.uint32(end_id)), np.append(bounds, bounds[-1] + 1)
                first = first + np.arange(rows + 1)
            size = np.diff(bounds)[codes]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.repeat(bounds[codes] - upto[:-1], size) + np.arange(upto[-1])]
            at = upto[first]
            raw = data[offsets[i] : offsets[j]]
            if any(s in raw.tobytes() for s in self.specials):
                parts = []
                for r in range(rows):
                    text = raw[o[r] : o[r + 1]].tobytes()
                    special = any(s in text for s in self.specials)
                    parts.append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids + tail, np.uint32) if special else ids[at[r] : at[r + 1]])
                ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield i, j, ids, at


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            docs = batch["doc_id"]
            for i, j, ids, at in encoder.encode(batch["text"], end_id):
                total = np.diff(at)
                count = -(-total // capacity)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                begin = (at[row] + start).tolist()
                view = memoryview(ids.astype("<u4")).cast("B")
                cuts = [view[4 * a : 4 * (a + n)] for a, n in zip(begin, length.tolist())]
                columns = [docs.slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                if with_ids:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([bytes(c) for c in cuts], pa.binary())], [*names, "ids"])
                else:
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


class OpenBins:
    """At most ``most`` open bins; ``place`` gives a piece's bin and offset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.free, self.bins, self.open, self.made = capacity, most, 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        fit = self.free >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1  # the fullest bin that holds it
            name = self._take(room)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            name, room = self.made, self.capacity
            self.made += 1
        if room > length:
            self.bins.setdefault(room - length, []).append(name)
            self.free |= 1 << (room - length)
            self.open += 1
        return name, self.capacity - room

    def _take(self, room: int) -> int:
        held = self.bins[room]
        name = held.pop()
        if not held:
            self.free &= ~(1 << room)
        self.open -= 1
        return name


def _packed(capacity: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        bins, base = OpenBins(capacity, most), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.place(n) for n in batch["length"].to_pylist()]
            columns = [*batch.columns, pa.array([base + a for a, _ in at], pa.int64()), pa.array([b for _, b in at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 256, with_ids: bool = False, rows_per_task: int = 100_000) -> DataFrame:
    """Tokenise every text, end it with ``end_id`` and pack the pieces into sequences of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut, into full pieces and a rest. Null and empty texts are one end token.
    Repeated rows are packed as often as they stand; null doc_ids are kept; other columns are ignored; an empty table gives
    no rows. ``tokenizer`` is the path of a file every executor has. ``with_ids`` adds the piece's ids (binary,
    little-endian unsigned 32 bit). Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = PIECES + ", ids binary" * with_ids
    pieces = docs.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), kind)
    tasks = docs.count() // rows_per_task + 1
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_packed(capacity, open_bins), kind + ", sequence_id long, offset long")
