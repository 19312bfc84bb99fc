"""Personal data: pattern spans, and terms that reveal a protected entity by how the corpus uses them.

Entities are e-mail addresses, IP addresses, card and phone numbers. Around each one, the words within ``reach`` are
its context terms. Over the whole corpus, n(t) counts every occurrence of a term and n(t, e) those in contexts of e; and
again, n(t) the documents that hold a term and n(t, e) those that hold e too, wherever they stand. A term discloses e by
its pointwise mutual information, a share 1 - log2 p(e | t) / log2 p(e) of the entity's information, where
p(e | t) = n(t, e) / n(t). Terms that by either count disclose at least ``disclosure`` of it, seen with it ``support`` times
or more, are generalised (or removed) wherever they occur, in documents without the entity too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .storage import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, in forms that read a run of characters once: an address is found from its @ outwards, quantifiers give nothing back.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Bytes that are not part of a term: everything but ASCII letters and the bytes of other characters.
_OTHER = np.array([not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
SEEN = "term array<long>, entity array<long>, terms array<long>, entities array<long>"
FOUND = "doc_id long, text_key long, starts array<int>, ends array<int>, kinds array<int>, term array<long>, term_start array<int>, term_end array<int>"
#: Bits of the filter of terms, in slices.
_BITS, _SLICE = 1 << 26, 1 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _addresses(text: str) -> list[tuple[int, int, int]]:
    out, at = [], 0  # at: where the next local part may begin
    while (sign := text.find("@", at)) >= 0:
        start = at + len(text[at:sign].rstrip(_LOCAL))
        domain = DOMAIN.match(text, sign + 1) if start < sign else None
        at = domain.end() if domain else sign + 1
        if domain:
            out.append((0, start, at))
    return out


def _octets(address: str) -> bool:
    """Whether all parts are at most 255, whatever zeros they begin with."""
    parts = [p.lstrip("0") for p in address.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def entities(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in time linear in the text."""
    out = _addresses(text)
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if _octets(m[0])] if "." in text else []
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15] if "+" in text else []
    return out


def _terms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's terms and their code point starts and ends."""
    data = T.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = T.split(data, np.array([0, len(data)]), _OTHER)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return T.word_hashes(data, starts, ends).view(np.int64), chars[starts], chars[ends]


def _free(text: str, found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms outside all entities."""
    terms, starts, ends = _terms(text)
    inside = np.zeros(len(text) + 1, bool)
    for _, a, b in found:
        inside[a:b] = True
    free = ~inside[starts] if len(starts) else np.zeros(0, bool)
    return terms[free], starts[free], ends[free]


def _contexts(text: str, found: list[tuple[int, int, int]], reach: int) -> tuple[list, list, list, list]:
    """Terms beside the entities and their entities (once per occurrence and entity); all terms and all entities, each once."""
    terms, starts, _ = _free(text, found)
    out: tuple[list, list] = ([], [])
    seen, names = set(), set()
    for _, a, b in found:
        name = np.frombuffer(text[a:b].encode(), np.uint8)
        entity = int(T.word_hashes(name, np.array([0]), np.array([len(name)])).view(np.int64)[0])
        names.add(entity)
        at = int(np.searchsorted(starts, a))
        for i in range(max(0, at - reach), min(len(terms), at + reach)):
            if (entity, int(starts[i])) not in seen:
                seen.add((entity, int(starts[i])))
                out[0].append(int(terms[i]))
                out[1].append(entity)
    return *out, np.unique(terms).tolist(), sorted(names)


def _seen(reach: int):
    """What stands with the entities, for each text that holds any."""

    def run(batches):
        for batch in batches:
            rows = [_contexts(text, found, reach) for text in batch["text"].fill_null("").to_pylist() if (found := entities(text))]
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64())) for c in columns], [part.split()[0] for part in SEEN.split(", ")])

    return run


def _bit(terms: np.ndarray) -> np.ndarray:
    return (T.mix(terms.view(np.uint64)) % np.uint64(_BITS)).astype(np.int64)


def _sliced(batches):
    """The bits of terms, by slice of the filter."""
    for batch in batches:
        bit = _bit(batch["term"].to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(bit // _SLICE), pa.array((bit % _SLICE).astype(np.int32))], ["slice", "bit"])


def _packed(key, bits):
    mask = np.zeros(_SLICE, bool)
    mask[bits["bit"].to_numpy()] = True
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "mask": pa.array([np.packbits(mask).tobytes()], pa.binary())})


def _filter(terms: DataFrame):
    """A filter of fixed size that passes all of the terms and few others."""
    whole = np.zeros(_BITS // 8, np.uint8)
    for r in terms.mapInArrow(_sliced, "slice long, bit int").groupBy("slice").applyInArrow(_packed, "slice long, mask binary").collect():
        whole[r.slice * (_SLICE // 8) : (r.slice + 1) * (_SLICE // 8)] = np.frombuffer(r.mask, np.uint8)
    return terms.sparkSession.sparkContext.broadcast(whole.tobytes())


def _found(passed):
    """Entities of each text, and its terms outside them that the filter passes."""

    def run(batches):
        mask = np.frombuffer(passed.value, np.uint8)
        for batch in batches:
            rows = []
            for text in batch["text"].fill_null("").to_pylist():
                found = entities(text)
                kinds, starts, ends = zip(*found) if found else ((), (), ())
                columns = _free(text, found)
                bit = _bit(columns[0])
                hit = (mask[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                rows.append((starts, ends, kinds, *(c[hit].tolist() for c in columns)))
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (ints, ints, ints, longs, ints, ints))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], *columns], [part.split()[0] for part in FOUND.split(", ")])

    return run


def _counted(buckets: int, most: int = 1 << 19):
    """Occurrences of every term of a task's texts and the texts that hold it, by bucket: hashes and counts."""

    def rows(terms: np.ndarray, *counts: np.ndarray):
        bucket = (terms.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        here, at = np.unique(bucket[order], return_index=True)
        at = np.append(at, len(order))
        cut = [order[i:j] for i, j in zip(at, at[1:])]
        packed = [pa.array([n[c].astype(np.uint32).tobytes() for c in cut], pa.binary()) for n in counts]
        return pa.RecordBatch.from_arrays([pa.array(here), pa.array([terms[c].tobytes() for c in cut], pa.binary()), *packed], ["bucket", "terms", "counts", "docs"])

    def of(terms: np.ndarray, row: np.ndarray):
        order = np.argsort(terms, kind="stable")
        terms, row = terms[order], row[order]
        new = np.append(True, terms[1:] != terms[:-1]) if len(terms) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        docs = new.copy()
        docs[1:] |= row[1:] != row[:-1]
        return terms[at], np.diff(np.append(at, len(terms))), np.add.reduceat(docs.astype(np.int64), at) if len(at) else at

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            terms, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return terms, *(np.bincount(back, np.concatenate([h[k] for h in held]), len(terms)).astype(np.int64) for k in (1, 2))

        for batch in batches:
            data, offsets = T.utf8(batch["text"])
            for _, _, d, o in T.chunks(data, offsets, 4 << 20):
                d = T.LOWER[d]
                starts, ends, first = T.split(d, o, _OTHER)
                held.append(of(T.word_hashes(d, starts, ends).view(np.int64), T.rows_of(first)))
                if sum(len(h[0]) for h in held) > most:
                    held = [merged()]
                    if len(held[0][0]) > most // 2:
                        yield rows(*held[0])
                        held = []
        if held:
            yield rows(*merged())

    return run


def _looked_up(key, wanted, counted):
    """Counts of the wanted terms of a bucket."""
    terms = np.sort(wanted["term"].to_numpy()) if wanted.num_rows else np.zeros(0, np.int64)
    n, docs = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    if len(terms):
        for t, *counts in zip(*(counted[c].to_pylist() for c in ("terms", "counts", "docs"))):
            t = np.frombuffer(t, np.int64)
            at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            hit = terms[at] == t
            for total, c in zip((n, docs), counts):
                np.add.at(total, at[hit], np.frombuffer(c, np.uint32)[hit].astype(np.int64))
    return pa.table({"term": terms, "n": n, "n_docs": docs})


def find(docs: DataFrame, reach: int = 6, disclosure: float = 0.95, support: int = 3) -> DataFrame:
    """Spans of personal data in each whole text, and of the terms that disclose it.

    Needs doc_id and text; null texts are empty, null and repeated doc_ids stay, other columns are ignored, an empty table gives
    no rows. Returns one row for each row of docs: doc_id, text_key (a hash of the text, which tells rows of one doc_id apart) and spans: array of (kind, start, end) in code points, end exclusive, kinds in the
    order of ``KINDS`` and then ``term``, each by start.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = materialize(docs.select("text").mapInArrow(_seen(reach), SEEN).withColumn("row", F.monotonically_increasing_id()), "seen")
    number_of = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("docs")).first()
    buckets = int((number_of.size or 0) // (32 << 20)) + 1
    log_share = lambda part, whole: F.least(F.log2(F.col(part) / F.lit(whole)), F.lit(-1e-9))

    beside = seen.select(F.explode(F.arrays_zip("term", "entity")).alias("x")).select("x.term", "x.entity")
    together = materialize(beside.groupBy("term", "entity").agg(F.count("*").alias("both")), "together")
    likely = together.where(F.col("both") >= support)
    held_terms = seen.select("row", F.explode("terms").alias("term"))
    often = held_terms.groupBy("term").agg(F.count("*").alias("among")).where(F.col("among") >= support)

    counted = docs.select("text").mapInArrow(_counted(buckets), "bucket long, terms binary, counts binary, docs binary")
    wanted = likely.select("term").union(often.select("term")).distinct().withColumn("bucket", _bucket(F.col("term"), buckets))
    number = materialize(wanted.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_looked_up, "term long, n long, n_docs long"), "numbers")

    slots = together.groupBy("entity").agg(F.sum("both").alias("slots"))
    every_slot = together.agg(F.sum("both")).first()[0] or 1
    share = 1 - F.log2(F.col("both") / F.col("n")) / log_share("slots", every_slot)
    near = likely.join(number, "term").join(slots, "entity").where("n > 0").where(share >= disclosure).select("term")

    # p(e | t) is at most the share of the term's documents that hold any entity, and p(e) at least support documents: terms below can disclose none.
    docs_of = seen.select("row", F.explode("entities").alias("entity"))
    holders = docs_of.groupBy("entity").agg(F.count("*").alias("held")).where(F.col("held") >= support)
    least = (support / max(number_of.docs, support)) ** (1 - disclosure)
    able = often.join(number, "term").where(F.col("among") >= F.col("n_docs") * (least * (1 - 1e-9))).select("term", "n_docs")
    pairs = held_terms.join(able, "term").join(docs_of.join(holders, "entity"), "row").groupBy("term", "entity").agg(F.count("*").alias("both"), F.first("n_docs").alias("n_docs"), F.first("held").alias("held"))
    share = 1 - F.log2(F.col("both") / F.col("n_docs")) / log_share("held", number_of.docs or 1)
    far = pairs.where((F.col("both") >= support) & (share >= disclosure)).select("term")

    disclosing = materialize(near.union(far).distinct().withColumn("hit", F.lit(True)), "disclosing")
    found = materialize(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_found(_filter(disclosing.select("term"))), FOUND), "entities")
    named = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(F.element_at(F.lit(list(KINDS)), x["kinds"] + 1).alias("kind"), x["starts"].alias("start"), x["ends"].alias("end")))
    base = found.select("doc_id", "text_key", named.alias("base"), F.arrays_zip("term", "term_start", "term_end").alias("c"))
    plain = base.where(F.size("c") == 0).select("doc_id", "text_key", F.col("base").alias("spans"))
    rich = base.where(F.size("c") > 0).withColumn("row", F.monotonically_increasing_id())
    terms = rich.select("row", "doc_id", "text_key", "base", F.explode("c").alias("x")).select("row", "doc_id", "text_key", "base", "x.*").join(disclosing, "term", "left")
    spot = F.when(F.col("hit"), F.struct(F.lit("term").alias("kind"), F.col("term_start").alias("start"), F.col("term_end").alias("end")))
    kept = terms.groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "text_key", "base")), F.array_sort(F.collect_set(spot)).alias("t"))
    return plain.unionByName(kept.select("doc_id", "text_key", F.concat("base", "t").alias("spans")))


def _bucket(term: Column, buckets: int) -> Column:
    """A 64-bit hash, read as unsigned, modulo the number of buckets."""
    half = F.pmod(F.shiftrightunsigned(term, 1), F.lit(buckets))
    return F.pmod(half * 2 + F.pmod(term, F.lit(2)), F.lit(buckets)).cast("long")


def sanitise(text: Column, spans: Column, remove_terms: bool = False) -> Column:
    """The text with each span replaced by its kind in brackets (terms removed altogether on request); overlapping spans merge into the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(a, s):
        mark = F.when((s["kind"] == "term") & F.lit(remove_terms), F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        end = -s["back"]
        return F.when(s["start"] < a["at"], F.struct(a["done"].alias("done"), F.greatest(a["at"], end).alias("at"))).otherwise(F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), mark).alias("done"), end.alias("at")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, state, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text)))))
