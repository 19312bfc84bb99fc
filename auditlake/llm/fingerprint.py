"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is read as pieces. Where a piece ends depends on its own characters alone: at white space, after certain rare letters
and digits, and after each character of a script without spaces. A k-mer is ``K`` pieces in a row; it is an anchor when
the least of its inner substrings of ``S`` pieces (by hash) is the first or the last one. So whether a k-mer is an anchor
depends on nothing but itself, and an edit changes no anchors elsewhere, only their positions. Beyond both ends stand
``K`` - 1 blanks, which gives short texts anchors, too. A fingerprint holds all anchors with their positions; texts match
where they have anchors in common.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 8, 2
_BLANK = 0
_LAST = (1 << 63) - 1
_SINGLE = r"\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_ENDS = "jkqxzJKQXZ0-9"
PIECE = rf"([{_SINGLE}]|[^\x20\x09-\x0D{_SINGLE}{_ENDS}]++[{_ENDS}]?|[{_ENDS}])"
ANCHORS = "array<struct<position:int,mark:bigint>>"
_MOST_RANGES = 1 << 16


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def anchors(text: Column) -> Column:
    """A text's closed syncmers in order: (position of the first piece, from -K + 1, hash); none for a text without pieces."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE))
    blanks = F.array_repeat(F.lit(_BLANK).cast("long"), K - 1)
    inner = K - S + 1
    none = F.expr(f"cast(array() as {ANCHORS})")

    def found(h: Column) -> Column:
        def pair(i: Column) -> Column:
            a, b = F.get(h, i), F.get(h, i + 1)
            return F.when((a == _BLANK) & (b == _BLANK), F.lit(_LAST)).otherwise(F.xxhash64(a, b))

        pairs = F.transform(F.sequence(F.lit(0), F.size(h) - S), pair)

        def chosen(m: Column) -> Column:
            edge = lambda i: F.least(F.get(m, i), F.get(m, i + inner - 1)) <= F.least(*[F.get(m, i + j) for j in range(1, inner - 1)])
            starts = F.filter(F.sequence(F.lit(0), F.size(h) - K), edge)
            return F.transform(starts, lambda i: F.struct((i - (K - 1)).alias("position"), F.xxhash64(F.slice(h, i + 1, F.lit(K))).alias("mark")))

        return _let(pairs, chosen)

    return _let(F.transform(pieces, lambda p: F.xxhash64(p)), lambda h: F.when(F.size(h) > 0, _let(F.concat(blanks, h, blanks), found)).otherwise(none))


def fingerprint(anchors_: Column) -> Column:
    """Anchors as text: position and the upper 32 bits of the hash in hexadecimal, joined; empty for none."""
    one = lambda a: F.concat(a["position"].cast("string"), F.lit(":"), F.lpad(F.hex(F.shiftrightunsigned(a["mark"], 32)), 8, "0"))
    return F.array_join(F.transform(anchors_, one), ",")


def marks(anchors_: Column) -> Column:
    return F.transform(anchors_, lambda a: a["mark"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' distinct anchors (arrays of ``marks``); 1 for two empty ones."""
    union = lambda x: F.size(F.array_union(x["a"], x["b"]))
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when(F.size(x["a"]) + F.size(x["b"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.greatest(union(x), F.lit(1)).cast("double")))


def matches(a: Column, b: Column) -> Column:
    """Where two texts agree: (position in a, position in b) of the anchors of a that b has, at their first place in b."""

    def place(x: Column, known: Column) -> Column:
        return F.element_at(b, F.array_position(known, x["mark"]).cast("int"))["position"]

    return _let(marks(b), lambda known: F.transform(F.filter(a, lambda x: F.array_contains(known, x["mark"])), lambda x: F.struct(x["position"].alias("a"), place(x, known).alias("b"))))


def _below(cuts: list[int], x: Column, equal: bool) -> Column:
    """How many of the sorted cuts are below x (or equal to it), by bisection."""
    at = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []

    def go(place: Column, step: Column) -> Column:
        cut = F.get(at, place + step - 1)
        return F.when((cut <= x) if equal else (cut < x), place + step).otherwise(place)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), go) if cuts else F.lit(0)


def with_next(docs: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, text and the text of the next row in order of doc_id (nulls last), a hash of the text, text; the last row's next is the first.

    Rows are dealt to ranges of about ``range_bytes``; doc_ids with many rows, null too, are split by the hash. Each range
    ends in a copy of the first row of the next one. Whole texts are shuffled once. Ranges are 65536 at most and grow beyond that.
    """
    rows = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    number = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    ranges = min(_MOST_RANGES, int((number.bytes or 0) // range_bytes) + 1)
    per = max(1, -(-number.rows // ranges))
    named, nameless = max(1, -(-number.named // per)), max(1, -(-(number.rows - number.named) // per))
    share = [i / named for i in range(1, named)]
    cuts = sorted(rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), max(10_000, 10 * named)).alias("c")).first()["c"] or []) if share else []
    part = lambda m: F.least((F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * m)).cast("int"), (m - 1).cast("int") if isinstance(m, Column) else F.lit(m - 1))
    low, high = _below(cuts, F.col("doc_id"), False), _below(cuts, F.col("doc_id"), True)
    # a cut that is a doc_id itself, m times, gives it m ranges
    placed = rows.withColumn("b", F.struct(low.alias("low"), high.alias("high")))
    hot = F.col("b.low") + 1 + part(F.col("b.high") - F.col("b.low"))
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + part(nameless)).when(F.col("b.low") < F.col("b.high"), hot).otherwise(F.col("b.high"))
    placed = placed.withColumn("range", place.cast("int")).drop("b")
    # the first row of each range: its key first, then the texts of these few alone
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    least = placed.groupBy("range").agg(F.min(order).alias("o")).select(F.col("range").alias("r"), F.col("o.doc_id").alias("d"), F.col("o.key").alias("k"))
    firsts = placed.join(F.broadcast(least), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")  # at most 2 * 65536 + 1 keys
    firsts = firsts.groupBy("range").agg(F.min("text").alias("text"))
    every = Window.orderBy("range")  # as many rows as there are ranges
    before = F.coalesce(F.lag("range").over(every), F.max("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = least.select(F.col("r").alias("range")).withColumn("to", before).join(firsts, "range").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("key"), F.col("to").alias("range"), F.lit(1).alias("end"))
    dealt = placed.withColumn("end", F.lit(0)).unionByName(ends).repartition(2 * ranges, "range")  # so that few ranges meet in a task
    by = [F.col("range"), F.col("end"), F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("text")]
    return dealt.sortWithinPartitions(*by).select("doc_id", "text", "range", "end", "key")


def fingerprints(docs: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of each whole text and of an edited copy.

    The edited text: the last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next
    document's. Null texts are empty; texts of white space have no anchors and empty fingerprints. Rows that share a doc_id
    follow each other in order of a hash of their text, null ids come last; other columns are ignored, an empty table gives no
    rows. Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_next(rows, range_bytes).withColumn("anchors", anchors(F.col("text")))
    w = Window.partitionBy("range").orderBy("end", F.col("doc_id").asc_nulls_last(), "key", "text")
    paired = own.withColumn("next", F.lead(F.struct("text", "anchors")).over(w)).where("end = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    marked = paired.select("doc_id", n.cast("long").alias("n_chars"), "anchors", marks(F.col("next.anchors")).alias("after"), edited.alias("edited"))
    marked = marked.withColumn("other", anchors(F.col("edited")))
    return marked.select("doc_id", "n_chars", "edited", fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"), likeness(marks(F.col("anchors")), marks(F.col("other"))).alias("near_edited"), likeness(marks(F.col("anchors")), F.col("after")).alias("near_next"))
