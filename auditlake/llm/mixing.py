"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is each of its documents' expected number of copies. The whole part is taken as is; the
fraction is a copy probability. Documents of a source meet in blocks of like size (within a factor of two): going through
a block from the largest down, a pair randomly transfers mass, counted in words, until one of the two is 0 or 1, and the
other goes on. The expected words stay as they are with every transfer. Each block leaves one fractional document, which
meets those of other blocks in a reduction tree. The tree ends in one fractional document for each size level of a source;
these few are settled from the largest down, each taken if the words that are still due ask for it, so that a source ends
within about its smallest such document of its target. The few documents that are large against the target are decided before
all others, whose fractions then make up for what that left or took; where those could not, the last large one goes the way that
they can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
_FAN_IN = 64
_HEAVY = 50  # a document of over 1/50 of its source's target is decided first,
_SHARE = 10_000  # if it is over 1/10000 of the source as well: so a source has fewer than that


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes_by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of the total size by repeating weights in order of the source.

    A target stops at ``most`` times its source's size; the excess goes to the others by weight. Solved at once: with
    sources in order of cap over weight, those before some place stand at their caps and the rest share what is left.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.lit(list(weights)), F.pmod(order - 1, F.lit(len(weights))).cast("int") + 1).cast("long")
    w = sizes_by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("sharing", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    free = F.col("left") * F.col("weight") <= F.col("cap") * F.col("sharing")  # this and all later ones stay below their caps
    w = w.withColumn("first", F.max(F.when(free, F.struct(-F.col("cap") / F.col("weight"), F.struct(F.col("left"), F.col("sharing")).alias("s")))).over(everything)["s"])
    share = F.col("weight") * F.col("first.left") / F.col("first.sharing")
    return w.select("source", "source_size", F.least(F.coalesce(share, F.lit(0.0)), F.col("cap").cast("double")).alias("target"))


def _paired(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One round: the units (doc, p, size) of each group, from the largest down, in an array with 0 or 1 for all but the last."""
    unit = F.struct(F.col("size"), F.col("doc"), F.col("p"))
    grouped = units.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(unit))).alias("u"))
    none = F.expr("cast(array() as array<struct<doc:string,one:boolean>>)")
    start = F.struct(F.col("u")[0]["doc"].alias("doc"), F.col("u")[0]["size"].alias("size"), F.col("u")[0]["p"].alias("p"), none.alias("done"))
    words = lambda x: F.greatest(x["size"], F.lit(1)).cast("double")

    def meet(a, x):
        u = (F.pmod(F.xxhash64(a["doc"], x["doc"], F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        # Words that would make one of the two integral: towards a, or towards x. Each way is as likely as the other is long, so neither gains.
        room_a, room_x, held_a, held_x = (1 - a["p"]) * words(a), (1 - x["p"]) * words(x), a["p"] * words(a), x["p"] * words(x)
        to_a, to_x = F.least(room_a, held_x), F.least(held_a, room_x)
        up = u < to_x / F.greatest(to_a + to_x, F.lit(1e-300))
        a_is_done = F.when(up, room_a <= held_x).otherwise(held_a <= room_x)
        one = F.when(a_is_done, up).otherwise(~up)  # what is done is 1 if it gained
        moved = F.when(up, to_a).otherwise(-to_x)
        left = F.when(a_is_done, x["p"] - moved / words(x)).otherwise(a["p"] + moved / words(a))
        pick = lambda name: F.when(a_is_done, x[name]).otherwise(a[name])
        done = F.struct(F.when(a_is_done, a["doc"]).otherwise(x["doc"]).alias("doc"), one.alias("one"))
        return F.struct(pick("doc").alias("doc"), pick("size").alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)).alias("p"), F.concat(a["done"], F.array(done)).alias("done"))

    folded = F.aggregate(F.slice("u", F.lit(2), F.greatest(F.size("u") - 1, F.lit(0))), start, meet)
    return grouped.select(*keys, folded.alias("f"))


def _settled(left: DataFrame) -> DataFrame:
    """(doc, one) of each source's last units, one for each level: taken from the largest down while the words due ask for it."""
    unit = F.struct(F.col("size"), F.col("doc"), F.col("p"))
    units = left.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(unit))).alias("u"))  # a level doubles the size: a few dozen
    sized = lambda x: x["size"].cast("double")
    zero, none = F.lit(0.0), F.expr("cast(array() as array<struct<doc:string,one:boolean>>)")
    start = F.struct(F.aggregate("u", zero, lambda t, x: t + x["p"] * sized(x)).alias("due"), F.aggregate("u", zero, lambda t, x: t + sized(x)).alias("rest"), none.alias("done"))

    def settle(state, x):
        rest = state["rest"] - sized(x)  # words of the units that are left to take
        one = (state["due"] >= sized(x)) | (state["due"] - rest > sized(x) - state["due"])
        due = F.when(one, state["due"] - sized(x)).otherwise(state["due"])
        return F.struct(due.alias("due"), rest.alias("rest"), F.concat(state["done"], F.array(F.struct(x["doc"].alias("doc"), one.alias("one")))).alias("done"))

    return units.select(F.explode(F.aggregate("u", start, settle)["done"]).alias("d")).select("d.doc", "d.one")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, block: int = 64) -> DataFrame:
    """How often the mix takes each document.

    Needs doc_id, text, source. Size: words of the text (null: 0). Null is a source of its own, last in order. Rows that share a doc_id and source are
    told apart by an occurrence number, so their copies add up. Reruns agree. Other columns are ignored, an empty table gives no rows. The targets come from one row for each
    source, which meet in one task: sources are taken to be thousands at most. Returns doc_id, source, size, nth (the
    occurrence among rows of that doc_id, source and size, from 1), source_size, target, copies.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    base = sizes(base).drop("text").groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("times"))
    base = materialize(base.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), "times")).alias("nth")).withColumn("doc", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "nth", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit(":"), "source")))), "sizes")
    planned = materialize(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = base.join(planned.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    rated = rated.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.floor("rate"))
    level = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int")
    heavy = (F.col("size") * _HEAVY > F.col("target")) & (F.col("size") * _SHARE > F.col("source_size"))
    rest = materialize(rated.where("p > 0").where(~heavy).groupBy("source").agg(F.sum("size").alias("room"), F.max("p").alias("rate")).withColumnRenamed("source", "s"), "rest")
    large = _paired(rated.where("p > 0").where(heavy), ["source"], seed).join(rest, F.col("source").eqNullSafe(F.col("s")), "left")  # fewer than _SHARE documents of a source
    toss = (F.pmod(F.xxhash64("f.doc", F.lit(seed + 1)), F.lit(1 << 52)) + 0.5) / float(1 << 52) < F.col("f.p")
    room, rate = F.coalesce("room", F.lit(0)), F.coalesce("rate", F.lit(0.0))  # what the others can give up or take on
    if_one, if_none = F.greatest(F.lit(0.0), (1 - F.col("f.p")) * F.col("f.size") - rate * room), F.greatest(F.lit(0.0), F.col("f.p") * F.col("f.size") - (1 - rate) * room)
    last = F.when(if_one < if_none, True).when(if_one > if_none, False).otherwise(toss)
    decided = materialize(large.select(F.explode(F.concat("f.done", F.array(F.struct(F.col("f.doc").alias("doc"), last.alias("one"))))).alias("d")).select("d.doc", "d.one"), "decided")
    over = rated.join(decided, "doc").groupBy("source").agg(F.sum((F.col("p") - F.col("one").cast("int")) * F.col("size")).alias("due"))
    shift = rest.join(over, F.col("source").eqNullSafe(F.col("s"))).select("s", (F.col("due") / F.greatest("room", F.lit(1))).alias("shift"))
    light = rated.where("p > 0").where(~heavy).join(shift, F.col("source").eqNullSafe(F.col("s")), "left")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + F.coalesce("shift", F.lit(0.0))))
    units = materialize(light.select("source", level.alias("level"), "size", "doc", p.alias("p")), "units")
    crowd = units.groupBy("source", "level").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    units = units.join(crowd.withColumnRenamed("source", "s").withColumnRenamed("level", "l"), F.col("source").eqNullSafe(F.col("s")) & (F.col("level") == F.col("l"))).drop("s", "l")
    units = units.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("blocks"))).drop("blocks")
    blocks = crowd.agg(F.max("blocks")).first()[0] or 1
    keys = ["source", "level", "block"]
    while True:
        met = materialize(_paired(units, keys, seed), "pairs")
        done = met.select(F.explode("f.done").alias("d")).select("d.doc", "d.one")
        decided = decided.unionByName(done)
        left = met.select(*keys, "f.doc", "f.size", "f.p")
        if blocks == 1:
            break
        blocks = -(-blocks // _FAN_IN)
        units = left.withColumn("block", F.floor(F.col("block") / _FAN_IN))
    chosen = decided.unionByName(_settled(left))
    out = rated.join(chosen, "doc", "left").withColumn("copies", F.col("whole") + F.coalesce(F.col("one").cast("int"), F.lit(0)))
    return out.select("doc_id", "source", "size", "nth", "source_size", "target", "copies")
