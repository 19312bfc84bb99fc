"""Sealing and verifying hash chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ed25519
from ..functions.canonical import GENESIS_HASH, canonical, record_hash
from ..sources.shared import written
from .ranges import with_previous

SEALED = "chain_id string, seq long, prev_hash string, hash string, event string"


def _fold(genesis: str):
    def run(batches):
        chain, prev = None, genesis
        for batch in batches:
            chains, events = batch["chain_id"].to_pylist(), batch["event"].to_pylist()
            before, after = [], []
            for c, event in zip(chains, events):
                if c != chain:
                    chain, prev = c, genesis
                before.append(prev)
                prev = hashlib.sha256(f"{prev}\n{event}".encode()).hexdigest()
                after.append(prev)
            yield pa.RecordBatch.from_arrays([batch["chain_id"], batch["seq"], pa.array(before, pa.string()), pa.array(after, pa.string()), batch["event"]], ["chain_id", "seq", "prev_hash", "hash", "event"])

    return run


def seal(events: DataFrame, genesis: str = GENESIS_HASH) -> DataFrame:
    """Chain records of (chain_id, seq, event): chains run side by side, each streams through one task in order."""
    rows = events.select("chain_id", F.col("seq").cast("long").alias("seq"), "event")
    return rows.repartition("chain_id").sortWithinPartitions("chain_id", "seq").mapInArrow(_fold(genesis), SEALED)


def _hex(c: str, digits: int = 64) -> Column:
    return F.coalesce(F.col(c).rlike(f"^[0-9a-f]{{{digits}}}$"), F.lit(False))


def well_formed() -> Column:
    """Seq from 1, two hashes, and an event that is an object."""
    return F.coalesce((F.col("seq") >= 1) & _hex("prev_hash") & _hex("hash") & F.schema_of_variant(F.try_parse_json("event")).startswith("OBJECT"), F.lit(False))


def malformed(records: DataFrame) -> DataFrame:
    return records.where(~well_formed()).select("chain_id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.lit("malformed_record").alias("problem"))


def content_problems(records: DataFrame) -> DataFrame:
    """Records whose hash is not that of their own previous hash and event; each row by itself."""
    return records.where(record_hash(F.col("prev_hash"), canonical(F.col("event"))) != F.col("hash")).select("chain_id", "seq", F.lit("hash_mismatch").alias("problem"))


def link_problems(records: DataFrame, order: str = "position", base: str = GENESIS_HASH, parts: int | None = None, frontier: DataFrame | None = None) -> DataFrame:
    """Anchors, order, gaps and links in read order.

    ``parts`` splits the records into so many ranges, for chains that are too large for one task each. With ``frontier`` (chain_id,
    seq, hash), the records of a chain follow that one instead of its start.
    """
    columns = records.select("chain_id", "seq", "prev_hash", "hash", *{order} - {"chain_id", "seq", "prev_hash", "hash"})
    if parts is None:
        w = Window.partitionBy("chain_id").orderBy(order)
        r = columns.withColumn("before", F.lag(F.struct("seq", "hash")).over(w))
    else:
        r = with_previous(columns, "chain_id", order, ["seq", "hash"], parts, "before")
    if frontier is not None:
        known = frontier.select("chain_id", F.struct("seq", "hash").alias("reached"))
        r = r.join(known, "chain_id", "left").withColumn("before", F.coalesce("before", "reached"))
    s, h = F.col("before.seq"), F.col("before.hash")
    tests = {
        "bad_genesis": F.col("before").isNull() & (F.col("prev_hash") != base),
        "duplicate_seq": F.col("seq") <= s,
        "seq_gap": F.col("seq") - s > 1,
        "prev_hash_mismatch": F.col("prev_hash") != h,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return r.select("chain_id", "seq", F.explode(found).alias("problem"))


def verify(records: DataFrame, order: str = "position", parts: int | None = None) -> DataFrame:
    """Problems of all records; malformed ones take no part in the other checks."""
    good = records.where(well_formed())
    return malformed(records).unionByName(content_problems(good)).unionByName(link_problems(good, order, parts=parts))


#: Where a check has come to: a chain's last record, and the last one up to which it is sound (null before the first).
REACHED = "chain_id string, seq long, hash string, sound_seq long, broken boolean"


def lay_out(records: DataFrame, path: str, batch: int) -> None:
    """Append chain records to a log of batches, one folder each; running a batch again overwrites it."""
    records.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def laid_out(spark, path: str, after: int | None = None) -> DataFrame:
    """The records of a log of batches, or of those that follow a batch: earlier folders aren't read."""
    records = spark.read.parquet(path)
    return records if after is None else records.where(F.col("batch") > after)


def self_check(records: DataFrame, reached: DataFrame, order: str = "seq", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(problems, new state) of the records that came since a check reached ``reached`` (see ``REACHED``; empty at first).

    The first new record of a chain is held against the last one that was seen, so that the problems of all checks together are those
    of one check of all records. A chain's sound_seq goes on to its last record, or to the one before its first problem, and
    stays there. Rows come in read order by ``order``, later batches behind earlier ones.
    """
    good = written(records.where(well_formed()), "checked")
    problems = written(malformed(records).unionByName(content_problems(good)).unionByName(link_problems(good, order, parts=parts, frontier=reached)), "problems")
    first = problems.groupBy("chain_id").agg(F.min("seq").alias("bad"))
    ends = good.groupBy("chain_id").agg(F.max_by(F.struct("seq", "hash"), order).alias("last"))
    before = good.join(first, "chain_id").where("seq < bad").groupBy("chain_id").agg(F.max("seq").alias("fine"))
    all_ = reached.select("chain_id", F.struct("seq", "hash").alias("old"), "sound_seq", "broken").join(ends, "chain_id", "full").join(first, "chain_id", "full").join(before, "chain_id", "left")
    broke = F.coalesce("broken", F.lit(False))
    sound = F.when(broke, F.col("sound_seq")).when(F.col("bad").isNull(), F.coalesce("last.seq", "sound_seq")).otherwise(F.greatest("sound_seq", "fine"))
    last = F.coalesce("last", "old")
    return problems, written(all_.select("chain_id", last["seq"].alias("seq"), last["hash"].alias("hash"), sound.alias("sound_seq"), (broke | F.col("bad").isNotNull()).alias("broken")), "reached")


#: Problems that alone don't break a chain.
WARNINGS = ("unsigned_tail",)


def verdicts(records: DataFrame, problems: DataFrame) -> DataFrame:
    """Each chain's verdict, well-formed records and head. A problem with a true ``warning`` doesn't count against the chain."""
    if "warning" not in problems.columns:
        problems = problems.withColumn("warning", F.col("problem").isin(*WARNINGS))
    per = problems.groupBy("chain_id").agg(F.count("*").alias("problems"), F.min(F.coalesce("warning", F.lit(False))).alias("mild"))
    good = F.when(well_formed(), F.lit(1))
    heads = records.groupBy("chain_id").agg(F.count(good).alias("checked"), F.max(F.when(well_formed(), F.col("seq"))).alias("head_seq"), F.max_by(F.when(well_formed(), F.col("hash")), F.when(well_formed(), F.col("seq"))).alias("head_hash"))
    return heads.join(per, "chain_id", "left").select("chain_id", "checked", "head_seq", "head_hash", F.coalesce("problems", F.lit(0)).alias("problems"), F.coalesce("mild", F.lit(True)).alias("ok"))


def signature_shape(expected_key: str | None = None) -> Column:
    """What is wrong with a signature's shape or key, or null."""
    shape = F.when(~F.coalesce(F.col("seq") >= 1, F.lit(False)), "invalid seq").when(~_hex("chain_hash"), "invalid chain_hash")
    shape = shape.when(~F.coalesce(F.col("algo") == "ed25519", F.lit(False)), "unsupported algo").when(~_hex("public_key"), "invalid public_key").when(~_hex("signature", 128), "invalid signature hex")
    return shape if expected_key is None else shape.when(F.col("public_key") != expected_key.lower(), "unexpected key")


def signature_problems(signatures: DataFrame, records: DataFrame) -> DataFrame:
    """Genuine signatures past their chain's end, over a seq that the chain lacks, or over another hash than its records give."""
    heads = records.groupBy("chain_id").agg(F.max("seq").alias("head"))
    given = records.select("chain_id", "seq", record_hash(F.col("prev_hash"), canonical(F.col("event"))).alias("recomputed"))
    named = signatures.join(heads, "chain_id", "left").join(given, ["chain_id", "seq"], "left")
    problem = F.when(F.col("seq") > F.coalesce("head", F.lit(0)), "truncated_after_signature").when(F.col("recomputed").isNull() | (F.col("chain_hash") != F.col("recomputed")), "signature_chain_mismatch")
    return named.select("chain_id", "seq", problem.alias("problem")).where("problem is not null")


def signature_verdicts(signatures: DataFrame, records: DataFrame, head_prefix: str, expected_key: str | None = None, allow_unsigned: bool = False) -> DataFrame:
    """(chain_id, seq, problem, warning) of signatures and of what they leave unsigned.

    signatures: chain_id, seq, chain_hash, algo, public_key, signature (over ``head_prefix``, seq and chain_hash, by lines).
    records: well-formed ones, chain_id, seq, prev_hash, hash, event. A chain's tail is what follows its newest valid signature;
    it is not looked at where a genuine signature shows a cut or rewritten chain.
    """
    shaped = signatures.withColumn("fault", signature_shape(expected_key))
    message = F.concat(F.lit(head_prefix + "\n"), F.col("seq").cast("string"), F.lit("\n"), "chain_hash")
    tested = shaped.withColumn("genuine", F.when(F.col("fault").isNull(), verified(message, F.col("public_key"), F.col("signature"))).otherwise(False))
    invalid = tested.where("not genuine").select("chain_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.lit("signature_invalid").alias("problem"))
    genuine = tested.where("genuine").select("chain_id", "seq", "chain_hash")
    against = signature_problems(genuine, records)
    valid = genuine.join(against.select("chain_id", "seq").distinct(), ["chain_id", "seq"], "left_anti").groupBy("chain_id").agg(F.max("seq").alias("newest"))
    end = F.get_json_object("event", "$.kind") == "session_end"
    heads = records.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max(F.when(end, F.col("seq"))).alias("last_end"))
    tail = heads.join(against.select("chain_id").distinct(), "chain_id", "left_anti").join(valid, "chain_id", "left")
    ended = F.coalesce(F.col("last_end") > F.coalesce("newest", F.lit(0)), F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("newest").isNull(), "no_valid_signature"),
        F.when(ended, "unsigned_session_end"),
        F.when(F.col("newest").isNotNull() & (F.col("newest") < F.col("seq")) & ~ended, "unsigned_tail"),
    ))
    left = tail.select("chain_id", "seq", F.explode(found).alias("problem"))
    mild = F.col("problem").isin(*WARNINGS) | (F.col("problem").isin("no_valid_signature", "unsigned_session_end") & F.lit(allow_unsigned))
    return invalid.unionByName(against).unionByName(left).withColumn("warning", mild)


def _genuine(message: str | None, key: str | None, signature: str | None) -> bool:
    try:
        return None not in (message, key, signature) and ed25519.verify(message.encode(), bytes.fromhex(key), bytes.fromhex(signature))
    except ValueError:  # no hexadecimal digits
        return False


def verified(message: Column, public_key: Column, signature: Column) -> Column:
    """Whether hexadecimal ed25519 signatures (RFC 8032) are those of the keys over the messages; what is malformed or null isn't."""

    @F.arrow_udf("boolean")
    def check(messages: pa.Array, keys: pa.Array, signatures: pa.Array) -> pa.Array:
        return pa.array([_genuine(*r) for r in zip(messages.to_pylist(), keys.to_pylist(), signatures.to_pylist())], pa.bool_())

    return check(message, public_key, signature)


def window_pick(signatures: DataFrame, size: int = 2000, most: int = 4, base: int = 0) -> DataFrame:
    """The newest signed seq of each fixed window of seqs, at most ``most`` signatures of it."""
    s = signatures.withColumn("window", F.floor((F.col("seq") - base - 1) / size))
    w = Window.partitionBy("chain_id", "window").orderBy(F.desc("seq"))
    return s.withColumn("r", F.rank().over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("seq"), F.desc("sig_id")))).where(f"r = 1 and n <= {most}").drop("r", "n")


def append_guard(batch: DataFrame, heads: DataFrame) -> DataFrame:
    """Chains whose batch does not extend the head: an empty result admits the whole batch."""
    first = batch.groupBy("chain_id").agg(F.min("seq").alias("from_seq"), F.min_by("prev_hash", "seq").alias("prev_hash"), F.count("*").alias("n"), F.max("seq").alias("to_seq"))
    named = first.join(heads.select("chain_id", F.col("seq").alias("head"), "hash"), "chain_id", "left")
    bad = (F.col("from_seq") != F.coalesce("head", F.lit(0)) + 1) | (F.col("prev_hash") != F.coalesce("hash", F.lit(GENESIS_HASH))) | (F.col("to_seq") - F.col("from_seq") + 1 != F.col("n"))
    return named.where(bad)


def collisions(events: DataFrame, key: str, content: str) -> DataFrame:
    """Ids with one content (seen again: skip) and with several (collision)."""
    return events.groupBy(key).agg(F.count("*").alias("seen"), F.count_distinct(content).alias("contents")).where("seen > 1").withColumn("verdict", F.when(F.col("contents") > 1, "collision").otherwise("skip"))


def bundle_range(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Manifest rows: a session's least to greatest seq in its chain, and all records in between."""
    own = records.join(sessions.select("session_id").distinct(), "session_id", "left_semi").groupBy("chain_id", "session_id").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"))
    w = Window.partitionBy("chain_id").orderBy("seq")
    placed = records.select("chain_id", "seq", "prev_hash", "hash", F.row_number().over(w).alias("place"))
    first = placed.select("chain_id", F.col("seq").alias("from_seq"), F.col("prev_hash").alias("base_hash"), F.col("place").alias("lo"))
    last = placed.select("chain_id", F.col("seq").alias("to_seq"), F.col("hash").alias("head_hash"), F.col("place").alias("hi"))
    ends = own.join(first, ["chain_id", "from_seq"]).join(last, ["chain_id", "to_seq"])
    return ends.select("chain_id", "session_id", "from_seq", "to_seq", (F.col("hi") - F.col("lo") + 1).cast("long").alias("event_count"), "base_hash", "head_hash")


#: The checks of a bundle's manifest, in the order in which its verdict names them.
MANIFEST_CHECKS = ("event_count", "from_seq", "to_seq", "head_hash", "signature_seq", "signature_hash", "public_key", "public_key_pem")


def manifest_problems(manifests: DataFrame, records: DataFrame) -> DataFrame:
    """(bundle_id, check_order, check) for each claim of a manifest that its records, signature or key file don't bear out.

    manifests: bundle_id, event_count, from_seq, to_seq, head_hash, signature_seq, signature_hash, public_key, pem_key,
    public_key_pem, pem_file; records: bundle_id, seq, hash. A bundle without records fails by its count alone.
    """
    per = records.groupBy("bundle_id").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.max_by("hash", "seq").alias("head"))
    m = manifests.join(per, "bundle_id", "left")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    some = F.col("n").isNotNull()
    tests = (
        F.coalesce("n", F.lit(0)) != F.col("event_count"),
        some & differ("lo", "from_seq"),
        some & differ("hi", "to_seq"),
        some & differ("head", "head_hash"),
        differ("signature_seq", "to_seq"),
        differ("signature_hash", "head_hash"),
        ~F.lower("public_key").eqNullSafe(F.lower("pem_key")),
        differ("public_key_pem", "pem_file"),
    )
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(i).alias("check_order"), F.lit(c).alias("check"))) for i, (c, t) in enumerate(zip(MANIFEST_CHECKS, tests))]))
    return m.select("bundle_id", F.explode(found).alias("p")).select("bundle_id", "p.*")


def bundle_verdicts(manifests: DataFrame, problems: DataFrame) -> DataFrame:
    """Each bundle's verdict: the first failed check by check_order, or none."""
    first = problems.groupBy("bundle_id").agg(F.min_by("check", "check_order").alias("failed"))
    return manifests.select("bundle_id").join(first, "bundle_id", "left").select("bundle_id", F.col("failed").isNull().alias("ok"), "failed")
