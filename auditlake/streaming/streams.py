"""The same computations over streams; available-now runs finish with the batch result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import integrity, replica


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet file or folder at path."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{{{name}}}*")


def dedupe(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each id once, as long as copies come within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is available, batch by batch."""
    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _other_batches(spark: SparkSession, path: str, number: int, schema: StructType) -> DataFrame:
    """What other batches than this one have committed."""
    try:
        stored = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return stored.where(F.col("batch") != number).drop("batch")


def commit_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps each key once, in one batch or several, whatever is replayed: a batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        stored = _other_batches(batch.sparkSession, path, number, batch.schema).select(*[F.col(k).alias(f"stored_{k}") for k in keys])
        known = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"stored_{k}")) for k in keys])
        batch.dropDuplicates(keys).join(stored, known, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def commit_chains(path: str, refused: str) -> Callable[[DataFrame, int], None]:
    """A batch writer of chain records (chain_id, seq, prev_hash, hash) that admits a chain's new suffix or nothing of it.

    Records that are stored already must be the same, else the chain has forked and stays refused from then on. The suffix must
    start right after the stored head, be without gaps, and link to the head (the first record to genesis) and within itself.
    Refusals go to ``refused`` as (chain_id, reason).
    """
    reasons = StructType([StructField("chain_id", StringType()), StructField("reason", StringType())])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        offered = batch.dropDuplicates(["chain_id", "seq", "prev_hash", "hash"]).persist()
        stored = _other_batches(spark, path, number, batch.schema)
        earlier = _other_batches(spark, refused, number, reasons).where("reason = 'fork'").select("chain_id", F.lit(0).alias("order"), F.lit("fork").alias("reason"))
        twice = offered.groupBy("chain_id", "seq").count().where("count > 1")
        suffix = replica.new_records(stored, offered)
        heads = stored.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
        guarded = integrity.append_guard(suffix, heads)
        gap = (F.col("from_seq") != F.coalesce("head", F.lit(0)) + 1) | (F.col("to_seq") - F.col("from_seq") + 1 != F.col("n"))
        links = integrity.link_problems(suffix, order="seq").where("problem = 'prev_hash_mismatch'")
        named = lambda df, order, reason: df.select("chain_id", F.lit(order).alias("order"), F.lit(reason).alias("reason"))
        anchor = F.when(gap, F.lit("gap")).when(F.col("head").isNull(), F.lit("bad_genesis")).otherwise(F.lit("fork"))
        problems = [earlier, named(replica.forks(stored, offered), 0, "fork"), named(twice, 0, "fork"), guarded.select("chain_id", F.lit(1).alias("order"), anchor.alias("reason")), named(links, 2, "bad_link")]
        bad = reduce(DataFrame.unionByName, problems).join(offered.select("chain_id").distinct(), "chain_id", "left_semi")
        bad = bad.groupBy("chain_id").agg(F.min_by("reason", "order").alias("reason")).persist()
        bad.write.mode("overwrite").parquet(f"{refused}/batch={number}")
        suffix.join(bad, "chain_id", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        bad.unpersist()
        offered.unpersist()

    return write


def session_counts(events: DataFrame) -> DataFrame:
    """Running session activity in update or complete mode."""
    return events.groupBy("session_id").agg(F.count("*").alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("last_event_at"), F.count_if(F.col("decision").isNotNull()).alias("decisions"))
