"""The corpus pipeline: toxicity, near-duplicates, personal data, source mixing and packing, one table after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm import mixing, near_dedup, packing, pii, queries, toxicity
from auditlake.llm.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < queries.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least doc_id. Rows without a doc_id stay; of rows that share one, that with the greatest text."""
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = named.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), F.struct("text")).alias("r")).select("doc_id", "r.*")
    out = named.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced; n_chars follows."""
    found = pii.find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("id"), "text_key", "spans").dropDuplicates(["id", "text_key"])
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_key"))
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.sanitise(F.col("text"), F.coalesce("spans", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)"))))
    out = docs.join(found, same, "left").withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that share doc_id, source and size are told apart by their occurrence."""
    copies = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("size").alias("n"), F.col("nth").alias("k"), "copies")
    key = ["doc_id", "source", "size"]
    sized = mixing.sizes(docs)
    repeated = sized.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    if repeated.limit(1).count():
        sized = sized.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"), "text")))
    else:
        sized = sized.withColumn("nth", F.lit(1))
    out = sized.join(copies, same("doc_id", "id") & same("source", "s") & (F.col("size") == F.col("n")) & (F.col("nth") == F.col("k")))
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and random rounding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
