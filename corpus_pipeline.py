"""A training-data pipeline over ``documents``: quality rules, near copies,
benchmark passages, personal data, tokens.  Each stage reads what the one
before it wrote and works on all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm.bpe import round_trip_digests
from pairloom.llm.common import stored
from pairloom.llm.decontaminate import without_contaminated
from pairloom.llm.jaccard_join import jaccard_join
from pairloom.llm.pii import pseudonymise_rows
from pairloom.llm.quality_rules import keep_good

#: near copies: five-word shingles, similarity 0.8 or more
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go (5)."""
    return keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id
    (8); documents without words have no copies.

    Rows are known by a 64-bit hash of id and text, so ids may repeat or be
    null: a row goes only if its own text is a copy, null ids come after all
    others, and of rows with equal id and text one stays."""
    row = F.xxhash64("doc_id", "text")
    groups = jaccard_join(docs.select(row.alias("doc_id"), "text"), size=NEAR_SHINGLE, percent=NEAR_PERCENT)
    rows = groups.where("n_shingles > 0").groupBy(F.col("doc_id").alias("row_"), "component_id").agg(F.count(F.lit(1)).alias("times"))
    rows = stored(rows.join(docs.select(row.alias("row_"), "doc_id").distinct(), "row_"), "near-rows")
    stays = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_")).alias("first")).select("first.row_")
    gone = rows.join(stays, "row_", "left_anti").select("row_")
    again = rows.where("times > 1").join(stays, "row_", "left_semi").select("row_")
    keyed = docs.withColumn("row_", row)
    kept = keyed.join(gone.union(again), "row_", "left_anti")
    if not again.isEmpty():
        kept = kept.unionByName(keyed.join(again, "row_", "left_semi").dropDuplicates(["row_"]))
    return kept.select(docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go (4)."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return without_contaminated(docs, benchmark)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates (7); n_chars follows."""
    return pseudonymise_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests (3)."""
    import public_tokenizers

    return round_trip_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("bpe", tokens_stage),
]

#: EM, edit distances, keyed surrogates and BPE are beyond SQL: tested against
#: the operators' brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
