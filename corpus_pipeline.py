"""A training-corpus pipeline: quality rules, near-dedup, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import op1_bpe, op2_simhash, op5_pii, op8_mixing, op9_quality_rules
from lodeseek.session import fresh_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tokens to read, as a share of the tokens that reach the mixing stage.
MIX_PERCENT = 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return op9_quality_rules.apply_policy(op9_quality_rules.ledger(docs.select(*COLUMNS))).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: that of the smallest id (a null id last), then of the least hash of its text."""
    return op2_simhash.first_of_groups(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are masked in the texts."""
    out = op5_pii.mask(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch in which a document is read; the document at a leaf's cut is kept whole.

    Rows with an equal id count as one document with all their tokens. Documents without an id have no
    place in the order and are read once.
    """
    docs = docs.select(*COLUMNS)
    own = op8_mixing.leveled(docs.filter("doc_id IS NOT NULL"))
    own = own.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in op8_mixing.LEVELS], F.sum("n_tokens").alias("n_tokens"))
    chosen = op8_mixing.mix(own, budget_percent=MIX_PERCENT)
    times = chosen.select("doc_id", (F.col("epochs") + F.col("read").cast("long")).alias("times"))
    out = docs.join(times, "doc_id")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)
    return out.unionByName(docs.filter("doc_id IS NULL"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    voc, pattern = op1_bpe.vocabulary()
    out = op1_bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), voc, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality_rules", quality), ("simhash_dedup", near_dedup), ("pii", personal_data), ("mixing", mixing), ("bpe", encode)]

#: Fingerprints, the tagger and the merges can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
