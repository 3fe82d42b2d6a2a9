"""A corpus pipeline of five stages, each over all that the one before kept.

language ID -> near-duplicates -> benchmark decontamination -> secrets -> BPE.
Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm import decontaminate, language, near_dedup, secrets, word_table
from lattica.plans.storage import discard, stored

#: A document whose language has a smaller share of its letters is rejected.
MIN_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that has half of their letters.

    The languages are learned from the rows with an id that are not held out.  Null and empty texts go;
    repeated rows go or stay alike; null ids and further columns do no harm; an empty table, and one
    without a lang anywhere, gives none.
    """
    return language.keep_identified(docs, language.learn(docs.where(~language.held_out() & F.col("doc_id").isNotNull())), MIN_SHARE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of five-word-shingle similarity 0.8 or more: that with the smallest id, null ids last.

    Repeated rows, rows without an id and different texts with one id are rows of their own: of
    ties one stays.  Null and empty texts and those of white space are in no group and stay, each time.
    Further columns come along whatever their names; an empty table gives none.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    # written once, so that a row's key is the same wherever it is read
    tagged = stored(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    groups = near_dedup.near_duplicates(tagged.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = tagged.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    kept = groups.join(ids, "row").groupBy("component_id").agg(first).select(F.col("first.row").alias(key))
    return tagged.join(kept, key, "left_semi").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts stay, repeated rows go or stay alike, null ids and further columns do no harm;
    an empty table gives none, an empty benchmark leaves all rows.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text by a mark; n_chars follows (where the text is null it stays as it is).

    All rows stay, repeated ones alike, with all columns whatever their names; an empty table gives none.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text: a row for each row.

    Null and empty texts have no ids and decode to the empty text; repeated rows come out alike; null ids
    and further columns do no harm; an empty table gives none.
    """
    out = word_table.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), whole=True)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secrets_stage),
    ("BPE", encode_stage),
]

#: SQL can't express the stages; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of the tables between them only the last is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
