"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's rows as
Parquet to the shared folder and rereads them. All stages but the last return the columns of ``documents``. Nulls and
repeated rows: language ID rejects documents whose text is null or has no letter, or whose language is a guess; near-dedup
goes by id and text, so rows that share an id (or have none) stay if their texts differ; the other stages follow their
operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlytics.llm import language_id, line_dedup, minhash, packing, pii
from meshlytics.llm.common import discard, free_names, saved

#: Documents whose language's calibrated probability is not this much of the way from chance (one over the number of
#: languages) to certainty are rejected.
LEAST_ABOVE_CHANCE = 0.07


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; learns as the query does, from rows that are not held out."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    chance = 1 / max(len(model.languages), 1)
    named = language_id.identify(docs, model)
    sure = F.col("score") >= chance + LEAST_ABOVE_CHANCE * (1 - chance)
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & sure).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines; ``n_chars`` is that of the text that is left."""
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that of the smallest id: 5-word shingles, similarity 0.8. Of rows that are alike in
    id and text one stays."""
    (row,) = free_names(docs.columns, "_row")
    known = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    groups = minhash.near_duplicates(known.select(row, "text"), key=row).select(
        F.col(row).alias("row"), F.col("component_id").alias("group")
    )
    named = known.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).distinct().join(groups.distinct(), "row")
    least = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("least"))
    kept = saved(least.select(F.col("least.row").alias(row)), "kept")
    return known.join(kept, row, "left_semi").dropDuplicates([row, "doc_id"]).drop(row)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the kind in angle brackets; ``n_chars`` is that of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained model and packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = []
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
        discard(*done)
        done = [docs]
    return docs
