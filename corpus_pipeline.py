"""The corpus pipeline: documents of poor quality, near duplicates and benchmark leaks go, personal data
is pseudonymised, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of documents, whatever their names beside doc_id, source, text and n_chars. Null
texts count as empty ones and stay null, texts of any length are taken whole, and an empty table gives
no rows in every stage. What a stage adds for itself has a name that the table doesn't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm import bpe, decontam, neardup, pii, quality
from gridweave.llm.common import fresh, read, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Rows of equal text stay or go together; without labels all stay."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    own = fresh(docs, "quality_score")
    return quality.score(docs, model, out=own).where(F.col(own) >= quality.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id.

    Of rows with the same doc_id and text one stays, the least by its other columns; different texts of a
    doc_id are one document, which stays or goes as a whole. Rows without doc_id all stay.
    """
    own, number = fresh(docs, "kept_id"), fresh(docs, "place")
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(own)).distinct()
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    others = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    once = named.join(kept, F.col("doc_id") == F.col(own), "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
    return once.unionByName(nameless)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; all rows of a doc_id go where one of them has one. Without benchmark all stay."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts, under the session's key; n_chars follows where a text changed."""
    changed = pii.apply(docs, key=pii.session_key(spark))
    length = F.when(F.col("pii_count") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (changed if length is None else changed.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of all documents, row for row; an empty text has no tokens."""
    coded = bpe.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", drop_leaks),
    ("pseudonyms", hide_personal_data),
    ("tokens", encode),
]
#: The classifier is trained and the tokenizer's merges are its own: SQL expresses neither. Tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, through all stages in turn."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
