"""A training-data pipeline over ``documents``: from raw rows to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written and read again as the next stage's ``docs``. All
stages but the last return the columns of ``docs``, of any number and name, unchanged
but for the text that line dedup cuts and its ``n_chars``. Null texts count as empty: the
classifier scores them, no later stage fails on them. Repeated rows are copies of one
document, of which the join keeps one. No document gives no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, linededup, mixing, nearjoin, quality
from cairn.llm.common import packed, staged, table, unpacked


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all labelled rows of ``docs``, within its sample bound."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = quality.score(docs.select(packed(docs.drop("text")).alias("_row"), "text"), trees, ["_row", "text"])
    return scored.where("predicted = 1").select(*unpacked(docs, "_row", {"text": F.col("text")}))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in their first document only; a document that thereby has no word left goes."""
    kept = linededup.dedup(docs.select(packed(docs.drop("text")).alias("_rest"), "doc_id", "text")).where(r"n_dropped = 0 or text rlike '\\S'")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("_rest").getField("n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*unpacked(docs, "_rest", new))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the lowest doc_id."""
    return nearjoin.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents stay once; toxic and junk ones occur as often as the targets ask."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens."""
    return bpe.encode(docs, keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding", encoding_stage),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), ()
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), *before)
        before = (docs,)
    return docs
