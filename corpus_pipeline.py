"""Training-corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfeed.llm import decontaminate, packing, quality, simhash, suffixes
from wayfeed.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on their labels outside the held-out fold, does not reject.

    Columns of the documents that are named like the classifier's own stay as they are.
    """
    weights = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    aside = {c: f"__own_{c}" for c in docs.columns if c in ("score", "predicted")}
    kept = quality.score(docs.withColumnsRenamed(aside), weights).filter("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({held: c for c, held in aside.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id and then text hash; rows without an id stay.

    Near copies have five-word shingles of a Jaccard similarity of 0.8 or more.  Different texts under one id are
    judged each; of rows with the same id and text one stays.
    """
    rows = simhash.near_rows(docs)
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("row")).select(F.col("row.doc_id").alias("own_id"), F.col("row.h").alias("own_h"))
    kept = docs.join(first, (docs["doc_id"] == first["own_id"]) & (F.xxhash64(docs["text"]) == first["own_h"]), "left_semi")
    if rows.groupBy("doc_id", "h").count().filter("count > 1").limit(1).count():
        row = F.struct(*docs.columns)
        kept = kept.groupBy("doc_id", F.xxhash64("text").alias("own_h")).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return kept.select(*docs.columns).union(docs.filter("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also start earlier; a text of which nothing but white space is left goes.

    A character cut in two by a removal goes with it.  ``n_chars``, where there is one, counts the new text.
    """
    cut = suffixes.without_repeats(docs)
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")
    done = cut.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(left))
    done = done.filter((F.col("n_removed") == 0) | (F.length(F.trim(F.translate("text", "\t\n\r\x0b\x0c", "     "))) > 0))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
        done = done.withColumn("n_chars", changed)
    return done.select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # none of the stages can be said in SQL; tests/llm hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs, "pipeline") if k < len(STAGES) - 1 else docs
    return docs
