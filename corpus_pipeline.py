"""A corpus made ready for training: five stages over ``documents``, each on what the last one kept.

1. ``quality`` drops documents that the classifier and their site speak against.
2. ``near_duplicates`` keeps the document with the smallest id of every group of copies, one row of it.
3. ``decontamination`` drops documents that hold ten words in a row of a benchmark item.
4. ``secrets`` replaces secrets in texts by a mark; ``n_chars`` follows.
5. ``pieces`` adds the ids of a SentencePiece model.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm import decontam, minhash, pieces, quality, secrets
from epispark.llm.store import shared_folder
from epispark.llm.workload import PIECE_MODEL, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site don't speak against. Null and empty texts are
    judged by their site, repeated rows each; an empty table stays empty."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"), "source", "lang")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, similarity 0.8. One row of each group stays, repeated ones and copies included;
    rows without words are in no group and all stay."""
    return minhash.first_of_groups(docs, shingle=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without ten words in a row of a benchmark item, or a whole shorter item. Exact matches decide, so
    only those are looked for. Rows of one id are told apart by their text; null and empty texts stay."""
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), near=10).filter("contaminated")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    leaks = found.select("doc_id", "text_hash").distinct()
    same = rows["doc_id"].eqNullSafe(leaks["doc_id"]) & (rows["text_hash"] == leaks["text_hash"])
    return rows.join(leaks, same, "left_anti").select("row.*")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, secrets in its text replaced by a mark and ``n_chars`` counted anew; null texts stay null."""
    redacted = secrets.redact_secrets(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text in place of it; null texts have null ids, empty ones none."""
    return pieces.encode_texts(docs.select("doc_id", "text", "lang", "source"), PIECE_MODEL).drop("text")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("pieces", piece_stage),
]

#: SQL can express neither the fitted classifier nor the ids; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
