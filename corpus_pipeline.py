"""A corpus from raw documents: reject poor texts, keep one of near duplicates, remove secrets, mix sources, pack.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written as Parquet and is the next one's docs.
Rejected are texts that the quality classifier scores below 0.5; of near duplicates (5-word shingles, similarity of 0.8
or more) the least doc_id stays; secrets become a mark; sources are mixed to weights 5, 2, 1 with repeats; the last stage
returns pieces of packed token sequences.

Each stage takes the columns of documents by name, ignores others, gives no rows for an empty table, and takes a null text as
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm import minhash, mixing, packing, quality, secret_scan
from riverbed.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more; rows that repeat score alike, rows without a doc_id are scored as others. With no label
    that belongs to a document every score is 0.5, so all stay."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs.select(*COLUMNS), weights, out="_score").where("_score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a kept doc_id stay; of rows that repeat one, one of each text. Texts without words, and rows without a
    doc_id, are no one's duplicates; of the latter one of each text stays."""
    classes = minhash.near_duplicates(docs)
    kept = classes.where("kept").select(F.col("doc_id").alias("_d")).distinct()
    return docs.select(*COLUMNS).dropDuplicates(["doc_id", "text"]).join(kept, F.col("doc_id").eqNullSafe(F.col("_d"))).select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their secrets marked and n_chars counted anew (null for a null text)."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row 0, 1 or 2 times, in all columns as it was. A null source is a source; where one has no words, none of its
    rows is taken."""
    return mixing.take(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row; an empty text is one piece, its end mark. Rows that repeat give pieces each."""
    return packing.pieces(docs)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("secrets", remove_secrets), ("mix", mix_sources), ("pack", pack)]

#: The classifier, MinHash and the tokenizer aren't expressed in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i + 1 < len(STAGES) else docs
    return docs
