"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``. The first four return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprep.llm import jaccard, packing, pii, quality, toxicity
from lakeprep.llm.common import stage
from lakeprep.llm.queries import PII_KEY, QUALITY_CUT, TOXIC_CUT
from lakeprep.sources.lake import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity cut; null texts score as empty ones."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model) < TOXIC_CUT)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the quality cut."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model) >= QUALITY_CUT)


def one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id (and text hash), once.

    Rows are told apart by id and text: other texts of the id are groups of their own. Rows without an id or
    without words belong to no group and stay.
    """
    found = jaccard.jaccard_components(docs, groups=True)
    own = found.where("group_id is not null")
    kept = own.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.doc_id", "one.text_hash")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    alone = F.col("doc_id").isNull() | ~words
    rows = docs.where(~alone).select("doc_id", jaccard.text_hash().alias("text_hash"), F.struct(*docs.columns).alias("row"))
    chosen = rows.join(kept, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.min("row").alias("row"))
    return chosen.select("row.*").unionByName(docs.where(alone))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` follows the text."""
    return pii.replace_entities(docs, PII_KEY).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(cut).withColumnRenamed("key", "doc_id")


STAGES = [("toxicity", drop_toxic), ("quality classifier", keep_quality), ("n-gram Jaccard join", one_of_a_group),
          ("PII", replace_pii), ("packing", pack)]

#: Trained models, hashes and tokenizers are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
