"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Fold that never trains: ``crc32(doc_id as text) mod 4``.
HELD_OUT_REMAINDER = 2


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows kept out of every training step (a null id hashes as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT_REMAINDER


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (few enough to broadcast, one row an id) with the text of each; of several texts the smallest."""
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy(*ids.columns).agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """``(text, label)`` of a bounded sample of labelled training rows, and the class counts.

    The class counts cover every labelled row outside the held-out fold. The sample takes the
    ``per_class`` ids of each class with the smallest hash, so it does not depend on the file
    order; one row an id, however often it is repeated. Several labels of one id count as their
    maximum; null ids and labels take no part. The broadcast side holds ``sum(per_class)`` ids at most.
    """
    known = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isNotNull())
             .groupBy("id").agg(F.max("y").alias("y"))
             .where(~held_out("id")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = None
    for y, limit in per_class.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(limit)
        picks = part if picks is None else picks.unionByName(part)
    return texts_of(docs, picks).select("text", F.col("y").alias("label")), counts


def smallest_by_hash(df: DataFrame, columns: list, limit: int) -> list:
    """The ``limit`` rows with the smallest hash of ``columns``, for the driver.

    A first filter by the hash leaves about as many as are wanted, so tasks do not each send ``limit`` rows.
    """
    share = min(1.0, (1.2 * limit + 200) / max(1, df.count()))
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << 40))
    few = df.withColumn("__place__", place).where(F.col("__place__") <= int(share * (1 << 40))).collect()
    return sorted(few, key=lambda r: (r["__place__"], str(r)))[:limit]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for what is costly to build.

    Task code travels by value, so its own globals are new in every task.
    """
    return sys.__dict__.setdefault("_lakeprep_worker_cache", {})


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage: later jobs, and tasks run again after an executor is lost, start from the files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
