"""Which rows can have a copy at all: 128-bit fingerprints first, whole rows only where these meet.

Finding repeated rows by grouping them moves every distinct row through a shuffle, however wide it is. Here the
first pass groups fingerprints, 16 bytes a row; those that occur more than once mark a bit of a map of a fixed
size (``BITS``), which the second pass gets as one value. Rows without a mark have no copy and go nowhere; the
others are compared whole, by the caller's own grouping, so equal fingerprints of different rows and shared
bits cost work and change no result. On data that repeat everywhere all rows are marked, and the grouping's
map-side combine keeps them small.

Both passes must see the same rows: use it on stored data or on deterministic steps over them, not on a
``limit`` without an order or on random samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22


def fingerprint(values: Sequence[Column]) -> list[Column]:
    """Two 64-bit hashes of a row's values; nulls count by their place."""
    nulls = F.concat_ws("", *[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return [F.xxhash64(nulls, *values), F.xxhash64(F.lit(1), *reversed(values), nulls)]


def _place(first: Column) -> Column:
    return F.pmod(first, F.lit(BITS))


def repeats(df: DataFrame, values: Sequence[Column], **sums: Column) -> DataFrame:
    """One row: ``bits`` (the map of fingerprints that occur more than once), ``rows``, ``single`` (rows whose
    fingerprint occurs once) and the sums asked for."""
    first, second = fingerprint(values)
    prints = (df.select(first.alias("f1"), second.alias("f2"), *[v.alias(f"s_{n}") for n, v in sums.items()])
              .groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("k"), *[F.sum(f"s_{n}").alias(f"s_{n}") for n in sums]))
    place = _place(F.col("f1"))
    marks = prints.select((place / 64).cast("int").alias("word"),
                          F.when(F.col("k") > 1, F.expr("shiftleft(1L, cast(pmod(f1, 64) as int))")).otherwise(F.lit(0)).cast("long").alias("bit"),
                          "k", *[f"s_{n}" for n in sums])
    every = df.sparkSession.range(0, BITS // 64, 1, 1).select(
        F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"), F.lit(0).cast("long").alias("k"),
        *[F.lit(0).cast(marks.schema[f"s_{n}"].dataType).alias(f"s_{n}") for n in sums])
    words = marks.unionByName(every).groupBy("word").agg(
        F.bit_or("bit").alias("bits"), F.sum("k").alias("rows"), F.sum((F.col("k") == 1).cast("long")).alias("single"),
        *[F.sum(f"s_{n}").alias(n) for n in sums])
    map_of_bits = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
    return words.agg(map_of_bits.alias("bits"), F.sum("rows").alias("rows"), F.sum("single").alias("single"),
                     *[F.sum(n).alias(n) for n in sums])


def marked(values: Sequence[Column], found: DataFrame) -> Column:
    """True for rows whose fingerprint may occur more than once, by the one row of :func:`repeats`."""
    place = _place(fingerprint(values)[0])
    word = F.get(found.select("bits").scalar(), (place / 64).cast("int"))
    return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1
