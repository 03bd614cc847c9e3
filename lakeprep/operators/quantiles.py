"""Exact linear-interpolated quantiles from one sketch and one verifying pass.

Spark's built-in ``percentile`` merges a value->count map of the whole column in one task. Here the caller's own
aggregate carries a mergeable sketch of each column (``sketched``): for every probability it gives an interval
of values that holds the wanted ranks, wider than the sketch's rank error. One more pass over the data puts
every value of every column into a region, between the intervals or inside one, and counts: values inside by
themselves, all others per region. The counts prove the ranks of the intervals; the values inside are read off.

The counting is one aggregate with a map-side part, so a value that holds a third of the rows is one row per
task. The counted values, a few thousandths of the rows, are written out, so the input is read once for them. If
more than ``FEW`` distinct values of all columns together lie inside, they are narrowed there by cutting each
interval into ``PARTS`` until they are few. A rank outside its interval (a sketch beyond its bound) is looked for
between the intervals in the same way.

Ranks follow the usual "linear" definition (pandas ``quantile``, DuckDB ``quantile_cont``): position
``h = (n - 1) * p`` on the sorted values, and ``v[floor(h)] + (h - floor(h)) * (v[ceil(h)] - v[floor(h)])``.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import scratch_path
from ..small import text_table

# Accuracy of the sketch (its rank error is one part in this many), how many such parts an interval reaches to
# each side, the columns' rows below which an interval is the whole column, the distinct values the driver
# takes for all columns together, and the parts an interval is cut into while there are more.
ACCURACY, SLACK, SMALL, FEW, PARTS = 10_000, 4, 5_000, 20_000, 32


def linear_ranks(n: int, probs: Sequence[float]) -> dict[float, tuple[int, int, float]]:
    """0-based (floor, ceil, fraction) positions of each probability among ``n`` values."""
    out = {}
    for p in probs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability {p} outside [0, 1]")
        h = (n - 1) * p
        lo = math.floor(h)
        out[p] = (lo, math.ceil(h), h - lo)
    return out


@dataclass
class Sketched:
    """What the caller's aggregate said of a column: rows, ends, and an interval per probability."""
    count: int
    least: object = None
    most: object = None
    intervals: list[tuple] = field(default_factory=list)


def sketched(v: Column, name: str, probs: Sequence[float]) -> list[Column]:
    """Aggregates that :func:`read_sketch` understands."""
    cuts = [min(1.0, max(0.0, p + side * SLACK / ACCURACY)) for p in probs for side in (-1, 1)]
    return [F.count(v).alias(f"n_{name}"), F.min(v).alias(f"lo_{name}"), F.max(v).alias(f"hi_{name}"),
            F.percentile_approx(v, cuts, ACCURACY).alias(f"q_{name}")]


def read_sketch(row: Row, name: str) -> Sketched:
    n, least, most, cuts = (row[f"{k}_{name}"] for k in ("n", "lo", "hi", "q"))
    if n <= SMALL:
        return Sketched(n, least, most, [(least, most)] if n else [])
    return Sketched(n, least, most, list(zip(cuts[::2], cuts[1::2])))


def _joined(intervals: Sequence[tuple]) -> list[tuple]:
    """Sorted intervals without overlap."""
    out: list[tuple] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _region(v: Column, bounds: Sequence[tuple[Column, Column]]) -> Column:
    """2k below interval k and above the one before, 2k + 1 inside it; intervals that a column lacks have null bounds."""
    out = F.lit(2 * len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        lo, hi = bounds[k]
        out = F.when(lo.isNull(), 2 * k).when(v < lo, 2 * k).when(v <= hi, 2 * k + 1).otherwise(out)
    return out


def _counted(df: DataFrame, values: Sequence[Column], intervals: dict[int, list[tuple]]) -> DataFrame:
    """``(c, r, v, w)``: rows by column and region, those inside an interval by value too.

    The columns become rows before they are compared and the bounds come from a small broadcast table, so one
    short expression serves all columns: written out column by column it outgrows what the JVM compiles.
    """
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), values[c].alias("v")) for c in intervals]))).where(F.col("v").isNotNull())
    most, kind = max(map(len, intervals.values())), each.schema["v"].dataType.simpleString()
    names = [name for k in range(most) for name in (f"lo{k}", f"hi{k}")]
    table = [(c, *[x for pair in own for x in pair], *[None] * (2 * (most - len(own)))) for c, own in intervals.items()]
    bounds = text_table(df.sparkSession, table, ", ".join(["c int", *[f"{name} {kind}" for name in names]]))
    region = _region(F.col("v"), [(F.col(f"lo{k}"), F.col(f"hi{k}")) for k in range(most)])
    placed = each.join(F.broadcast(bounds), "c").select("c", region.alias("r"), "v")
    return placed.groupBy("c", "r", F.when(F.col("r") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("w"))


def _narrowed(spark, table: DataFrame, below: dict[tuple[int, int], int],
              wanted: dict[tuple[int, int], list[int]]) -> dict[int, list[tuple]]:
    """The counted values around the wanted ranks of each ``(c, r)``, few enough for the driver.

    Each round cuts every interval that is left into parts with about as many distinct values and keeps the
    parts that hold a wanted rank. Parts get a number ``r`` of their own; ``below`` counts the rows before it.
    Returns rows ``(first rank, v, w)`` by column.
    """
    most = max(FEW, sum(map(len, wanted.values())))                  # one value a rank is as few as they get
    while True:
        now = table.where(F.col("v").isNotNull())
        rows = now.select("c", "r", "v", "w").limit(most + 1).collect()
        if len(rows) <= most:
            break
        cuts = now.groupBy("c", "r").agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 100 * PARTS).alias("cuts")).collect()
        names = text_table(spark, [(c["c"], c["r"], k, v) for c in cuts for k, v in enumerate(sorted(set(c["cuts"])))],
                            f"c int, r int, k int, cut {now.schema['v'].dataType.simpleString()}")
        names = names.groupBy("c", "r").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
        # 2j values below cut j, 2j + 1 those equal to it: a part always has fewer distinct values
        cut_of = F.size(F.filter("cuts", lambda x: x < F.col("v"))) * 2 + F.array_contains("cuts", F.col("v")).cast("int")
        parted = now.join(F.broadcast(names), ["c", "r"]).withColumn("part", cut_of)
        weights: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for x in parted.groupBy("c", "r", "part").agg(F.sum("w").alias("w")).collect():
            weights.setdefault((x["c"], x["r"]), []).append((x["part"], x["w"]))
        keep, new_below, new_wanted = [], {}, {}
        for (c, r), parts in weights.items():
            at = below[c, r]
            for part, w in sorted(parts):
                mine = [rank for rank in wanted[c, r] if at <= rank < at + w]
                if mine:
                    number = len(keep)
                    keep.append((c, r, part, number))
                    new_below[c, number], new_wanted[c, number] = at, mine
                at += w
        kept = text_table(spark, keep, "c int, r int, part int, number int")
        path = scratch_path(spark, "quantiles")
        (parted.join(F.broadcast(kept), ["c", "r", "part"]).select("c", F.col("number").alias("r"), "v", "w")
         .write.parquet(path))
        table, below, wanted = spark.read.parquet(path), new_below, new_wanted
    out: dict[int, list[tuple]] = {}
    groups: dict[tuple[int, int], list[tuple]] = {}
    for x in rows:
        groups.setdefault((x["c"], x["r"]), []).append((x["v"], x["w"]))
    for (c, r), values in groups.items():
        at = below[c, r]
        for v, w in sorted(values):
            out.setdefault(c, []).append((at, v, w))
            at += w
    return out


def values_at_ranks(df: DataFrame, values: Sequence[Column], ranks: Sequence[Sequence[int]],
                    sketches: Sequence[Sketched]) -> list[dict[int, object]]:
    """For each column expression, the values at its 0-based ranks (nulls excluded)."""
    spark, out = df.sparkSession, [{} for _ in values]
    todo = {c: sorted(set(own)) for c, own in enumerate(ranks) if own}
    intervals = {c: _joined(sketches[c].intervals) for c in todo}
    while todo:
        path = scratch_path(spark, "quantiles")
        _counted(df, values, intervals).write.parquet(path)            # once: a look at some rows would count them all
        counted = spark.read.parquet(path)
        rows = counted.limit(FEW + 1).collect()
        few = len(rows) <= FEW
        if not few:
            rows = counted.groupBy("c", "r").agg(F.sum("w").alias("w")).collect()     # a few regions a column
        weight: dict[tuple[int, int], int] = {}
        for x in rows:
            weight[x["c"], x["r"]] = weight.get((x["c"], x["r"]), 0) + x["w"]
        below, wanted, again = {}, {}, {}
        for c, own in todo.items():
            at = 0
            for r in range(2 * len(intervals[c]) + 1):
                mine = [rank for rank in own if at <= rank < at + weight.get((c, r), 0)]
                below[c, r] = at
                if mine and r % 2:
                    wanted[c, r] = mine
                elif mine:                                          # not where the sketch said: between its intervals
                    before, after = intervals[c][r // 2 - 1:r // 2], intervals[c][r // 2:r // 2 + 1]
                    again.setdefault(c, []).append((mine, (before[0][1] if before else sketches[c].least, after[0][0] if after else sketches[c].most)))
                at += weight.get((c, r), 0)
        if few:
            inside: dict[int, list[tuple]] = {}
            starts = dict(below)
            for x in sorted((x for x in rows if x["v"] is not None), key=lambda x: (x["c"], x["r"], x["v"])):
                inside.setdefault(x["c"], []).append((starts[x["c"], x["r"]], x["v"], x["w"]))
                starts[x["c"], x["r"]] += x["w"]
        else:
            inside = _narrowed(spark, counted, below, wanted)
        for (c, _), mine in wanted.items():
            found = sorted(inside[c], key=lambda x: x[0])
            firsts = [x[0] for x in found]
            for rank in mine:
                out[c][rank] = found[bisect_right(firsts, rank) - 1][1]
        todo = {c: [rank for mine, _ in missed for rank in mine] for c, missed in again.items()}
        intervals = {c: _joined([place for _, place in missed]) for c, missed in again.items()}
    return out


def exact_quantiles(df: DataFrame, values: Sequence[Column], counts: Sequence[int], probs: Sequence[float],
                    sketches: Sequence[Sketched] | None = None) -> list[dict[float, float | None]]:
    """Linear-interpolated quantiles of numeric ``values`` (``counts`` = non-null rows each).

    Sketches that the caller has taken for the same probabilities save a pass.
    """
    if sketches is None:
        if not values:
            return []
        row = df.agg(*[a for i, v in enumerate(values) for a in sketched(v, str(i), probs)]).first()
        sketches = [read_sketch(row, str(i)) for i in range(len(values))]
    plans = [linear_ranks(n, probs) if n else {} for n in counts]
    got = values_at_ranks(df, values, [[r for lo, hi, _ in pl.values() for r in (lo, hi)] for pl in plans], sketches)
    out = []
    for pl, g, n in zip(plans, got, counts):
        if not n:
            out.append({p: None for p in probs})
            continue
        res = {}
        for p, (lo, hi, frac) in pl.items():
            a, b = float(g[lo]), float(g[hi])
            res[p] = a if frac == 0 or a == b else a + frac * (b - a)
        out.append(res)
    return out
