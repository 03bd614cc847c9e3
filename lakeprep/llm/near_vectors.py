"""Embedding near-dedup: sorted projection passes.

Each pass hashes every vector to ``BITS`` signs of random projections, concatenated; the vectors are
ordered by label and hash, and each is compared with its next ``WINDOW`` neighbours in that order. Pairs
whose cosine in double precision reaches the threshold are united across all passes. Unit vectors are hashed
relative to their label's mean, so that a direction all rows of a label share does not fill the windows.

The first passes are as many as a label of evenly spread directions needs (``passes``). What they found is then
measured over all rows: ``PROBES`` rows, half of them linked ones, are compared with every row of their
labels, and passes with new projections are added, doubling, until the share of the probes' links that lie
inside components reaches ``RECALL``, or ``MOST_PASSES`` are done. Rows that crowd in a label (a dense topic)
therefore cost passes, not links. ``measured_recall`` gives the share for any grouping.

Equal vectors of a label are one class before the passes, so a heap of copies costs one row. The passes
decide who belongs together; every pair inside a found component is then compared in blocks of ``BLOCK``
rows, so that a vector's number of links has no cap by the window. Only sums leave the blocks.

The order is cut by rank, not by key: a block of ranks and its first neighbours beyond form one task's
group however many rows share a hash. Only ids and hashes are sorted; vectors join the blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without a label, link with nothing and are kept alone; vectors of different length never link. Repeated
rows of one id count once (the smallest label and vector stand); a null id comes back unlinked, not kept.
Very long vectors work. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .components import components

THRESHOLD, WINDOW, BITS, MISS, ROWS, BLOCK, SEED = 0.93, 64, 62, 0.001, 2048, 1024, 20240229
PROBES, RECALL, MOST_PASSES = 512, 0.998, 4096


def passes(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold in a label of ``largest`` rows is missed with ``miss``."""
    agree = 1 - math.acos(threshold) / math.pi
    found = min(0.95, agree ** max(0.0, math.log2(max(1, largest) / window)))
    return max(2, math.ceil(math.log(miss) / math.log(1 - found)))


def usable(vector: str):
    """Neither null nor empty nor zero, all components finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(column) -> np.ndarray:
    x = _matrix(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(classes: DataFrame) -> DataFrame:
    """``(label, dim, mean)``: the mean of each label's unit vectors, added up in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            labels, lists = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            dims = np.array([len(v) for v in lists], np.int64)
            for label, dim in {*zip(labels.tolist(), dims.tolist())}:
                at = np.flatnonzero((labels == label) & (dims == dim))
                total = held.setdefault((label, dim), [0, np.zeros(dim)])
                total[0] += len(at)
                total[1] += _unit([lists[i] for i in at]).sum(0)
            if len(held) > 10_000:
                yield from out(held)
                held.clear()
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            keys, sums = zip(*held.items())
            labels, dims = zip(*keys)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array([n for n, _ in sums], pa.int64()),
                                              pa.array([v for _, v in sums], pa.list_(pa.float64()))], ["label", "dim", "n", "total"])

    parts = classes.select("label", "vec").mapInArrow(run, "label long, dim int, n long, total array<double>")
    each = parts.select("label", "dim", "n", F.posexplode("total").alias("place", "total")).groupBy("label", "dim", "place").agg(
        (F.sum("total") / F.sum("n")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "mean")))
    return each.groupBy("label", "dim").agg(F.transform(ordered, lambda x: x["mean"]).alias("mean"))


def _signed(classes: DataFrame, first: int, many: int) -> DataFrame:
    """One row per class and pass, from pass ``first`` on, with its concatenated sign hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.array([len(v) for v in batch.column(2)])
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim not in planes:
                    planes[dim] = [np.random.default_rng([SEED, int(dim), first + k]).standard_normal((dim, BITS)) for k in range(many)]
                x = _unit(own.column(2).to_pylist()) - _matrix(own.column(3).to_pylist())
                for k in range(many):
                    bits = (x @ planes[dim][k] > 0).astype(np.int64)
                    sign = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    n = own.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, first + k), pa.int32()), own.column(0), own.column(1),
                         pa.array(np.full(n, dim), pa.int32()), pa.array(sign)], ["pass", "label", "id", "dim", "sign"])
    means = _means(classes).withColumnRenamed("dim", "size")
    centred = classes.withColumn("size", F.size("vec")).join(means, ["label", "size"])
    return centred.select("label", "id", "vec", "mean").mapInArrow(run, "pass int, label long, id long, dim int, sign long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the edges that first join two parts."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    used = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            used.append(k)
    return used


def _window_links(classes: DataFrame, first: int, many: int, threshold: float) -> DataFrame:
    """Verified pairs that join each window block's vectors, from passes ``first`` on."""
    rows = classes.count() * many
    parts = max(1, math.ceil(rows / 50_000))
    order = ["pass", "label", "dim", "sign", "id"]
    sorted_rows = _signed(classes, first, many).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = stage(sorted_rows.select("id", "label", "dim", F.monotonically_increasing_id().alias("at")), "sorted-passes")
    numbered = numbered.withColumn("part", F.shiftright("at", 33))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))                  # one row a partition
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = (numbered.join(starts, "part").select("id", "label", "dim", rank.cast("long").alias("rank"))
              .join(classes.select("id", "vec"), "id"))
    block = F.floor(F.col("rank") / ROWS)
    # a block and its first neighbours beyond: the latter also belong to the block before
    spread = ranked.withColumn("block", F.explode(F.when((F.col("rank") % ROWS < WINDOW) & (F.col("rank") >= ROWS), F.array(block, block - 1))
                                                  .otherwise(F.array(block))))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        ids, labels, dims = (group[c].to_numpy() for c in ("id", "label", "dim"))
        a, b = [], []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = _matrix(group["vec"].to_numpy()[at])
            norm = np.linalg.norm(x, axis=1)
            for d in range(1, min(WINDOW, len(at) - 1) + 1):
                cos = np.einsum("ij,ij->i", x[:-d], x[d:]) / (norm[:-d] * norm[d:])
                hit = np.flatnonzero((cos >= threshold) & (labels[at[:-d]] == labels[at[d:]]) & (ids[at[:-d]] != ids[at[d:]]))
                a.append(at[hit])
                b.append(at[hit + d])
        a, b = np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)])
        used = _forest(len(group), a, b)
        return pd.DataFrame({"a": ids[a[used]], "b": ids[b[used]]})

    return spread.groupBy("block").applyInPandas(compare, "a long, b long")


def measured_recall(classes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> float:
    """Share of the links of some rows that lie inside components: ``probes`` rows against all of their label.

    Half of the probes are rows that have a component, as most links are theirs; both halves are the smallest
    by a hash of the id. Only the probes' vectors reach the driver.
    """
    order = [F.xxhash64("id", F.lit(SEED)), "id"]
    linked = classes.join(groups.select("id"), "id", "left_semi").orderBy(*order).limit(probes // 2)
    some = classes.orderBy(*order).limit(probes - probes // 2)
    rows = linked.unionByName(some).select("id", "label", "vec").dropDuplicates(["id"]).collect()
    if not rows:
        return 1.0
    table: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r["label"], len(r["vec"])) for r in rows}:
        own = [r for r in rows if (r["label"], len(r["vec"])) == key]
        table[key] = np.array([r["id"] for r in own], np.int64), _unit([r["vec"] for r in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            dims = np.array([len(v) for v in lists], np.int64)
            for (label, dim), (probe, x) in table.items():
                at = np.flatnonzero((labels == label) & (dims == dim))
                for part in np.array_split(at, -(-len(at) // ROWS) or 1):
                    if len(part):
                        p, q = np.nonzero(x @ _unit([lists[i] for i in part]).T >= threshold)
                        other = ids[part[q]] != probe[p]
                        yield pa.RecordBatch.from_arrays([pa.array(probe[p][other]), pa.array(ids[part[q]][other])], ["a", "b"])

    pairs = classes.select("id", "label", "vec").mapInArrow(run, "a long, b long")
    both = (pairs.join(groups.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(groups.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left"))
    found = both.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).alias("k")).first()
    return found["k"] / found["n"] if found["n"] else 1.0


def near_groups(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, component)`` of the classes that link, from as many passes as it takes."""
    largest = classes.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 0
    links, done, many = None, 0, passes(largest, threshold)
    while True:
        new = _window_links(classes, done, many, threshold)
        links = stage(new if links is None else links.unionByName(new).distinct(), "vector-links")
        groups = stage(components(links), "vector-groups")
        done += many
        if done >= MOST_PASSES or measured_recall(classes, groups, threshold) >= RECALL:
            return groups
        many = min(done, MOST_PASSES - done)


def _block_links(classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``(id, linked)``: rows linked with each class inside its component, counted block by block."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    member = classes.join(groups, "id").join(sizes, "component")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    member = member.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # small components share a group; a block pair of a large one is a group of its own
    small = F.col("blocks") == 1
    total = max(1, groups.count() // BLOCK)
    placed = placed.select(
        "component", "id", "vec", "copies", "own",
        F.when(small, F.pmod(F.xxhash64("component"), F.lit(total))).otherwise(F.col("component")).alias("g"),
        small.alias("small"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby("component"):
            i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
            ids, own, copies = (part[c].to_numpy() for c in ("id", "own", "copies"))
            x = _matrix(part["vec"])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            near = x[left] @ x[right].T
            edge = np.abs(near - threshold) < 1e-9               # decide close calls by the plain formula
            for p, q in zip(*np.nonzero(edge)):
                u, v = (np.asarray(part["vec"].iloc[k], np.float64) for k in (left[p], right[q]))
                near[p, q] = np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))
            link = near >= threshold
            if i == j:
                np.fill_diagonal(link, False)
            out.append(pd.DataFrame({"id": ids[left], "linked": link @ copies[right]}))
            if i != j:
                out.append(pd.DataFrame({"id": ids[right], "linked": link.T @ copies[left]}))
        return pd.concat(out)

    counted = placed.groupBy("small", "g", "i", "j").applyInPandas(count, "id long, linked long")
    return counted.groupBy("id").agg(F.sum("linked").alias("linked"))


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """One row per id: links, component (its smallest id) and whether the row is the one kept."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vec"))
    known = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.*")
    known = stage(known.withColumn("usable", usable("vec") & F.col("label").isNotNull())
                  .withColumn("h", F.xxhash64("label", "vec")).withColumn("h2", F.xxhash64("vec", F.lit(1), "label")), "vectors")
    part = known.where("usable")
    classes = stage(part.groupBy("label", "h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("vec").alias("vec")), "vector-classes")
    groups = near_groups(classes, threshold)
    linked = _block_links(classes.select("id", "vec", "copies"), groups, threshold)
    solved = (classes.select("label", "h", "h2", "copies", F.col("id").alias("first"))
              .join(groups.withColumnRenamed("id", "first"), "first", "left")
              .join(linked.withColumnRenamed("id", "first"), "first", "left")
              .select("label", "h", "h2", F.coalesce("component", "first").alias("component"),
                      (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    joined = part.select("id", "label", "h", "h2").join(solved, ["label", "h", "h2"]).select("id", "n_links", "component")
    alone = known.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    nameless = rows.where(F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return (joined.unionByName(alone).unionByName(nameless)
            .select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"),
                    F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept")))
