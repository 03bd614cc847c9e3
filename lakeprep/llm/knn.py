"""Exact top-k by inner product: Voronoi kNN join.

Pivots are fitted on a bounded sample of the data (``SAMPLE`` rows); queries and data rows belong to the cell of
their nearest pivot. A query cell is summed up by the largest distance ``a`` of its queries from its pivot ``p``
and the smallest score that all its queries' k-th best reach (in the sample); a data cell by its pivot ``c``, the
largest distance ``d`` of its rows from it and their largest norm. From these summaries follows what no score
between two cells exceeds::

    q.x <= p.c + |p| d + a max|x|        q.x <= p.c + a |c| + max|q| d

Pairs of cells below the query cell's score never meet. In the others a row ``x`` is copied to the query cell
only if its own bounds, ``p.x + a |x|`` and ``p.c + a |c| + max|q| |x - c|``, reach the score. Each query cell is
cut into blocks of queries and, by the summaries' counts, into blocks of data; every pair of blocks is solved
exactly in one task, and the blocks' best rows are merged by query. Every row is searched.

How many pivots there are follows from the sample: copies of rows are weighed against comparisons saved, so
vectors without clusters, which no bound of this kind can part, are not copied to many cells in vain.

Defined results: vectors that are null or hold null or non-finite components take no part, and neither do
vectors whose length is not the most frequent one of the sample. A query's own id is never its answer;
repeated rows of an id count once, with their best score, and of repeated query ids the smallest vector
stands. Fewer than k candidates give fewer rows; ties go to the smaller id. Very long vectors work. Extra
columns are not part of the interface: both tables have ``id`` and ``vec``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SAMPLE, QUERY_BLOCK, DATA_BLOCK, AT_ONCE = 4096, 4096, 8192, 512
#: Numbers of pivots that are weighed, and how many multiplications moving one component of a row costs.
PIVOTS, MOVE = (1, 4, 16, 64, 256, 1024), 100


def _finite(vector: str):
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def _pivots(x: np.ndarray, k: int) -> np.ndarray:
    """A few rounds of k-means from evenly spread rows of the sample."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(float)
    for _ in range(5):
        near = np.argmin((centre ** 2).sum(1) - 2 * x @ centre.T, axis=1)
        for c in range(k):
            if (near == c).any():
                centre[c] = x[near == c].mean(0)
    return centre


def _best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ``(query, id, score)`` of every query; ids may repeat, each counts once."""
    out = []
    for at in range(0, len(q), AT_ONCE):
        own = qids[at:at + AT_ONCE]
        score = x @ q[at:at + AT_ONCE].T
        score[ids[:, None] == own[None, :]] = -np.inf
        if len(x) > k:
            kth = np.partition(score, len(x) - k, axis=0)[len(x) - k]
            rows, cols = np.nonzero((score >= kth) & (score > -np.inf))
        else:
            rows, cols = np.nonzero(score > -np.inf)
        out.append(pd.DataFrame({"query": own[cols], "id": ids[rows], "score": score[rows, cols]}))
    found = pd.concat(out).sort_values(["query", "score", "id"], ascending=[True, False, True])
    found = found[found.groupby("query").cumcount() < k]
    return found["query"].to_numpy(), found["id"].to_numpy(), found["score"].to_numpy()


def _unrepeated(ids: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows in layers in which no id repeats."""
    layer = pd.Series(ids).groupby(ids).cumcount().to_numpy()
    return [(ids[layer == n], x[layer == n]) for n in range(int(layer.max(initial=-1)) + 1)]


@dataclass
class Cells:
    """Summaries of the query cells that are in use."""
    number: list[int]             # of the pivot
    pivot: np.ndarray
    away: np.ndarray              # largest distance of a query from it
    least: np.ndarray             # score that every query's k-th best reaches

    def row_bound(self, x: np.ndarray, centre: np.ndarray, away: np.ndarray) -> np.ndarray:
        """What no query of each cell exceeds with each row; ``centre`` and ``away`` place the rows in their cells."""
        by_row = x @ self.pivot.T + self.away * np.linalg.norm(x, axis=1)[:, None]
        return np.minimum(by_row, self.cell_bound(centre, away))

    def cell_bound(self, centre: np.ndarray, away: np.ndarray) -> np.ndarray:
        most_q = np.linalg.norm(self.pivot, axis=1) + self.away
        return centre @ self.pivot.T + self.away * np.linalg.norm(centre, axis=1)[:, None] + most_q * away[:, None]

    def pair_bound(self, centre: np.ndarray, away: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The same for whole data cells, from their summaries."""
        flat = centre @ self.pivot.T + np.linalg.norm(self.pivot, axis=1) * away[:, None] + self.away * norm[:, None]
        return np.minimum(flat, self.cell_bound(centre, away))

    def reach(self, bound: np.ndarray) -> np.ndarray:
        return bound >= self.least - 1e-6 * (1 + np.abs(bound))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argmin((pivots ** 2).sum(1) - 2 * x @ pivots.T, axis=1)


def _kth(q: np.ndarray, qids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some rows, its own id left out."""
    if len(x) < k:
        return np.full(len(q), -np.inf)
    score = q @ x.T
    score[qids[:, None] == ids[None, :]] = -np.inf
    return np.partition(score, len(x) - k, axis=1)[:, len(x) - k]


def _choose(x: np.ndarray, q: np.ndarray, least: np.ndarray, n_queries: int) -> np.ndarray:
    """Pivots by cost: comparisons with the queries of the cells a row reaches, and its copies."""
    best, chosen = math.inf, x[:1]
    for many in PIVOTS:
        if many > 1 and many * 4 > len(x):
            break
        pivots = _pivots(x, many)
        cell = _nearest(q, pivots)
        used = np.unique(cell)
        away = np.linalg.norm(q - pivots[cell], axis=1)
        cells = Cells(used.tolist(), pivots[used], np.array([away[cell == c].max() for c in used]), np.array([least[cell == c].min() for c in used]))
        own = _nearest(x, pivots)
        reached = cells.reach(cells.row_bound(x, pivots[own], np.linalg.norm(x - pivots[own], axis=1)))
        share = np.array([(cell == c).mean() for c in used])
        cost = n_queries * (reached @ share).mean() + MOVE * reached.sum(1).mean()
        if cost < best:
            best, chosen = cost, pivots
    return chosen


def copied(data: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Both sides by ``(cell, part, salt)``, the pairs of blocks that are solved, and the vectors' length."""
    data = data.where(_finite("vec") & F.col("id").isNotNull())
    sample = data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return None
    dim = Counter(len(r["vec"]) for r in sample).most_common(1)[0][0]
    sample = [r for r in sample if len(r["vec"]) == dim]
    sample_ids, sample_x = np.array([r["id"] for r in sample]), np.array([r["vec"] for r in sample], float).reshape(len(sample), dim)
    data = data.where(F.size("vec") == dim)
    asked = (queries.where(_finite("vec") & F.col("id").isNotNull()).where(F.size("vec") == dim)
             .groupBy("id").agg(F.min("vec").alias("vec")))
    asked = stage(asked, "knn-queries")
    n_queries = asked.count()
    if not n_queries:
        return None
    _, distinct = np.unique(sample_ids, return_index=True)             # a repeated id must count once
    sample_ids, sample_x = sample_ids[distinct], sample_x[distinct]
    some = asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE // 4).collect()
    some_ids, some_q = np.array([r["id"] for r in some]), np.array([r["vec"] for r in some], float).reshape(len(some), dim)
    pivots = _choose(sample_x, some_q, _kth(some_q, some_ids, sample_ids, sample_x, k), n_queries)

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                own = batch.iloc[at:at + AT_ONCE]
                q = np.stack([np.asarray(v, float) for v in own["vec"]])
                near = _nearest(q, pivots)
                yield pd.DataFrame({"id": own["id"], "vec": [v.tobytes() for v in q], "cell": near.astype(np.int32),
                                    "least": _kth(q, own["id"].to_numpy(), sample_ids, sample_x, k),
                                    "away": np.linalg.norm(q - pivots[near], axis=1)})

    grouped = stage(asked.mapInPandas(group, "id long, vec binary, cell int, least double, away double"), "knn-groups")
    found = {r["cell"]: r for r in grouped.groupBy("cell").agg(F.min("least").alias("least"), F.max("away").alias("away"), F.count("*").alias("n")).collect()}
    order = sorted(found)
    cells = Cells(order, pivots[order], *(np.array([found[c][f] for c in order]) for f in ("away", "least")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.asarray(v, float) for v in batch.column(1).to_pylist()]).reshape(batch.num_rows, dim)
                own = _nearest(x, pivots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(own.astype(np.int32)),
                     pa.array(np.linalg.norm(x - pivots[own], axis=1)), pa.array(np.linalg.norm(x, axis=1)), batch.column(2)],
                    ["id", "vec", "own", "away", "norm", "deal"])

    # rows are dealt by their place, not their id: repeated rows of one id spread over all blocks
    deal = F.xxhash64(F.monotonically_increasing_id()).alias("deal")
    placed = stage(data.select("id", "vec", deal).mapInArrow(place, "id long, vec binary, own int, away double, norm double, deal long"), "knn-data")
    held = placed.groupBy("own").agg(F.max("away").alias("away"), F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("own").collect()
    own = [r["own"] for r in held]
    meets = np.zeros((len(pivots), len(order)), bool)
    meets[own] = cells.reach(cells.pair_bound(pivots[own], np.array([r["away"] for r in held]), np.array([r["norm"] for r in held])))
    rows = np.array([r["n"] for r in held])
    salts = {c: max(1, math.ceil(int(rows[meets[own, i]].sum()) / DATA_BLOCK)) for i, c in enumerate(order)}
    blocks = {c: max(1, math.ceil(found[c]["n"] / QUERY_BLOCK)) for c in order}

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), float).reshape(batch.num_rows, dim)
            mine, far, deals = (np.asarray(batch.column(i)) for i in (2, 3, 5))
            hit = meets[mine] & cells.reach(cells.row_bound(x, pivots[mine], far))
            for i in np.flatnonzero(hit.any(0)):
                at, c = np.flatnonzero(hit[:, i]), order[i]
                for part in range(blocks[c]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), c), pa.int32()), pa.array(np.full(len(at), part), pa.int32()),
                         pa.array((deals[at] % salts[c]).astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))],
                        ["cell", "part", "salt", "id", "vec"])

    def number(of: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(v) for c in order for v in (int(c), of[c])]), F.col("cell"))

    left = placed.mapInArrow(copy, "cell int, part int, salt int, id long, vec binary")
    right = (grouped.select("cell", F.pmod(F.xxhash64("id"), number(blocks)).cast("int").alias("part"), "id", "vec")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), number(salts) - 1))))
    return left, right, dim


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query, rank, id, score)`` from two tables ``(id long, vec array<double>)``."""
    sides = copied(data, queries, k)
    if sides is None:
        return data.sparkSession.createDataFrame([], "query long, rank int, id long, score double")
    left, right, dim = sides

    def solve(own: pd.DataFrame, asked_here: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked_here):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        own = own.drop_duplicates(["id", "vec"])
        x = np.frombuffer(b"".join(own["vec"]), float).reshape(len(own), dim)
        q = np.frombuffer(b"".join(asked_here["vec"]), float).reshape(len(asked_here), dim)
        found = [_best(i, y, asked_here["id"].to_numpy(), q, k) for i, y in _unrepeated(own["id"].to_numpy(), x)]
        return pd.DataFrame({n: np.concatenate([f[j] for f in found]) for j, n in enumerate(("query", "id", "score"))})

    keys = ["cell", "part", "salt"]
    solved = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query long, id long, score double")
    best = solved.groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.select("query", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)
