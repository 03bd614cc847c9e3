"""Quality classifier: positive-unlabelled learning with a non-negative risk estimator.

Trusted positives are labelled rows (``quality = 1``) outside the held-out fold; the unlabelled set is
all documents, whose labels, if any, are not read. Their statistics are written to scratch once: the bins
are cut at the quantiles of all of them, and the class prior is estimated from the scores of all of them:
for a score that separates the two sets, the share of unlabelled rows above a cut over the share of positives
above it is at least the prior, and comes closest where negatives are rarest. Each half of the rows is scored
by a model fitted on the other half.

The model is additive: surface statistics of the whole text, each cut at its quantiles, one weight per
bin. It minimises ``pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])`` with the logistic loss (the
maximum allows the second part its sampling error), so the sigmoid of its margin estimates the probability of quality 1.

The gradient steps use ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled rows at most (parameters
of :func:`train`), one an id. Defined results: null and empty texts have all statistics 0 and score by those
bins; with fewer than two positives every text scores 0.5, with an empty table too. Repeated rows score alike,
each is an unlabelled row. Very long texts are read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, sigmoid, smallest_by_hash, stage

MAX_POSITIVE, MAX_UNLABELLED = 8000, 16000
BINS, RIDGE, STEPS = 8, 1e-4, 400
#: Standard errors by which the estimated negative risk may fall below 0 before the step turns round.
SLACK = 2.0
LOWER, UPPER, DIGIT, SPACE, POINT, SYMBOL = range(6)


def _kinds() -> np.ndarray:
    """Kind of each code point of the basic plane; others count as symbols."""
    table = np.full(1 << 16, SYMBOL, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isupper():
            table[i] = UPPER
        elif c.isalpha():
            table[i] = LOWER
        elif c.isdigit():
            table[i] = DIGIT
        elif c.isspace():
            table[i] = SPACE
        elif c in ".,;:?'\"()-":
            table[i] = POINT
    return table


_KINDS: np.ndarray | None = None


def statistics(text: str | None) -> list[float]:
    """Surface statistics of a whole text, all finite."""
    global _KINDS
    if _KINDS is None:
        _KINDS = _kinds()
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(points, 0xFFFF)], minlength=6)
    n = max(1, len(points))
    letters = max(1, int(kinds[LOWER] + kinds[UPPER]))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, counts = max(1, len(words)), Counter(words)
    frequent = sorted(counts.values(), reverse=True)
    chars = np.bincount(np.minimum(points, 1023), minlength=1) / n
    chars = chars[chars > 0]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [np.log1p(len(words)), kinds[UPPER] / letters, kinds[DIGIT] / n, kinds[SYMBOL] / n, kinds[POINT] / n,
            kinds[SPACE] / n, sum(map(len, words)) / w, len(counts) / w, (frequent or [0])[0] / w, repeats / w,
            len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
            text.count("|") / w, text.count("!") / w, text.count(".") / w, sum(len(x) <= 3 for x in words) / w,
            sum(v == 1 for v in frequent) / w, np.log1p(max(map(len, words), default=0)),
            float(-(chars * np.log(chars)).sum()), sum(frequent[:5]) / w,
            sum(x[0].isupper() for x in words) / w, len(counts) / w * np.log1p(len(words))]


@dataclass
class BinnedModel:
    edges: list[np.ndarray]       # of each statistic
    weights: np.ndarray           # of all bins of all statistics, one after the other
    bias: float

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])]).astype(int)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.starts[k] + np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), self.bias)
        return self.bias + self.weights[self.bins(x)].sum(1)


def _adam(slope, size: int) -> np.ndarray:
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, STEPS + 1):
        g = slope(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (1 - k / (STEPS + 1)) * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-9)
    return theta


def _risk_slope(bp: np.ndarray, bu: np.ndarray, size: int, prior: float | None):
    """Gradient of the non-negative risk; with no prior, of the loss that tells the two sets apart."""
    def back(bins: np.ndarray, d: np.ndarray) -> np.ndarray:
        g = np.bincount(bins.ravel(), np.repeat(d, bins.shape[1]), minlength=size + 1)
        g[size] = d.sum()
        return g

    def slope(theta: np.ndarray) -> np.ndarray:
        gp, gu = theta[bp].sum(1) + theta[size], theta[bu].sum(1) + theta[size]
        ridge = RIDGE * np.append(theta[:size], 0.0)
        if prior is None:
            return back(bp, (sigmoid(gp) - 1) / len(gp)) + back(bu, sigmoid(gu) / len(gu)) + ridge
        lu, lp = np.logaddexp(0, gu), np.logaddexp(0, gp)
        negative = lu.mean() - prior * lp.mean()
        error = np.sqrt(lu.var() / len(lu) + prior ** 2 * lp.var() / len(lp))
        step = back(bu, sigmoid(gu) / len(gu)) - back(bp, prior * sigmoid(gp) / len(gp))
        if negative < -SLACK * error:          # over-fitted: walk the negative part back up
            return -step + ridge
        return back(bp, prior * (sigmoid(gp) - 1) / len(gp)) + step + ridge
    return slope


#: Cuts at which the prior's ratio is taken: shares of the positives that lie below.
PRIOR_CUTS = 60


def prior_cuts(positive: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Scores that from all down to ``least`` of the positives reach."""
    return np.quantile(positive, np.linspace(0, 1 - least, PRIOR_CUTS))


def class_prior(positive: np.ndarray, cuts: np.ndarray, reached: np.ndarray, rows: int) -> float:
    """Smallest ratio of the sets' shares above a cut; ``reached`` of the ``rows`` unlabelled ones lie above each."""
    over_p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    return float(np.clip(np.min(reached / max(1, rows) / over_p), 0.01, 0.99))


def bin_edges(quantiles: list[np.ndarray]) -> list[np.ndarray]:
    """Edges of each statistic's bins from its quantiles; 0 is one, as it is special to most."""
    return [np.unique(np.concatenate([[0.0], q])) for q in quantiles]


QUANTILES = [*np.linspace(0, 1, BINS + 1)[1:-1].tolist(), 0.01, 0.03, 0.97, 0.99]


def _apart(bp: np.ndarray, bu: np.ndarray, half_p: np.ndarray, half_u: np.ndarray, size: int) -> list[np.ndarray]:
    """Two models that tell the sets apart; the one of each half is fitted on the rows of the other."""
    return [_adam(_risk_slope(bp[half_p != k], bu[half_u != k], size, None), size + 1)[:size] for k in (0, 1)]


def fit(positive: np.ndarray, unlabelled: np.ndarray, edges: list[np.ndarray] | None = None,
        prior: float | None = None) -> tuple[BinnedModel, float]:
    """The model of least non-negative risk, and the class prior; what is not given comes from the two sets."""
    if edges is None:
        both = np.concatenate([positive, unlabelled])
        edges = bin_edges([np.quantile(both[:, k], QUANTILES) for k in range(both.shape[1])])
    frame = BinnedModel(edges, np.zeros(0), 0.0)
    bp, bu, size = frame.bins(positive), frame.bins(unlabelled), int(frame.starts[-1])
    if prior is None:
        half_p, half_u = np.arange(len(bp)) % 2, np.arange(len(bu)) % 2
        found = []
        for k, weights in enumerate(_apart(bp, bu, half_p, half_u, size)):
            own, other = weights[bp[half_p == k]].sum(1), np.sort(weights[bu[half_u == k]].sum(1))
            cuts = prior_cuts(own)
            found.append(class_prior(own, cuts, len(other) - np.searchsorted(other, cuts, side="left"), len(other)))
        prior = float(np.mean(found))
    theta = _adam(_risk_slope(bp, bu, size, prior), size + 1)
    return BinnedModel(edges, theta[:size], float(theta[size])), prior


def estimate_prior(rows: DataFrame, positive: np.ndarray, unlabelled: np.ndarray, half_u: np.ndarray,
                   edges: list[np.ndarray]) -> float:
    """The class prior from the scores of all ``rows`` (``half``, ``x``), each half by the other half's model."""
    frame = BinnedModel(edges, np.zeros(0), 0.0)
    bp, bu, half_p = frame.bins(positive), frame.bins(unlabelled), np.arange(len(positive)) % 2
    if min(np.bincount(half_u, minlength=2)) == 0:                    # too few rows for two halves
        half_u = np.arange(len(bu)) % 2
    models = _apart(bp, bu, half_p, half_u, int(frame.starts[-1]))
    own = [models[k][bp[half_p == k]].sum(1) for k in (0, 1)]
    cuts = [prior_cuts(s) for s in own]

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in (0, 1):
                mine = batch["x"][batch["half"] == k]
                if len(mine):
                    score = np.sort(models[k][frame.bins(np.stack(mine.to_numpy()))].sum(1))
                    above = len(score) - np.searchsorted(score, cuts[k], side="left")
                    yield pd.DataFrame({"half": k, "cut": range(-1, len(above)), "n": [len(score), *above]})

    counts = rows.mapInPandas(reached, "half int, cut int, n long").groupBy("half", "cut").agg(F.sum("n").alias("n")).collect()
    n = {(r["half"], r["cut"]): r["n"] for r in counts}              # two halves x cuts
    found = [class_prior(own[k], cuts[k], np.array([n[k, i] for i in range(len(cuts[k]))]), n[k, -1]) for k in (0, 1) if (k, -1) in n]
    return float(np.mean(found))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> BinnedModel:
    """Fit on at most ``max_positive`` trusted positives and steps over ``max_unlabelled`` documents."""
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(v) for v in statistics(t)])

    trusted, _ = labelled_sample(docs, labels, label, {1: max_positive})
    positive = trusted.select(stats("text").alias("x")).collect()
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")
    rows = stage(docs.select(F.col("doc_id").cast("string").alias("id"), stats(F.coalesce("text", F.lit(""))).alias("x"))
                 .select("id", half.alias("half"), "x"), "quality-statistics")
    # one row an id, the smallest of repeated ones, in the order of a hash
    some = smallest_by_hash(rows.where("id is not null").groupBy("id", "half").agg(F.min("x").alias("x")),
                            ["id", F.lit("unlabelled")], max_unlabelled)
    if min(len(positive), len(some)) < 2:
        return BinnedModel([], np.zeros(0), 0.0)
    p = np.array(sorted(r["x"] for r in positive))
    u, half_u = np.array([r["x"] for r in some]), np.array([r["half"] for r in some])
    cuts = rows.agg(*[F.percentile_approx(F.col("x")[k], QUANTILES, 1000).alias(f"q{k}") for k in range(p.shape[1])]).first()
    edges = bin_edges([np.array(q) for q in cuts])
    return fit(p, u, edges, estimate_prior(rows, p, u, half_u, edges))[0]


def score(model: BinnedModel, text: str = "text") -> Column:
    """Probability that the whole text of a column is of quality 1."""
    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), -1)
            yield pd.Series(sigmoid(model.margin(x)))
    return quality(F.col(text))
