"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting adds shallow trees to one feature after another, then to pairs
of features; the sum of a feature's trees is a lookup table over its bins, so a
score is a handful of table look-ups, added up for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, join_by, lowest_hashes, row_key
from sluice.llm.quality_rules import text_stats

#: Documents whose score is at least this are predicted to be good.
THRESHOLD = 0.7
#: The model is fitted on at most this many labelled rows: those with the lowest hash of their id.
MAX_TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.15, 5.0


def features() -> dict[str, Column]:
    """What the model sees of a text; all are ratios or logarithms of counts, so long and short texts compare."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c, of=n: (F.col(c) / of).cast("double")
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": rate("word_chars"),
        "symbols": rate("n_symbols"),
        "capitals": rate("n_upper", F.greatest(F.col("word_chars"), F.lit(1))),
        "marks": rate("n_marks"),
        "ends": rate("n_ends"),
        "repeats": rate("n_repeat_words"),
        "variety": rate("n_distinct"),
        "dup_lines": rate("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))),
        "line_words": F.log1p(F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))),
    }


@dataclass
class Gam:
    """Bin edges and lookup tables: `edges` and `main` by feature, `pair_edges` by feature, `pairs` by (feature, feature)."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    main: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good for each row of features."""
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.main):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.pair_edges)]
        for (a, b), table in self.pairs.items():
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin in the tree of cuts that lowers the loss most; bins hold sums of gradient and hessian."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
        k = int(np.argmax(gain))
        if gain[k] > 1e-9:
            return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + RIDGE))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut of a grid into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = [
        (cg[:-1, :-1], ch[:-1, :-1]), (cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1]),
        (cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]),
        (cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + cg[:-1, :-1], ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + ch[:-1, :-1]),
    ]
    gain = sum(_gain(a, b) for a, b in parts)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for (a, b), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        out[rows, cols] = a[i, j] / (b[i, j] + RIDGE)
    return float(gain[i, j] - _gain(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """A model of the rows `x` with labels `y`; without rows every score is 0.5."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if not len(y):
        return model
    d = x.shape[1]
    model.edges, model.pair_edges = ([_edges(x[:, k], b) for k in range(d)] for b in (BINS, PAIR_BINS))
    binned = [np.searchsorted(model.edges[k], x[:, k], "right") for k in range(d)]
    model.main = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(d):
            g, h = slopes()
            n = len(model.main[k])
            step = RATE * _tree(np.bincount(binned[k], g, n), np.bincount(binned[k], h, n))
            model.main[k] += step
            total += step[binned[k]]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = coarse[a] * size[b] + coarse[b]
        shaped = lambda v: np.bincount(cell, v, size[a] * size[b]).reshape(size[a], size[b])
        return *_quadrants(shaped(g), shaped(h)), cell

    best = sorted(combinations(range(d), 2), key=lambda p: -grid(*p)[0])[:PAIRS]
    model.pairs = {p: np.zeros((size[p[0]], size[p[1]])) for p in best}
    for _ in range(PAIR_ROUNDS):
        for p in best:
            _, leaf, cell = grid(*p)
            model.pairs[p] += RATE * leaf
            total += RATE * leaf.ravel()[cell]
    return model


def held_out() -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """As `quality_model`, with key_text."""
    stats = cut(text_stats(docs).select("doc_id", "key_text", *(v.alias(k) for k, v in features().items())), "quality-features")
    names = list(features())
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = cut(stats.where(~held_out()).join(label, "doc_id"), "quality-labelled")
    train = lowest_hashes(labelled, max_rows, "doc_id", *names).toPandas()
    model = fit(train[names].to_numpy(float), (train["quality"] > 0).to_numpy(float))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.round(model.score(np.column_stack(columns).astype(float)), 9))

    out = stats.select("doc_id", "key_text", held_out().alias("held_out"), score(*names).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs` (doc_id, text; other columns are ignored).

    Learns from `labels` (doc_id, quality) of rows that aren't held out, at most
    `max_rows` of them; the lowest of several labels of an id counts, null labels
    and ids are left out. Scores see the text only: equal texts score alike, null
    and empty texts score as texts without words. Without labels all score 0.5.
    """
    return scores(docs, labels, max_rows, threshold).drop("key_text")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are predicted to be good, with all columns."""
    bad = scores(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("key_id"), "key_text").distinct()
    return join_by(docs.select(F.struct("*").alias("row"), *row_key()), cut(bad, "quality-rejected"), ["key_id", "key_text"], "left_anti").select("row.*")
