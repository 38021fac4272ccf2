"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of measures; each measure has up to BINS quantile bins. Training goes round the measures in
turn, each time fitting one shallow tree (a few cuts along the bins) to the gradient of the logistic loss and adding a
small part of it to that measure's lookup table. Then the pairs of measures whose quadrants explain most of what is
left get tables of their own, boosted in the same cyclic way. Scoring adds up one table entry for each measure and pair,
vectorised over a batch.

Only training is bounded: it takes about TRAIN_ROWS labelled rows, drawn by the hash of their id. Measures and
scores are of every whole text.

Defined cases: null and empty texts have all measures 0 and get a score like any other. A row whose label is null is not
learned from; of several labels for one id all are. Without labels of both classes the score is the smoothed share of
label 1. Equal texts get equal scores. Of cuts or pairs with equal gains the first counts, and training rows are put in
order, so reruns agree. A very long text is measured whole, by itself, in memory of a few times its size. Columns other
than doc_id and text are not looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, settle, slices, small_batches
from .rules import STOP_WORDS

TRAIN_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
CUTS = 3  # cuts of one shallow tree
PAIRS = 8
THRESHOLD = 0.3

MEASURES = [
    "log_words", "mean_word", "distinct_share", "stop_share", "upper_share", "digit_share", "symbol_share", "mark_share",
    "other_share", "line_words", "dup_line_share", "short_line_share", "ended_line_share", "bang_share", "bar_share", "top_word_share",
]

_STOP = frozenset(STOP_WORDS)
_KINDS = np.full(0x250, 8, np.uint8)  # other
for _i in range(0x250):
    _c = chr(_i)
    _KINDS[_i] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in "#*$%&<>@^~=+_\\{}" else 5 if _c == "|" else 6 if _c == "!" else 7 if _c in ".,;:?'\"()-" else 8


def measure(text: str | None) -> list[float]:
    """The measures of one text, in the order of MEASURES."""
    if not text:
        return [0.0] * len(MEASURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(codes, 0x24F)], minlength=9)
    ws = text.split()
    n, lines = len(ws), [x for x in text.split("\n") if x.strip()]
    if not n:
        return [0.0] * len(MEASURES)
    chars = max(1, len(text) - int(kinds[3]))
    counts: dict[str, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    m = len(lines)
    letters = max(1, int(kinds[0] + kinds[1]))
    return [
        float(np.log1p(n)), chars / n, len(counts) / n, sum(c for w, c in counts.items() if w in _STOP) / n, kinds[1] / letters, kinds[2] / chars, kinds[4] / chars, kinds[7] / chars,
        kinds[8] / chars, float(np.log1p(n / m)), 1 - len(set(lines)) / m, sum(len(x) < 25 for x in lines) / m, sum(x.rstrip()[-1] in ".!?" for x in lines) / m, kinds[6] / chars, kinds[5] / chars, max(counts.values()) / n,
    ]


@dataclass
class Gam:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(edges, x[:, f], side="right") for f, edges in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, cuts: int, ridge: float = 1.0) -> np.ndarray:
    """Leaf value of each bin of a tree with so many cuts, each the best of what is left."""
    value = lambda a, b: a * a / (b + ridge)
    gs, hs = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    leaves = [(0, len(g))]
    for _ in range(cuts):
        best = (1e-9, None, None)
        for leaf in leaves:
            a, b = leaf
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = value(gs[at] - gs[a], hs[at] - hs[a]) + value(gs[b] - gs[at], hs[b] - hs[at]) - value(gs[b] - gs[a], hs[b] - hs[a])
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], leaf, a + 1 + k)
        if best[1] is None:
            break
        a, b = best[1]
        leaves.remove(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.empty(len(g))
    for a, b in leaves:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of each axis of a two-way table: gain, and the value of each cell."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    best, table = 0.0, np.zeros_like(g)
    whole = gs[n, m] ** 2 / (hs[n, m] + ridge)
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    if not i.size:
        return best, table
    box = lambda s: (s[i, j], s[i, m] - s[i, j], s[n, j] - s[i, j], s[n, m] - s[i, m] - s[n, j] + s[i, j])
    gq, hq = box(gs), box(hs)
    gain = sum(a * a / (b + ridge) for a, b in zip(gq, hq, strict=True)) - whole
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[k] > 1e-9:
        best = float(gain[k])
        v = [a[k] / (b[k] + ridge) for a, b in zip(gq, hq, strict=True)]
        a, b = int(i[k]), int(j[k])
        table[:a, :b], table[:a, b:], table[a:, :b], table[a:, b:] = v
    return best, table


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Train on rows of measures and labels of 0 and 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    features = range(x.shape[1])
    model.edges = [_edges(x[:, f], BINS) for f in features]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in features:
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(binned[f], g, size), np.bincount(binned[f], h, size), CUTS)
            model.tables[f] += step
            total += step[binned[f]]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in features]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)

    def two_way(a: int, b: int, values: np.ndarray) -> np.ndarray:
        n, m = shape(a, b)
        return np.bincount(coarse[a] * m + coarse[b], values, n * m).reshape(n, m)

    g, h = slopes()
    gains = {(a, b): _quadrants(two_way(a, b, g), two_way(a, b, h))[0] for a, b in combinations(features, 2)}
    model.pairs = sorted(sorted(gains, key=gains.get, reverse=True)[:PAIRS])
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(two_way(a, b, g), two_way(a, b, h))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measures of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(MEASURES)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in slices(texts):
                x = np.array([measure(t) for t in texts[start:stop]], np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 5) == 0


def train(measures: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Gam:
    """A model of about so many labelled rows that aren't held out; all of them where there are fewer."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null")
    found = settle(measures.join(known, "doc_id").where(~held_out(F.col("doc_id"))).select("doc_id", "x", "y"))
    share = rows / max(1, found.count())
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = (found if share >= 1 else found.where(drawn < share)).orderBy("doc_id", "y", "x").select("x", "y").toPandas()
    if not len(some):
        return Gam(0.0)
    return fit(np.array(some["x"].tolist(), np.float64), some["y"].to_numpy(np.float64))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    measures = settle(measured(docs))
    shared = docs.sparkSession.sparkContext.broadcast(train(measures, labels))

    @F.pandas_udf("double")
    def run(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in xs:
            yield pd.Series(shared.value.score(np.array(batch.tolist(), np.float64).reshape(len(batch), len(MEASURES))))

    found = measures.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), run("x").alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
