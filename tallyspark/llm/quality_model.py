"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins.  Boosting goes round the
features in a cycle; each step fits a tree of at most three leaves on one
feature's bins to the current gradients and adds it, shrunk, to that feature's
lookup table.  The pairs of features whose best four-quadrant cut explains
most of what is left are then boosted in the same way on two-dimensional
tables.  A score is the logistic of a constant plus one table entry per
feature and per pair, so scoring is a handful of vectorised additions.

Training reads the features of about ``TRAIN_ROWS`` labelled texts, chosen by a
hash of their id (all of them if there are fewer), and runs on the driver over
that bounded sample; texts are measured and scored in Spark.

Defined results: null and empty texts are measured as texts without words and
get the score that these measures give; without any label every score is 0.5;
with one label only every score is near that label; the whole text is
measured; repeated rows get equal scores; several labels of a document all
count; extra columns pass through, and one called ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import RollingHash, binary_column, column_slices, space_words, with_arrow_columns, word_hashes
from .tables import share

TRAIN_ROWS = 20_000
DICE = 1 << 40
BINS = 32
PAIR_BINS = 12
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
RIDGE = 1.0

FEATURES = ("log_words", "word_length", "distinct_words", "top_word", "repeat_words", "dup_lines",
            "words_a_line", "symbols", "marks", "full_stops", "upper", "digits", "non_ascii")

_UPPER, _DIGIT, _HIGH = (np.array([f(c) for c in range(256)], bool) for f in (
    lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c >= 128))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@", np.uint8))


def features(text: bytes | None, rolling: RollingHash) -> list[float]:
    """The measures of one text, in the order of ``FEATURES``."""
    text = text or b""
    words = space_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    h = word_hashes(words)
    _, counts = np.unique(h, return_counts=True)
    windows = rolling.windows(h)
    covered = np.zeros(n, bool)
    if len(windows):
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[inverse] > 1)
        for k in range(rolling.width):
            covered[twice + k] = True
    lines = [line for line in text.split(b"\n") if line.strip()]
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    return [np.log1p(n), size / n, len(counts) / n, counts.max() / n, covered.sum() / n,
            1 - len(set(lines)) / len(lines), n / len(lines), histogram[_SYMBOL].sum() / n,
            histogram[33] / n, histogram[46] / n, histogram[_UPPER].sum() / size,
            histogram[_DIGIT].sum() / size, histogram[_HIGH].sum() / size]


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    rolling = RollingHash(3)
    return np.array([features(t, rolling) for t in texts], float).reshape(-1, len(FEATURES))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = (left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE)
            - g.sum() ** 2 / (h.sum() + RIDGE))
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most three leaves over the bins, as a table of steps."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    gain, cut = _best_cut(g, h)
    if gain <= 0:
        return out
    parts = [(0, cut), (cut, len(g))]
    again = [_best_cut(g[a:b], h[a:b]) for a, b in parts]
    k = int(again[1][0] > again[0][0])
    if again[k][0] > 0:
        (a, b), c = parts[k], again[k][1]
        parts[k:k + 1] = [(a, a + c), (a + c, b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best pair of cuts of a two-dimensional table."""
    cg, ch = (np.cumsum(np.cumsum(np.pad(x, ((1, 0), (1, 0))), 0), 1) for x in (g, h))
    a, b = g.shape
    if a < 2 or b < 2:
        return 0.0, np.zeros_like(g)
    inner = (slice(1, a), slice(1, b))
    value = lambda c: (c[inner], c[1:a, b:] - c[inner], c[a:, 1:b] - c[inner],
                       c[a, b] - c[1:a, b:] - c[a:, 1:b] + c[inner])
    gs, hs = value(cg), value(ch)
    gain = sum(x ** 2 / (y + RIDGE) for x, y in zip(gs, hs)) - g.sum() ** 2 / (h.sum() + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    halves = ((slice(0, i + 1), slice(i + 1, a)), (slice(0, j + 1), slice(j + 1, b)))
    for p in halves[0]:
        for q in halves[1]:
            out[p, q] = g[p, q].sum() / (h[p, q].sum() + RIDGE)
    return float(gain[i, j]), out


class Model:
    """Lookup tables of features and pairs."""

    def __init__(self):
        self.constant = 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_edges: list[np.ndarray] = []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.constant)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, f], "left")]
        for (f, g), table in self.pairs.items():
            out += table[np.searchsorted(self.pair_edges[f], x[:, f], "left"),
                         np.searchsorted(self.pair_edges[g], x[:, g], "left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    model = Model()
    if not len(y):
        return model
    mean = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    model.constant = float(np.log(mean / (1 - mean)))
    model.edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model.edges)]
    logit = np.full(len(y), model.constant)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for table, b in zip(model.tables, bins):
            g, h = gradients()
            step = RATE * _leaves(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            logit += step[b]

    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def table_of(f: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = gradients()
        at = coarse[f] * shape[k] + coarse[k]
        return at, *(np.bincount(at, v, shape[f] * shape[k]).reshape(shape[f], shape[k]) for v in (g, h))

    gains = {(f, k): _quadrants(*table_of(f, k)[1:])[0] for f, k in combinations(range(x.shape[1]), 2)}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]:
        model.pairs[pair] = np.zeros((shape[pair[0]], shape[pair[1]]))
    for _ in range(PAIR_ROUNDS):
        for (f, k), table in model.pairs.items():
            at, g, h = table_of(f, k)
            step = RATE * _quadrants(g, h)[1]
            table += step
            logit += step.ravel()[at]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """The model learnt from at most ``train_rows`` labelled rows of ``docs``:
    labelled ids are drawn by a hash of the id, and of their rows, which may be
    many if an id repeats, those with the smallest hash of id and text."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).distinct()
    dice = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(DICE))
    least = known.agg(F.count(F.lit(1)).alias("n"), F.min(dice).alias("least")).first()
    chosen = max(least["least"] or 0, int(DICE * min(1.0, train_rows / max(1, least["n"]))))
    # About train_rows ids, cut to the bound: two numbers each.
    sample = known.where(dice <= chosen).orderBy(dice, "y").limit(2 * train_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select(
        "y", F.xxhash64(F.lit("row"), "id", "text").alias("dice"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in column_slices(whole, "text"):
                x = feature_matrix(binary_column(batch, "text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("dice"), batch.column("y")] + [pa.array(x[:, k]) for k in range(x.shape[1])],
                    names=["dice", "y", *FEATURES])

    schema = "dice long, " + ", ".join(f"{c} double" for c in ("y", *FEATURES))
    drawn = rows.mapInArrow(run, schema).orderBy("dice", "y").limit(train_rows).drop("dice")
    got = np.array(sorted(map(tuple, drawn.collect())), float)  # at most train_rows rows of numbers
    got = got.reshape(-1, len(FEATURES) + 1)
    return fit(got[:, 1:], got[:, 0])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared, _ = share(docs.sparkSession, model)

    def make():
        tables = shared()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(tables.score(feature_matrix(binary_column(batch, text_col))))]

        return compute

    return with_arrow_columns(docs, [T.StructField("score", T.DoubleType())], text_col, make)
