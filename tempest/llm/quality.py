"""Document quality by a generalised additive model with pairwise interactions.

A text is described by figures of its form (word lengths, letter case, punctuation, repeats,
lines), the same for any language. Each figure is cut into bins at quantiles. Training goes
round the figures in turn: a shallow tree over one figure's bins is fitted to the gradient of
the log loss and a small step of it is added to that figure's lookup table. The pairs of
figures whose joint cuts explain most of what is left are then boosted in the same way into
two-dimensional tables. A score is the sum of one entry per table, taken for a whole batch at
once, through the logistic function; each entry can be read as the log odds a bin adds.

Scoring is one pass over the texts without a shuffle. The fit uses a bounded sample: the
figures of at most ``SAMPLE`` rows of labelled documents outside the held-out fold, those
with the smallest hash. Labels, language, source and id are no inputs.

Defined results: a null text counts as empty, and an empty text has the figures of one; null
labels and labels other than 0 and 1 are not learned from, of several labels of a document
the largest counts; without a positive or without a negative label every score is the prior;
a null id is folded as the empty text; repeated rows get equal scores and count once in the
sample; an empty table gives an empty result. Of the documents only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm.common import fold, text_or_empty, write_table

#: bounds of the fit: labelled rows, bins per figure and per side of a pair, pairs
SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 48, 12, 12
#: rounds over all figures, rounds over all pairs, step, ridge of a leaf, least rows of a leaf
ROUNDS, PAIR_ROUNDS, STEP, RIDGE, LEAST_ROWS = 150, 60, 0.15, 1.0, 8

FIGURES = ["log_words", "word_length", "repeat_share", "distinct_share", "upper_share", "capitals_share", "mark_tail_share",
           "mark_share", "lone_mark_share", "digit_share", "high_share", "words_a_line", "first_capital_share", "end_share",
           "top_share", "short_share", "line_share", "odd_mark_share"]

# kinds of bytes: u upper case, l lower case, h beyond ASCII, d digit, e ends a sentence,
# c other common marks, m other marks, space, line end
KINDS = bytearray(b"m" * 256)
for kind, members in (("u", range(65, 91)), ("l", range(97, 123)), ("h", range(128, 256)), ("d", range(48, 58)), ("e", b".!?"),
                      ("c", b",;:'\"()-"), (" ", b" \t\x0b\x0c\r"), ("\n", b"\n")):
    for b in members:
        KINDS[b] = ord(kind)
KINDS = bytes(KINDS)


@lru_cache(maxsize=1 << 16)
def shape(kinds: bytes) -> tuple[int, int, int, int, int]:
    """Of a word's kinds: all capitals, several marks at the end, marks only, first letter a
    capital, ends a sentence."""
    body = kinds.rstrip(b"ecm")
    letters = body.strip(b"ecm")
    return (len(letters) > 1 and not letters.strip(b"uh") and b"u" in letters, len(kinds) - len(body) > 1 and bool(body), not body,
            letters[:1] == b"u", bool(body) and kinds[len(body):len(body) + 1] == b"e")


def figures(text: str | None) -> list[float]:
    """The figures of one text, in the order of ``FIGURES``."""
    data = (text or "").encode()
    kinds = data.translate(KINDS)
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    count = {k: kinds.count(k) for k in (b"u", b"l", b"h", b"d", b"e", b"c", b"m")}
    solid = sum(count.values())
    letters = max(1, count[b"u"] + count[b"l"])
    totals = np.zeros(5)
    short = 0
    for word, times in Counter(kinds.split()).items():
        totals += np.multiply(shape(word) if len(word) < 64 else shape(word[:32] + word[-32:]), times)
        short += times if len(word) < 4 else 0
    distinct = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    marks = count[b"e"] + count[b"c"] + count[b"m"]
    return [float(np.log1p(n)), solid / n, sum(map(eq, words, words[1:])) / n, len(distinct) / n, count[b"u"] / letters,
            totals[0] / n, totals[1] / n, marks / solid, totals[2] / n, count[b"d"] / solid, count[b"h"] / solid, n / len(lines),
            totals[3] / n, totals[4] / n, max(distinct.values()) / n, short / n, len(set(lines)) / len(lines), count[b"m"] / solid]


def batch_figures(texts) -> np.ndarray:
    return np.array([figures(t.as_py()) for t in texts], float).reshape(-1, len(FIGURES))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(figures, label) of at most ``sample`` distinct rows of labelled documents."""
    known = (labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
             .filter(fold(F.col("doc_id"), folds) != held_out)
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounds the labels, below the rows
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches):
        for batch in batches:
            x = batch_figures(batch.column(2))
            flat = pa.array(x.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)],
                names=["at", "quality", "x"])

    got = (rows.select(F.xxhash64("doc_id", "text").alias("at"), "quality", "text").mapInArrow(run, "at long, quality int, x array<double>")
           .groupBy("at").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("at").limit(sample))
    got = write_table(got, "quality-sample").toArrow()  # at most ``sample`` rows of figures
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FIGURES))
    return x, got.column("quality").to_numpy().astype(float)


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """The cut (first bin of the right side) of the greatest gain, 0 if none."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gain, 0.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0, 0.0
    at = int(np.argmax(gain))
    return at + 1, float(gain[at])


def tree(g, h, n) -> np.ndarray:
    """Step per bin of a tree of depth two over one figure's bins."""
    first, _ = best_cut(g, h, n)
    cuts = {0, len(g)} if not first else {0, first, len(g), best_cut(g[:first], h[:first], n[:first])[0]}
    if first and (second := best_cut(g[first:], h[first:], n[first:])[0]):
        cuts.add(first + second)
    out, cuts = np.zeros(len(g)), sorted(cuts)
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g, h, n) -> tuple[np.ndarray, float]:
    """(step per cell, gain) of a tree that cuts one side, then each half at the other's best cut."""
    best = np.zeros_like(g), 0.0
    base = g.sum() ** 2 / (h.sum() + RIDGE)
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        first, _ = best_cut(a.sum(1), b.sum(1), c.sum(1))
        if not first:
            continue
        out, gain = np.zeros_like(a), -base
        for rows in (slice(0, first), slice(first, None)):
            second, _ = best_cut(a[rows].sum(0), b[rows].sum(0), c[rows].sum(0))
            for cols in (slice(0, second), slice(second, None)) if second else (slice(None),):
                gs, hs = a[rows, cols].sum(), b[rows, cols].sum()
                out[rows, cols] = -gs / (hs + RIDGE)
                gain += gs ** 2 / (hs + RIDGE)
        if gain > best[1]:
            best = (out.T if turned else out), gain
    return best


class Additive:
    """Lookup tables of the figures and of pairs of them."""

    def __init__(self, prior: float):
        self.prior, self.edges, self.tables, self.coarse, self.pairs = prior, [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        self.edges = [edges(x[:, j], BINS) for j in range(x.shape[1])]
        self.coarse = [edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(len(y), self.prior)

        def slopes():
            p = 1 / (1 + np.exp(-z))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                g, h = slopes()
                step = STEP * tree(*(np.bincount(fine[j], w, len(table)) for w in (g, h, np.ones(len(y)))))
                table += step
                z += step[fine[j]]
        cell = lambda i, j: coarse[i] * (len(self.coarse[j]) + 1) + coarse[j]
        size = lambda i, j: (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
        grid = lambda i, j, w: np.bincount(cell(i, j), w, np.prod(size(i, j))).reshape(size(i, j))
        g, h = slopes()
        gains = {(i, j): pair_tree(*(grid(i, j, w) for w in (g, h, np.ones(len(y)))))[1] for i, j in combinations(range(x.shape[1]), 2)}
        chosen = sorted((p for p in gains if gains[p] > 0), key=lambda p: (-gains[p], p))[:PAIRS]
        self.pairs = [(i, j, np.zeros(size(i, j))) for i, j in chosen]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                g, h = slopes()
                step = STEP * pair_tree(*(grid(i, j, w) for w in (g, h, np.ones(len(y)))))[0]
                table += step
                z += step.ravel()[cell(i, j)]
        return self

    @staticmethod
    def bins(x: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(at)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """One entry per table and row, added."""
        z = np.full(len(x), self.prior)
        for table, b in zip(self.tables, self.bins(x, self.edges)):
            z += table[b]
        if self.pairs:
            b = self.bins(x, self.coarse)
            for i, j, table in self.pairs:
                z += table[b[i], b[j]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -700, 700)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Additive:
    x, y = labelled_sample(docs, labels, folds, held_out, sample)
    model = Additive(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    return model.fit(x, y) if 0 < y.sum() < len(y) else model


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3,
                  sample: int = SAMPLE, explain: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted per document; with ``explain`` its figures."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held_out, sample))  # tables of bounded size
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()),
                           *[T.StructField("figures", T.MapType(T.StringType(), T.DoubleType()))] * explain])

    def run(batches):
        for batch in batches:
            x = batch_figures(batch.column(1))
            out = [batch.column(0), pa.array(shared.value.scores(x), pa.float64())]
            if explain:
                out.append(pa.array([list(zip(FIGURES, r)) for r in x.tolist()], pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *["figures"] * explain)
