"""Toxicity by multiple-instance learning.

Labels are per document, evidence is per sentence: a sentence's probability is logistic in
the words and word beginnings it holds, a document's is the noisy-or of its sentences', and
the weights are fitted to document labels by the gradient of that likelihood. Scoring is one
pass over the texts without a shuffle, and names the sentences that carry the score.

The fit uses a bounded sample: at most ``SAMPLE`` labelled documents outside the held-out
fold, those with the smallest hash of their id (one row each), and at most ``FEATURES`` features, the most
telling by lift. Both are parameters. Labels, language, source and id are no inputs.

Defined results: a null or empty text is one empty sentence; null labels and labels other
than 0 and 1 are not learned from, of several labels of a document the largest counts;
without a positive or without a negative label only the prior is learned; a null id is
folded as the empty text; repeated rows get equal scores; an empty table gives an empty
result. Of the documents only id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm.common import fold, renamed, write_table

#: bounds of the fit: labelled documents, features
SAMPLE, FEATURES = 12_000, 50_000
#: a feature is held by so many positive documents, and so much more often there than elsewhere
LEAST_DOCS, LEAST_LIFT = 3, 3.0

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(sentence: str) -> set[str]:
    """Lower-case words, and beginnings of 4 to 6 letters (inflected words share those)."""
    found = set()
    for w in WORD.findall(sentence):
        found.add(w)
        if len(w) > 4:
            found.update((w[:4] + "*", w[:5] + "*", w[:6] + "*"))
    return found


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text or "")] or [(0, 0)]


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled documents."""
    known = (labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .filter(fold(F.col("doc_id"), folds) != held_out)
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # one row per labelled id, that whose text has the smallest hash: ids may be repeated
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic")
            .agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text")).alias("row")))
    return write_table(rows.select("row.text", "toxic"), "toxic-sample")


def telling_features(sample: DataFrame, n_pos: int, n_neg: int, limit: int) -> list[str]:
    def run(batches):
        for batch in batches:
            words, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features((text or "").lower())
                words += found
                toxic += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["w", "y"])

    held = (sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "w string, y int")
            .groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    lift = (F.col("pos") / n_pos) / ((F.col("neg") + 1) / n_neg)
    rows = (held.withColumn("lift", lift).filter((F.col("pos") >= LEAST_DOCS) & (F.col("lift") >= LEAST_LIFT))
            .orderBy(F.desc("lift"), "w").limit(limit).select("w").collect())
    return [r["w"] for r in rows]


def bags(sample: DataFrame, index: dict[str, int]):
    """Arrays over the sample: (sentence of each feature, feature), (document of each sentence), label."""
    def run(batches):
        for batch in batches:
            rows = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                ids, lens = [], []
                for a, b in sentences(text):
                    found = [index[f] for f in features(text[a:b].lower()) if f in index]
                    ids += sorted(found)
                    lens.append(len(found))
                rows.append((y, len(lens), [n for n in lens if n], ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                names=["y", "n", "lens", "ids"])

    got = (sample.select("text", F.col("toxic").cast("int"))
           .mapInArrow(run, "y int, n int, lens array<int>, ids array<int>").toArrow())
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = lambda c: np.diff(np.r_[0, np.cumsum([len(x) for x in got.column(c)])]).astype(int)
    lens = flat("lens").astype(int)
    return (np.repeat(np.arange(len(lens)), lens), flat("ids").astype(int),
            np.repeat(np.arange(len(got)), sizes("lens")), got.column("n").to_numpy() - sizes("lens"), got.column("y").to_numpy())


def fit_noisy_or(word_of, ids, doc_of, empty, y, n_features: int, steps: int = 300, rate: float = 0.1,
                 ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and prior of the sentence model by Adam on the documents' noisy-or likelihood.
    ``empty`` counts a document's sentences without features."""
    theta, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[:-1], theta[-1] = 1.0, -6.0
    n_s = len(doc_of)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(word_of, theta[ids], n_s)
        prior = 1 / (1 + np.exp(-theta[-1]))
        none = -np.bincount(doc_of, np.logaddexp(0, z), len(y)) - empty * np.logaddexp(0, theta[-1])
        none = np.minimum(none, -1e-12)  # log of 1 - noisy-or
        pull = np.where(y == 1, -1 / np.expm1(-none), 1.0)  # d loss / d sum of logits, per sentence probability
        g_s = pull[doc_of] / (1 + np.exp(-z))
        grad = np.zeros(n_features + 1)
        grad[:-1] = np.bincount(ids, g_s[word_of], n_features) + ridge * theta[:-1]
        grad[-1] = g_s.sum() + (pull * empty).sum() * prior
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE,
          limit: int = FEATURES) -> tuple[dict[str, float], float]:
    """(weight by feature, prior logit of a sentence)."""
    rows = labelled_sample(docs, labels, folds, held_out, sample)
    n_pos, n = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_pos = int(n_pos or 0)
    if not n_pos or n_pos == n:
        return {}, 8.0 if n_pos else -8.0
    names = telling_features(rows, n_pos, n - n_pos, limit)
    weights, prior = fit_noisy_or(*bags(rows, {w: i for i, w in enumerate(names)}), len(names))
    return {w: float(x) for w, x in zip(names, weights) if abs(x) > 1e-3}, prior


def score_sentences(text: str | None, weights: dict[str, float], prior: float) -> list[tuple[int, int, float]]:
    """(start, end, logit) of each sentence that holds a feature, and (0, 0, prior) for the others' sake."""
    out, text = [], text or ""
    for a, b in sentences(text):
        z = prior
        for f in features(text[a:b].lower()):
            z += weights.get(f, 0.0)
        out.append((a, b, z))
    return out


def noisy_or(logits) -> float:
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
                   sample: int = SAMPLE, spans: bool = False, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted per document; with ``spans`` the (start, end) of
    its offending sentences; with ``keep`` all columns of ``docs`` and ``_score``."""
    weights, prior = train(docs, labels, folds, held_out, sample)
    model = docs.sparkSession.sparkContext.broadcast((weights, prior))  # at most FEATURES weights
    rows = docs if keep else docs.select("doc_id", "text")
    at = rows.columns.index("text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*rows.schema.fields, T.StructField("_score", T.DoubleType()),
                           *[T.StructField("_spans", span)] * spans])

    def run(batches):
        weights, prior = model.value
        for batch in batches:
            scores, found = [], []
            for text in batch.column(at):
                z = score_sentences(text.as_py(), weights, prior)
                scores.append(noisy_or(np.array([x[2] for x in z])))
                if spans:
                    found.append([{"start": a, "end": b} for a, b, x in z if x >= 0])
            out = [*batch.columns, pa.array(scores, pa.float64())]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    scored = rows.mapInArrow(run, schema)
    if keep:
        return scored
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
                         F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"),
                         *[F.col("_spans").alias("spans")] * spans)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents whose score is below one half, columns unchanged."""
    own = renamed(docs, "doc_id", "text")
    return score_toxicity(own, labels, keep=True, **options).filter("_score < 0.5").select(*own.columns).toDF(*docs.columns)
