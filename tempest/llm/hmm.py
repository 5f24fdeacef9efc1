"""Hidden Markov language model: training and exact scoring of whole texts.

Hidden states emit word classes and a class emits its words: each of the ``OWN`` commonest
words (of two or more occurrences) and the end of a text is a class of its own, all other
words (unseen ones too) fall into ``RARE`` classes by their last two characters, inside which a word has its add-one
share. Word counts cover all training texts. Baum-Welch runs over all training tokens: every
task returns expected counts, Spark sums them per class, and only the sums, whose number is
that of classes and states, reach the driver. Texts are cut into sequences of ``BLOCK``
tokens for training alone; scoring is the scaled forward recursion over the whole text.

The counts of the ``NEAR`` commonest words are broadcast (a fixed number); words beyond them
meet their counts in a join, so the vocabulary may grow with the corpus.

Defined results: a null or empty text is one end token; a null id is folded as the empty
text; repeated rows are separate rows with equal scores; without training texts N and V are
0, every word is unknown and states emit evenly; an empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm.common import fold, write_table

#: words with a class of their own, classes of the others, words whose counts are broadcast
OWN, RARE, NEAR = 32_000, 256, 262_144
STATES, ROUNDS, BLOCK = 6, 5, 128
#: pseudo tokens that draw a state's emissions to the corpus's
PULL = 500.0
#: sequences and tokens worked on together
SEQUENCES = 4096
#: bytes of text whose words are worked on together
TEXT_BYTES = 4 << 20


def text_slices(batches, column: int):
    """The batches in slices of about ``TEXT_BYTES`` of text, one row at least: the words of a
    slice take many times the memory of its text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row of each word, words): maximal runs of non-white characters, A-Z lower-cased."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.ascii_split_whitespace(texts)
    flat, lens = parts.flatten(), np.diff(parts.offsets.to_numpy())
    row = np.repeat(np.arange(len(texts)), lens)
    full = pc.not_equal(flat, "")
    return row[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()


def count_words(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(word, n) over the training texts; the end of a text is the empty word."""
    rows = docs.select((fold(F.col("doc_id"), folds) != held_out).alias("train"), "text").filter("train").select("text")

    def run(batches):
        for batch in text_slices(batches, 0):
            _, words = words_of(batch.column(0))
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([""])]),
                 pa.array(np.r_[n, len(batch)].astype(np.int64))], names=["word", "n"])

    return write_table(rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


class Vocabulary:
    """The fixed-size part of the counts that every task needs."""

    def __init__(self, counts: DataFrame, own: int, rare: int, near: int):
        self.total, self.distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.total, self.rare = int(self.total or 0), rare
        # the commonest words: all of a least count, which is the lowest bound of a fine scale
        # of counts that at most ``near`` words reach, and of the next step a part by hash
        step = F.floor(F.log2("n") * 64).cast("int")
        scale = counts.filter("word != ''").groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("n")).collect()
        if own + rare >= 1 << 16:
            raise ValueError("classes are stored in two bytes: own + rare must stay below 65,536")
        least, reach, some = 1 << 62, 0, F.lit(False)
        for r in sorted(scale, key=lambda r: -r["s"]):
            if reach + r["v"] > near:
                if r["s"] and reach < near:  # words met once are left to the join
                    some = self.part_of_step(counts, step == r["s"], r["v"], near - reach)
                break
            reach, least = reach + r["v"], r["n"]
        top = counts.filter((F.col("word") != "") & ((F.col("n") >= least) | some)).toArrow()
        words, n = top.column("word").combine_chunks(), top.column("n").to_numpy().astype(np.int64)
        order = pc.sort_indices(pa.table({"w": words, "n": n}), sort_keys=[("n", "descending"), ("w", "ascending")])
        self.words, self.counts = words.take(order), n[order.to_numpy()]
        # words met once stay in the rare classes: their mass is what unseen words draw on
        self.own = min(own, int((self.counts > 1).sum()))
        self.end = self.own + rare
        self.classes = self.end + 1
        # words and tokens of the rare classes: all words less those with a class of their own
        cls = F.pmod(F.crc32(F.expr("right(word, 2)").cast("binary")), F.lit(rare)).cast("int")
        sums = np.zeros((rare, 2))
        for r in counts.filter("word != ''").groupBy(cls.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            sums[r["c"]] = r["n"], r["v"]
        of = self.rare_class(self.words.slice(0, self.own))
        np.subtract.at(sums, of, np.stack([self.counts[:self.own], np.ones(self.own)], 1))
        self.rare_total = sums.sum(1) + 1  # add one for each word and for the unseen
        self.ends = int(self.total - self.counts[:self.own].sum() - sums[:, 0].sum())
        self.prior = np.r_[self.counts[:self.own], sums[:, 0], self.ends] + 1.0
        self.prior /= self.prior.sum()

    @staticmethod
    def part_of_step(counts: DataFrame, of_step, size: int, room: int):
        """Condition on the words of the step that crosses the bound: those of the first hash
        bins that together hold at most ``room`` of its ``size`` words."""
        bins = -(-64 * size // room)
        bin_ = F.pmod(F.xxhash64("word"), F.lit(bins))
        first = {r["b"]: r["v"] for r in counts.filter((F.col("word") != "") & of_step & (bin_ <= 64))
                 .groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("v")).collect()}  # at most 65 rows
        cut, taken = 0, first.get(0, 0)
        while taken <= room and cut <= 64:
            cut += 1
            taken += first.get(cut, 0)
        return of_step & (bin_ < cut)

    def rare_class(self, words: pa.Array) -> np.ndarray:
        ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        cls = np.array([zlib.crc32(w.encode()) % self.rare for w in ends.dictionary.to_pylist()], np.int64)
        return cls[ends.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)

    def look_up(self, words: pa.Array):
        """Of each word: its class, log10(count + 1) (0 beyond the broadcast words), whether it
        is among those, and the log10 of its class's total (0 for a class of its own)."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        near = at >= 0
        count = np.where(near, self.counts[at], 0) if len(self.counts) else np.zeros(len(at), np.int64)
        single = near & (at < self.own)
        of = self.rare_class(words)
        cls = np.where(single, at, self.own + of)
        return cls, np.log10(count + 1.0), near, single, np.where(single, 0.0, np.log10(self.rare_total[of]))


def encode(docs: DataFrame, vocab, folds: int, held_out: int) -> DataFrame:
    """One row per document, written once: its class sequence and the parts of its scores
    that need no join; the words beyond the broadcast counts with their numbers."""
    schema = ("row long, doc_id %s, held_out boolean, n_tokens long, n_known long, base double, inside double, "
              "ids binary, far array<struct<word:string,n:int>>" % docs.schema["doc_id"].dataType.simpleString())
    far_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def run(batches):
        v = vocab.value
        unit = np.log10(v.total + (v.distinct + 1.0))
        for batch in text_slices(batches, 3):
            n = len(batch)
            row, words = words_of(batch.column(3))
            idx = words.indices.to_numpy()
            cls, log_n, near, single, log_class = v.look_up(words.dictionary)
            lens = np.bincount(row, minlength=n) + 1
            ends = np.cumsum(lens)
            ids = np.empty(ends[-1] if n else 0, np.uint16)
            ids[ends - 1] = v.end
            if len(row):
                ids[np.arange(len(row)) + row] = cls[idx]
            sums = lambda x: np.bincount(row, x[idx], n) if len(row) else np.zeros(n)
            base = sums(log_n) + np.log10(v.ends + 1.0) - lens * unit
            inside = sums(np.where(single, 0.0, log_n) - log_class)
            known = sums(near.astype(float)).astype(np.int64) + (v.ends > 0)
            # words beyond the broadcast counts, once per document and word
            out = ~near[idx] if len(row) else np.zeros(0, bool)
            pair, times = np.unique(row[out] * np.int64(max(1, len(near))) + idx[out], return_counts=True)
            far_row, far_word = pair // max(1, len(near)), pair % max(1, len(near))
            cuts = np.searchsorted(far_row, np.arange(n + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays(
                [words.dictionary.take(pa.array(far_word)).cast(pa.string()), pa.array(times.astype(np.int32))], names=["word", "n"])
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, ends * 2].astype(np.int32).tobytes()),
                                                          pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(lens.astype(np.int64)), pa.array(known),
                 pa.array(base), pa.array(inside), data, pa.ListArray.from_arrays(pa.array(cuts), structs).cast(far_type)],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "ids", "far"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return write_table(rows.mapInArrow(run, schema), "lm-rows")


class Model:
    """Start, transition and emission (class by state) probabilities. ``start`` has two rows:
    for the beginning of a text and for sequences cut from within one."""

    def __init__(self, prior: np.ndarray, states: int, seed: int = 7):
        noise = np.random.default_rng(seed).normal(0, 1.0, (len(prior), states))
        self.prior, self.emit = prior, prior[:, None] * np.exp(noise)
        self.emit /= self.emit.sum(0)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9 if states > 1 else 1.0)
        self.start = np.full((2, states), 1 / states)

    def update(self, start, move, emit) -> None:
        """The maximum step from expected counts, emissions drawn to the corpus's."""
        self.start = (start + 1) / (start + 1).sum(1, keepdims=True)
        self.move = (move + 1) / (move + 1).sum(1, keepdims=True)
        emit = emit + PULL * self.prior[:, None]
        self.emit = emit / emit.sum(0)


def expected_counts(model: Model, flat: np.ndarray, at: np.ndarray, lens: np.ndarray, inner: np.ndarray):
    """Baum-Welch counts of sequences flat[at : at + len], longest first, by the scaled
    forward and backward recursions over all of them at once."""
    k, steps = model.move.shape[0], int(lens[0])
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # sequences longer than t
    alpha, scale, seen = [], [], []
    for t in range(steps):
        n = active[t]
        ids = flat[at[:n] + t]
        a = (model.start[inner[:n]] if t == 0 else alpha[-1][:n] @ model.move) * model.emit[ids]
        c = a.sum(1, keepdims=True)
        alpha.append(a / c)
        scale.append(c)
        seen.append(ids)
    move, gammas, ahead = np.zeros((k, k)), [None] * steps, np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        beta = np.ones((n, k))
        if len(ahead):
            m = len(ahead)
            beta[:m] = ahead @ model.move.T
            move += alpha[t][:m].T @ ahead
        g = alpha[t] * beta
        gammas[t] = g / g.sum(1, keepdims=True)
        if t:
            ahead = model.emit[seen[t]] * beta / scale[t]
    move *= model.move
    start = np.stack([gammas[0][inner == i].sum(0) for i in (0, 1)])
    return start, move, np.concatenate(seen), np.concatenate(gammas)


def log_likelihood(model: Model, flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 probability of each whole sequence, longest first."""
    total = np.zeros(len(lens))
    active = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left") if len(lens) else []
    state = None
    for t, n in enumerate(active):
        state = (np.broadcast_to(model.start[0], (n, len(model.start[0]))) if t == 0 else state[:n] @ model.move) \
            * model.emit[flat[at[:n] + t]]
        c = state.sum(1, keepdims=True)
        state = state / c
        total[:n] += np.log10(c[:, 0])
    return total


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, start and length of each row) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint16)
    return data, offsets[:-1] // 2, np.diff(offsets) // 2


def train(rows: DataFrame, prior: np.ndarray, states: int, rounds: int, block: int) -> Model:
    model = Model(prior, states)
    spark, classes = rows.sparkSession, len(prior)
    names = [f"s{i}" for i in range(states)]

    def run_with(shared):
        def run(batches):
            m = shared.value
            start, move, emit = np.zeros((2, states)), np.zeros((states, states)), np.zeros((classes, states))
            for batch in batches:
                flat, first, lens = _ids(batch.column(0))
                parts = -(-lens // block)
                step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * block
                at, size = np.repeat(first, parts) + step, np.minimum(block, np.repeat(lens, parts) - step)
                order = np.argsort(-size, kind="stable")
                for i in range(0, len(order), SEQUENCES):
                    o = order[i:i + SEQUENCES]
                    s, mv, ids, g = expected_counts(m, flat, at[o], size[o], (step[o] > 0).astype(int))
                    start += s
                    move += mv
                    for k in range(states):
                        emit[:, k] += np.bincount(ids, g[:, k], classes)
            used = np.flatnonzero(emit.any(1))
            key = np.r_[used, -1 - np.arange(states), -101, -102]
            sums = np.vstack([emit[used], move, start])
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *[pa.array(sums[:, k]) for k in range(states)]],
                                             names=["key", *names])
        return run

    seqs = rows.filter(~F.col("held_out")).select("ids")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        got = (seqs.mapInArrow(run_with(shared), "key long, " + ", ".join(f"{n} double" for n in names))
               .groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).toArrow())  # classes + states + 2 rows
        key, sums = got.column("key").to_numpy(), np.stack([got.column(n).to_numpy() for n in names], 1)
        emit = np.zeros((classes, states))
        emit[key[key >= 0]] = sums[key >= 0]
        pick = lambda k: sums[key == k].sum(0)
        model.update(np.stack([pick(-101), pick(-102)]), np.stack([pick(-1 - i) for i in range(states)]), emit)
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, states: int = STATES, rounds: int = ROUNDS,
                    own: int = OWN, rare: int = RARE, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = count_words(docs, folds, held_out)
    vocab = Vocabulary(counts, own, rare, near)
    rows = encode(docs, spark.sparkContext.broadcast(vocab), folds, held_out)
    model = spark.sparkContext.broadcast(train(rows, vocab.prior, states, rounds, block))

    def run(batches):
        for batch in batches:
            flat, at, lens = _ids(batch.column(1))
            order = np.argsort(-lens, kind="stable")
            out = np.empty(len(order))
            out[order] = log_likelihood(model.value, flat, at[order], lens[order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["row", "path"])

    paths = rows.select("row", "ids").mapInArrow(run, "row long, path double")
    # words beyond the broadcast counts meet theirs in a join
    far = rows.select("row", F.explode("far").alias("f")).select("row", "f.word", "f.n")
    gain = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    far = (far.join(counts.select("word", F.col("n").alias("c")), "word", "left")
           .groupBy("row").agg(F.sum(gain).alias("gain"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more")))
    known = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside")
    extra = F.coalesce("gain", F.lit(0.0))
    return (known.join(paths, "row").join(far, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(vocab.total).cast("long").alias("train_tokens"),
                    (F.col("base") + extra).alias("base_score"),
                    (F.col("path") + F.col("inside") + extra).alias("score")))
