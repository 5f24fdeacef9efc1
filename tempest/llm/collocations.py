"""Phrase collocations through counting quotient filters.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into
words at blanks and tabs; everything is counted per language. The texts are tokenised once
into chunks (an integer stream and the words it uses). Words counted at least ``least``
times get ids; other words end a phrase, since no phrase is more frequent than its words.
Each chunk counts its phrases of two and three words in counting quotient filters
(``quotient``), one per block of slots, and the filters of a block are merged, wherever their
chunks were read. Phrases counted at least ``least`` times meet the counts of their parts in
joins; every score is exact (38-digit decimals).

The frequency of a phrase never lands in one task: a chunk holds one counter for it, and
the permutation spreads all phrases evenly over the blocks, whose number grows with the
words of the corpus. Words meet the vocabulary once per chunk. Ranks are taken in ``SALTS``
parts first, so the last step reads at most ``SALTS * top`` rows a language.

Defined results: a null text counts as empty, a null language as ``und`` (together with
documents whose language is that); texts without words add nothing; ids are not read, so
repeated rows count as often as they occur; texts of any length are read whole, in slices
that end between words; ties of score and count are ranked by the phrase's bytes; an empty
table gives an empty result. Columns other than text and lang are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempest.llm.chunks import by_frequency, entries, pack, unpack, with_found
from tempest.llm.common import SALTS, salt, whole_units, write_table
from tempest.llm.quotient import Layout

# fixed values: the characters that end a piece
ENDS = b".,;:!?\n\x0b\x0c\r"
#: a byte that no text in UTF-8 holds marks the end of a piece
MARK = b"\xff"
TABLE = bytes.maketrans(ENDS + b"\t", MARK * len(ENDS) + b" ")
#: words per chunk, bytes per slice of a long text, expected entries per block of filters
CHUNK, SLICE, BLOCK = 2_000_000, 4_000_000, 2_000_000


class Numbers(dict):
    """Words numbered as they are met; the mark is 0."""

    def __init__(self):
        self[MARK] = 0

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def words_of(text: bytes):
    """Lists of words and marks; long texts in slices that end between words."""
    text = text.lower().translate(TABLE).replace(MARK, b" " + MARK + b" ")
    at = 0
    while len(text) - at > SLICE:
        cut = text.find(b" ", at + SLICE)
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()
    yield [MARK]


def text_chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of one language each: keys (words), counts, stream of word numbers + 1 (0: end
    of a piece), its length, and the number of words."""
    schema = "chunk long, lang string, words long, length long, keys array<binary>, counts array<int>, stream binary"

    def closed(chunk, lang, held):
        numbers, parts, _ = held
        stream, order, counts = by_frequency(np.concatenate(parts), len(numbers), fixed=1)
        words = np.array([*numbers], object)[order][1:]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.array([lang], pa.string()), pa.array([int(counts[1:].sum())]), pa.array([len(stream)]),
             pa.array([list(words)], pa.list_(pa.binary())), pa.array([counts[1:]], pa.list_(pa.int32())),
             pa.array([pack(stream)], pa.binary())],
            names=["chunk", "lang", "words", "length", "keys", "counts", "stream"])

    def run(batches):
        next_chunk, open_ = TaskContext.get().partitionId() << 33, {}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts):
                held = open_.setdefault(lang, (Numbers(), [], [0]))
                numbers, parts, n = held
                for words in words_of(text.as_py()):
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    n[0] += len(words)
                if sum(h[2][0] for h in open_.values()) >= size:
                    lang = max(open_, key=lambda k: open_[k][2][0])
                    yield closed(next_chunk, lang, open_.pop(lang))
                    next_chunk += 1
        for lang, held in open_.items():
            yield closed(next_chunk, lang, held)
            next_chunk += 1

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).filter("text <> ''")
    return write_table(rows.mapInArrow(run, schema), "phrase-chunks")


def vocabulary(chunks: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(lang, word, f, id) of the words counted at least ``least`` times, and the largest id.
    Ids run through the partitions of the count in turn, so they are nearly gapless."""
    counts = (entries(chunks, "word", "lang").groupBy("lang", "word").agg(F.sum("n").alias("f"))
              .filter(F.col("f") >= least).withColumn("row", F.monotonically_increasing_id()))
    table = write_table(counts, "phrase-words")
    parts, last = table.agg(F.max(F.shiftright("row", 33)), F.max(F.col("row").bitwiseAND((1 << 33) - 1))).first()
    if parts is None:
        return table.withColumn("id", F.col("row")), 0
    at = F.col("row").bitwiseAND((1 << 33) - 1) * F.lit(parts + 1) + F.shiftright("row", 33) + 1
    return table.withColumn("id", at).drop("row"), (last + 1) * (parts + 1)


def phrase_counts(chunks: DataFrame, words: DataFrame, width: int, blocks: int, least: int) -> DataFrame:
    """(w1, w2, w3, a) of the phrases of two words (w3 = 0) and three counted at least ``least`` times."""
    layout = Layout(width)

    def count(batches):
        for batch in batches:
            for i in range(len(batch)):
                size, found = batch.column(1)[i].as_py(), batch.column(3)[i].values
                ids = np.zeros(size + 1, np.uint64)
                if found is not None:
                    ids[found.field(0).to_numpy().astype(np.int64) + 1] = found.field(1).to_numpy()
                stream = ids[unpack(batch.column(2)[i].as_py(), batch.column(0)[i].as_py())]
                a, b, c = stream[:-2], stream[1:-1], stream[2:]
                two, three = (stream[:-1] > 0) & (stream[1:] > 0), (a > 0) & (b > 0) & (c > 0)
                left, right = layout.pack(np.r_[stream[:-1][two], a[three]], np.r_[stream[1:][two], b[three]],
                                          np.r_[np.zeros(int(two.sum()), np.uint64), c[three]])
                made = list(layout.filters(*layout.counted(*layout.permute(left, right)), blocks))
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())],
                                                 names=["block", "filter"])

    def merge(batches):
        for table, unit in whole_units(batches, keys=1, rows=1):
            numbers, filters = table.column(0).to_pylist(), table.column(1)
            cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
            for x, y in zip(cut[:-1], cut[1:]):
                parts = [layout.read(filters[int(i)].as_py(), numbers[x], blocks) for i in range(x, y)]
                left, right, n = layout.counted(*(np.concatenate(p) for p in zip(*parts)))
                kept = n >= least
                ids = layout.unpack(*layout.restore(left[kept], right[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (*ids, n[kept])], names=["w1", "w2", "w3", "a"])

    ids = entries(chunks, "word", "lang").join(words.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "at", "id")
    streams = with_found(chunks.select("chunk", "length", F.size("keys").alias("size"), "stream"), ids)
    filters = streams.select("length", "size", "stream", "found").mapInArrow(count, "block int, filter binary")
    merged = filters.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "w1 long, w2 long, w3 long, a long")
    return write_table(merged, "phrase-counts")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase: of its cuts the lowest-scoring, the first of equals."""
    named = lambda i: words.select(F.col("id").alias(f"w{i}"), F.decode("word", "UTF-8").alias(f"t{i}"), F.col("f").alias(f"f{i}"))
    score = lambda l, r: F.expr(f"cast(cast(a as decimal(16)) * cast(a as decimal(16)) * 1000000 div "  # noqa: E731
                                f"(cast({l} as decimal(18)) * cast({r} as decimal(18))) as bigint)")
    two, three = phrases.filter("w3 = 0").drop("w3"), phrases.filter("w3 > 0")
    pair = lambda i, j, n: two.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{j}"), F.col("a").alias(n))
    lang = words.select(F.col("id").alias("w1"), "lang")
    pairs = (two.join(named(1).join(lang, "w1"), "w1").join(named(2), "w2")
             .select("lang", "w1", "w2", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a",
                     F.col("f1").alias("l"), F.col("f2").alias("r"), score("f1", "f2").alias("score")))
    cut = F.when(score("f1", "f23") <= score("f12", "f3"), F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), score("f1", "f23").alias("score")))
    cut = cut.otherwise(F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), score("f12", "f3").alias("score")))
    triples = (three.join(pair(1, 2, "f12"), ["w1", "w2"]).join(pair(2, 3, "f23"), ["w2", "w3"])
               .join(named(1).join(lang, "w1"), "w1").join(named(2).drop("f2"), "w2").join(named(3), "w3")
               .select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", cut.alias("cut"))
               .select("lang", "phrase", "a", "cut.*"))
    # a phrase of two words inside a phrase of three that is at least half as frequent goes
    longer = (three.select(F.col("w1").alias("w1"), F.col("w2").alias("w2"), F.col("a").alias("longer"))
              .unionAll(three.select(F.col("w2"), F.col("w3"), F.col("a"))).groupBy("w1", "w2").agg(F.max("longer").alias("longer")))
    kept = pairs.join(longer, ["w1", "w2"], "left").filter("longer is null or 100 * longer < 50 * a")
    return kept.select(*triples.columns).unionAll(triples)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of two and three words of each language: lang, rank, phrase, a (its
    count), l and r (the counts of its parts), n (words of the language) and score."""
    chunks = text_chunks(docs, chunk)
    total = chunks.agg(F.sum("words")).first()[0] or 0
    words, most = vocabulary(chunks, least)
    width = max(1, int(most).bit_length())
    blocks = max(0, math.ceil(math.log2(max(1, 2 * total / block))))
    found = write_table(scored(phrase_counts(chunks, words, width, blocks, least), words), "phrase-scores")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", "part").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    best = (found.withColumn("part", salt(F.col("phrase"), SALTS)).withColumn("at", F.row_number().over(part)).filter(F.col("at") <= top)
            .drop("part", "at").withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top))
    sizes = chunks.groupBy("lang").agg(F.sum("words").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
