"""Alignment of two tokenizers' tokens over the same bytes.

Every text is encoded by a byte-level BPE tokenizer (A, over a space and the text; merges by the ranks
its vocabulary numbers give, which is how its merges are listed) and by a sentencepiece model
(B, which adds the space itself). Token lengths in bytes sum to ends; those of B become a
dictionary from end to index, which A's ends probe in ascending order, and the common ends
slice both id lists into groups. Inside each slice the tokens whose byte ranges overlap are
linked: between two neighbouring ends of either side lies exactly one link, so a slice of m
and n tokens has m + n - 1.

Links are counted over the corpus in chunks (``chunks``): texts are encoded once, a chunk
keeps its links as numbers of its own distinct id pairs, the counts of a pair meet in one
aggregation, and each chunk gets the totals of its pairs by a join. A pair of any frequency
is one row per chunk. Broadcast are the two tokenizers and one number per B id, which the
vocabulary bounds.

Defined results: texts that are null or empty, or whose tokens don't give back the bytes of
a space and the text, have no tokens: zeros and an empty digest; special tokens' strings are
plain text; a null id is carried; repeated rows count their links each time; texts of any
length are encoded whole; an empty table gives an empty result. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from tempest.llm.bpe import byte_characters
from tempest.llm.chunks import by_frequency, entries, pack, unpack, with_found
from tempest.llm.common import write_table

#: links and documents per chunk
CHUNK, CHUNK_DOCS = 2_000_000, 50_000
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def piece_bytes(piece: str) -> bytes:
    m = BYTE.fullmatch(piece)
    return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, spec: str, pattern: str, model: bytes):
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = json.loads(spec)["model"]["vocab"]
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_lens, self.b_lens = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        # the text of an id with what follows it: "," inside a group, "|" or ";" after its side
        self.names = [f"{i}{end}" for ids, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(ids)) for end in ends]

    def encode(self, text: str | None):
        """Ids of both sides; none where either doesn't give back the bytes."""
        if text:
            whole = (" " + text).encode()
            a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
                return np.array(a, np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray):
        """(ends of A's tokens, of B's, index of each group's last token in A, in B)."""
        ends_a, ends_b = np.cumsum(self.a_lens[a]), np.cumsum(self.b_lens[b])
        at_b = dict(zip(ends_b.tolist(), range(len(b))))
        met = np.fromiter(map(at_b.get, ends_a.tolist(), repeat(-1)), np.int64, len(a))
        common = np.flatnonzero(met >= 0)
        return ends_a, ends_b, common, met[common]

    def links(self, a, b, ends_a, ends_b):
        """The linked ids: one link up to each distinct end of the two sides."""
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
        return a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)]

    def text(self, a, b, cut_a, cut_b) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups in order."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a] = last_b[cut_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # before a token of A stand all earlier groups of B, before one of B also its own group of A
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.r_[0, cut_b + 1][group_a]] = 2 * a + last_a
        out[np.arange(len(b)) + (cut_a + 1)[group_b]] = 2 * (len(self.a_bytes) + b) + last_b
        return "".join(map(self.names.__getitem__, out.tolist()))[:-1]


@lru_cache(maxsize=1)
def _aligner(spec: str, pattern: str, model: bytes) -> Aligner:
    return Aligner(spec, pattern, model)


def _shared(df: DataFrame, a_path: str, b_path: str):
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return df.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def aligned(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """doc_id and its groups in full: a_ids, b_ids, and of each group the index of its last
    token on either side (a_last, b_last)."""
    spec = _shared(docs, a_path, b_path)
    names = ["a_ids", "b_ids", "a_last", "b_last"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])

    def run(batches):
        of = _aligner(spec.value[0], pattern, spec.value[1])
        for batch in batches:
            rows = []
            for text in batch.column(1):
                a, b = of.encode(text.as_py())
                rows.append((a, b, *of.groups(a, b)[2:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(4)]],
                                             names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def link_chunks(docs: DataFrame, a_path: str, pattern: str, b_path: str, size: int) -> tuple[DataFrame, int]:
    """Chunks: per document its figures, and the chunk's links as numbers of its distinct
    pairs (keys: A id times the size of B's vocabulary plus B id); and that size."""
    spec = _shared(docs, a_path, b_path)
    id_type = docs.schema["doc_id"].dataType
    fields = [("n_a", "array<long>"), ("n_b", "array<long>"), ("n_groups", "array<long>"), ("n_links", "array<long>"),
              ("groups_sha256", "array<string>"), ("length", "long"), ("keys", "array<long>"), ("counts", "array<int>"), ("stream", "binary")]
    schema = f"chunk long, doc_id array<{id_type.simpleString()}>, " + ", ".join(f"{n} {t}" for n, t in fields)
    base = SentencePieceProcessor(model_proto=spec.value[1]).get_piece_size()

    def closed(chunk, ids, figures, links):
        stream, pairs = pd.factorize(np.concatenate(links))
        stream, order, counts = by_frequency(stream, len(pairs))
        columns = [pa.array([[f[k] for f in figures]], pa.list_(pa.string() if k == 4 else pa.int64())) for k in range(5)]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(figures)], pa.int32()), pa.concat_arrays(ids)), *columns,
             pa.array([len(stream)]), pa.array([pairs[order]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
             pa.array([pack(stream)], pa.binary())], names=["chunk", "doc_id", *[n for n, _ in fields]])

    def run(batches):
        of = _aligner(spec.value[0], pattern, spec.value[1])
        chunk, ids, figures, links, held = TaskContext.get().partitionId() << 33, [], [], [], 0
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(1)):
                a, b = of.encode(text.as_py())
                if len(a):
                    ends_a, ends_b, cut_a, cut_b = of.groups(a, b)
                    one, two = of.links(a, b, ends_a, ends_b)
                    figures.append((len(a), len(b), len(cut_a), len(one), hashlib.sha256(of.text(a, b, cut_a, cut_b).encode()).hexdigest()))
                    links.append(one * base + two)
                    held += len(one)
                else:
                    figures.append((0, 0, 0, 0, ""))
                if held >= size or len(figures) >= CHUNK_DOCS:
                    ids.append(batch.column(0).take(pa.array(range(first, i + 1))))
                    yield closed(chunk, ids, figures, links or [np.zeros(0, np.int64)])
                    first, chunk, ids, figures, links, held = i + 1, chunk + 1, [], [], [], 0
            if first < len(batch):
                ids.append(batch.column(0).take(pa.array(range(first, len(batch)))))
        if figures:
            yield closed(chunk, ids, figures, links or [np.zeros(0, np.int64)])

    return write_table(docs.select("doc_id", "text").mapInArrow(run, schema), "token-links"), base


def pair_counts(chunks: DataFrame, base: int) -> DataFrame:
    """(pair, count, best): the links of each id pair in the corpus, and whether no other A id
    is linked more often to its B id."""
    counts = write_table(entries(chunks, "pair").groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    counts = counts.withColumn("b", F.col("pair") % base)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most one row per B id
    return counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, pattern: str, b_path: str, size: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    its B id's commonest), count_sum (of the pairs' counts over the links), groups_sha256."""
    chunks, base = link_chunks(docs, a_path, pattern, b_path, size)
    # one number per entry: twice the count, and one more where it is the best
    value = (F.col("count") * 2 + F.col("best").cast("long")).alias("value")
    found = entries(chunks, "pair").join(pair_counts(chunks, base), "pair").select("chunk", "at", value)
    figures = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = with_found(chunks.select("chunk", *figures, "length", "stream"), found).select(*figures, "length", "stream", "found")
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in longs], T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                lists = [batch.column(k)[i].values for k in range(6)]
                data, n, found = batch.column(7)[i].as_py(), batch.column(6)[i].as_py(), batch.column(8)[i].values
                best = total = np.zeros(1, np.int64)
                if n:
                    values = np.empty(len(found), np.int64)
                    values[found.field(0).to_numpy()] = found.field(1).to_numpy()
                    of = values[unpack(data, n)]
                    best, total = np.r_[0, np.cumsum(of & 1)], np.r_[0, np.cumsum(of >> 1)]
                end = np.cumsum(lists[4].to_numpy())
                start = np.r_[0, end[:-1]]
                sums = [pa.array(best[end] - best[start]), pa.array(total[end] - total[start])]
                yield pa.RecordBatch.from_arrays([lists[0], *lists[1:5], *sums, lists[5]], names=schema.names)

    return rows.mapInArrow(run, schema)
