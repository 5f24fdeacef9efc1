"""Token-id output in training order: fixed-stride binary shards.

Documents are numbered without gaps in reading order (a count per input partition gives the
offsets) and a keyed Feistel permutation with cycle-walking turns a document's number into
its slot in the training order. Consecutive ranges of slots are the shards. One shuffle
carries the texts to their shard, where they are encoded in slot order and packed, each
followed by the end id, into records of ``stride`` token ids of two bytes (little endian);
only the last record of a shard is padded, with the end id. A record is found by multiplication, so a
reader can start, stop and resume anywhere and reads forward.

A shard is written under a name of its own attempt and renamed when complete: a task that is
run again, or twice, replaces the file by an equal one. Files are written through the file
system of the target's URI, which must be reachable by all executors.

Defined results: a null text counts as empty and holds its end id only; null ids and repeated
rows are documents like others; an empty table gives an empty result and no shards. The order depends on the
key and on the layout of the input files. ``docs`` must be read from files (its partitions are
listed twice and must agree). Columns other than id and text are not read.
"""

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempest.llm.bpe import _codec, _shared
from tempest.llm.common import text_or_empty

#: token ids of a record, UTF-8 bytes of text meant for a shard, rounds of the permutation
STRIDE, SHARD_BYTES, FEISTEL_ROUNDS = 2048, 32 << 20, 6
#: characters of a text that is encoded at once
WHOLE = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, rounds: int = FEISTEL_ROUNDS) -> np.ndarray:
    """The place of each index under a keyed permutation of 0 .. n - 1. The Feistel network
    permutes a power of four of at most 4 n; places from n on walk along their cycle."""
    half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
    low = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int, int]:
    """(doc_id, text, at), the number of rows before each input partition, of all rows and of
    UTF-8 bytes. ``at`` holds the partition above its lower 33 bits, the row in them."""
    text = text_or_empty().cast("binary")
    at = F.monotonically_increasing_id()
    rows = docs.select("doc_id", text_or_empty().alias("text"), at.alias("at"))
    # one row per input partition
    counts = (docs.select(F.octet_length(text).alias("b"), at.alias("at"))
              .groupBy(F.shiftright("at", 33).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).collect())
    n = np.zeros(max((r["p"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        n[r["p"]] = r["n"]
    return rows, np.cumsum(n) - n, int(n.sum()), sum(r["b"] for r in counts)


class ShardWriter:
    """One shard: ids are appended, whole records leave for the file."""

    def __init__(self, fs, folder: str, shard: int, stride: int, end: int):
        self.fs, self.stride, self.end, self.tokens = fs, stride, end, 0
        self.path = f"{folder}/shard-{shard:06d}.bin"
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.draft)

    def append(self, ids: bytes) -> None:
        self.out.write(ids)
        self.tokens += len(ids) // 2

    def close(self) -> None:
        self.out.write(np.full(-self.tokens % self.stride, self.end, "<u2").tobytes())
        self.out.close()
        try:
            self.fs.move(self.draft, self.path)
        except OSError:  # file systems that don't replace
            self.fs.delete_file(self.path)
            self.fs.move(self.draft, self.path)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.draft)


@lru_cache(maxsize=2)
def _encoder(spec: str, pattern: str) -> tiktoken.Encoding:
    ranks = {token: i for i, token in enumerate(_codec(spec, pattern).token_bytes) if token}
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def packed_ids(text: str, codec, encoder: tiktoken.Encoding):
    """The ids of a text as little-endian bytes; long texts in slices of pieces."""
    if len(text) <= WHOLE:
        yield np.array(encoder.encode_ordinary(text), "<u2").tobytes()
        return
    for some in codec.entries(text):
        yield b"".join([e[2] for e in some])


def write_shards(docs: DataFrame, target: str, ranks_path: str, pattern: str, key: int = 1, stride: int = STRIDE,
                 shard_bytes: int = SHARD_BYTES, end: int | None = None) -> DataFrame:
    """Write the shards under ``target`` when evaluated; one row per document: doc_id, slot,
    shard, first_token (in its shard), n_tokens (with the end id), tokens_crc32."""
    rows, before, n, size = numbered(docs)
    shards = max(1, -(-size // shard_bytes))
    spec = _shared(docs, ranks_path)
    offsets = docs.sparkSession.sparkContext.broadcast(before)  # eight bytes an input partition

    @F.pandas_udf("long")
    def slot(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series(permute(offsets.value[at >> 33] + (at & (1 << 33) - 1), n, key))

    placed = rows.withColumn("slot", slot("at")) if n else rows.withColumn("slot", F.col("at"))
    shard = F.floor(F.col("slot") * F.lit(shards) / F.lit(max(1, n))).cast("int")
    dealt = (placed.select("doc_id", "text", "slot", shard.alias("shard"))
             .repartitionById(shards, "shard").sortWithinPartitions("slot"))  # one shard a task

    def run(batches):
        codec, writer, now = _codec(spec.value, pattern), None, None
        stop = len(codec.token_bytes) if end is None else end
        if stop > 0xFFFF:
            raise ValueError("ids of a record have two bytes; the end id is larger")
        last, encoder = stop.to_bytes(2, "little"), _encoder(spec.value, pattern)
        fs, folder = pyarrow.fs.FileSystem.from_uri(target)
        fs.create_dir(folder, recursive=True)
        try:
            for batch in batches:
                first, count, crc = [], [], []
                for text, s in zip(batch.column(1), batch.column(3).to_pylist()):
                    if s != now:
                        if writer:
                            writer.close()
                        writer, now = ShardWriter(fs, folder, s, stride, stop), s
                    first.append(writer.tokens)
                    check = 0
                    for ids in packed_ids(text.as_py(), codec, encoder):
                        check = zlib.crc32(ids, check)
                        writer.append(ids)
                    writer.append(last)
                    count.append(writer.tokens - first[-1])
                    crc.append(zlib.crc32(last, check))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), batch.column(3), *[pa.array(x, pa.int64()) for x in (first, count, crc)]],
                    names=["doc_id", "slot", "shard", "first_token", "n_tokens", "tokens_crc32"])
        except BaseException:
            if writer:
                writer.drop()
            raise
        if writer:
            writer.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, slot long, shard int, first_token long, n_tokens long, tokens_crc32 long")


def read_records(target: str, shard: int, first: int, count: int, stride: int = STRIDE) -> np.ndarray:
    """``count`` records of a shard from record ``first``, one row each."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(target)
    with fs.open_input_file(f"{folder}/shard-{shard:06d}.bin") as f:
        f.seek(first * stride * 2)
        return np.frombuffer(f.read(count * stride * 2), "<u2").reshape(-1, stride)
