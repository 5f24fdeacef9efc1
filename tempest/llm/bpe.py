"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

The tokenizer is made on the driver from a rank file (token bytes and rank per line): every
byte maps to a printable character, the merges are recovered from the ranks, and the
finished tokenizer, whose size is that of the vocabulary, is broadcast. A text is split by
the pattern and its pieces are encoded one by one; a bounded table of pieces already met is
kept per worker. Nothing is shuffled, so rows stay where they were read.

Decoding turns token characters back into bytes by the reversed table. Tokens may end inside
a character: a token's offsets cover every character it touches, whole decodes join the
bytes first, and ``StreamDecoder`` holds back an unfinished character between slices.

Defined results: a null text counts as empty and has no tokens; a null id is carried;
repeated rows give repeated results; texts of any length are encoded whole, those over
``LONG`` characters in slices of pieces; an empty table gives an empty result. Columns
other than those named are not read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import struct
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: the pieces kept per worker, and the longest piece kept
KEPT_PIECES, KEPT_CHARS = 250_000, 48
#: texts over this many characters are split in slices of pieces
LONG, SLICE = 1_000_000, 100_000


def byte_characters() -> list[str]:
    """The character of each byte: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes the token: merge its bytes by rank below its own."""
    parts, own = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:])]
        i = min(range(len(pairs)), key=pairs.__getitem__)
        if pairs[i] >= own:
            raise ValueError(f"token {token!r} can't be made by merges of lower rank")
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizer over single pieces of mapped characters: merges by rank."""
    from tokenizers import Tokenizer, models

    chars = byte_characters()
    name = lambda token: "".join(chars[b] for b in token)
    merges = [tuple(map(name, last_merge(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tok = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, merges))
    return tok.to_str()


class Pieces(dict):
    """Encoded pieces as (ids, ids as text, ids as little-endian bytes, two each where the
    vocabulary allows, else four): a piece is mapped from bytes to characters and merged by
    the tokenizer's model; short ones are kept until the table is full."""

    def __init__(self, model, wide: bool):
        self.model, self.map, self.code = model, dict(enumerate(byte_characters())), "I" if wide else "H"

    def __missing__(self, piece: str):
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.map))
        ids = tuple([t.id for t in tokens])
        entry = ids, " ".join(map(str, ids)), struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(piece) <= KEPT_CHARS and len(self) < KEPT_PIECES:
            self[piece] = entry
        return entry


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, spec: str, pattern: str):
        from tokenizers import Tokenizer

        self.tok, self.pattern = Tokenizer.from_str(spec), regex.compile(pattern)
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(spec)["model"]["vocab"]
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        self.kept = Pieces(self.tok.model, len(self.token_bytes) > 1 << 16)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte[c] for c in token)

    def slices(self, text: str):
        """The pieces of a text; those of a long one in slices."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while some := [m[0] for m in islice(found, SLICE)]:
            yield some

    def entries(self, text: str):
        kept = self.kept
        for pieces in self.slices(text):
            yield [kept[p] for p in pieces]

    def encode(self, text: str) -> list[int]:
        return [i for some in self.entries(text) for e in some for i in e[0]]

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Characters each token touches; a split character belongs to all its tokens."""
        owner = [i for i, ch in enumerate(text) for _ in range(len(ch.encode()))]
        out, at = [], 0
        for i in ids:
            end = at + len(self.token_bytes[i])
            out.append((owner[at], owner[end - 1] + 1))
            at = end
        return out

    def decode_bytes(self, ids) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        """Text of the ids; bytes that form no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


class StreamDecoder:
    """Decode ids slice by slice; an unfinished character waits for the next slice."""

    def __init__(self, codec: Codec):
        self.codec, self.inner = codec, codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.inner.decode(self.codec.decode_bytes(ids), last)


@lru_cache(maxsize=2)
def _codec(spec: str, pattern: str) -> Codec:
    return Codec(spec, pattern)


def _shared(df: DataFrame, ranks_path: str):
    """The tokenizer as a broadcast text; its size is the vocabulary's."""
    return df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True,
                     offsets: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes the
    ids decode to), with ``ids`` the token ids and with ``offsets`` each token's characters."""
    spec = _shared(docs, ranks_path)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if offsets:
        fields += [T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]

    def run(batches):
        codec = _codec(spec.value, pattern)
        for batch in batches:
            counts, id_shas, byte_shas, id_rows, spans = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, names, data, row = 0, hashlib.sha256(), hashlib.sha256(), []
                for some in codec.entries(text):
                    found = list(chain.from_iterable([e[0] for e in some]))
                    if found:
                        names.update(((" " if n else "") + " ".join([e[1] for e in some])).encode())
                    data.update(codec.decode_bytes(found))
                    n += len(found)
                    if ids or offsets:
                        row += found
                counts.append(n)
                id_shas.append(names.hexdigest())
                byte_shas.append(data.hexdigest())
                if ids:
                    id_rows.append(pa.array(row, pa.int32()))
                if offsets:
                    spans.append(codec.offsets(text, row))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_shas, pa.string()), pa.array(byte_shas, pa.string())]
            if ids:
                ends = [0]
                for r in id_rows:
                    ends.append(ends[-1] + len(r))
                flat = pa.concat_arrays(id_rows) if id_rows else pa.array([], pa.int32())
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            if offsets:
                out += [pa.array([[s[k] for s in row] for row in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def decode_documents(rows: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the text of its ``ids`` (null ids count as none)."""
    spec = _shared(rows, ranks_path)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        codec = _codec(spec.value, "")
        for batch in batches:
            texts = [codec.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, schema)
