"""SimHash near-deduplication with BK-trees.

Fingerprints are 64 bits, the majority over all word shingles of a text. Equal fingerprints
are one node. Two nodes at most ``radius`` bits apart agree on at least two of ``radius + 2``
blocks of bits, so nodes are dealt by every pair of blocks; of the nodes that share a pair,
shard trees of at most ``TREE`` nodes are built (children keyed by their Hamming distance to
the parent), shipped to the blocks of queries of the same key, and searched along the edges
within the radius only. A key held by many nodes becomes several trees met by several query
blocks, each pair of them a unit of work of its own, so no task holds an unbounded group and
no candidate is dropped. A unit returns a spanning set of its links, not all its pairs, and
the components of those links are the groups.

Defined results: a null text counts as empty; texts without words have fingerprint zero and
are linked like any other; shorter texts than a shingle are one shingle; null ids are
ordinary rows and never the smallest id unless a group has no other; repeated rows share all
results; an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm.common import SALTS, all_salts, salt, whole_units, write_table
from tempest.llm.components import connected_components, spanning

#: nodes of a shard tree, and of a block of queries
TREE = 1024
#: rows of units searched together in a task at least; queries followed at once
ROWS, QUERIES = 65536, 8192
#: shingles hashed together, so that a text of any length needs bounded memory
PART = 65536

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """Bit set where over half the XXH64 of all word shingles have it set."""
    words = text.lower().split()  # bytes: only A-Z and the six ASCII white-space characters
    if not words:
        return 0
    joined, k = b" ".join(words), min(words_per_shingle, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends, digest = (ends - lens)[:len(words) - k + 1], ends[k - 1:], xxhash.xxh64_digest
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, len(starts), PART):
        some = b"".join([digest(joined[a:b], seed) for a, b in
                         zip(starts[at:at + PART].tolist(), ends[at:at + PART].tolist())])
        by_byte = np.frombuffer(some, np.uint8).reshape(-1, 8) + (np.arange(8) * 256)
        counts += np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ BYTE_BITS).ravel() * 2 > len(starts)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """The columns of ``docs`` and ``fp``, the fingerprint as a signed long."""
    if "fp" in docs.columns:
        docs = docs.drop("fp")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode(), words_per_shingle, seed) for t in batch.column(at)]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def block_keys(fp: Column, radius: int) -> Column:
    """The struct (t, key) of each pair t of radius + 2 blocks."""
    cuts = np.linspace(0, 64, radius + 3).astype(int)
    masks = [int((((1 << int(b)) - 1) ^ ((1 << int(a)) - 1)) & (2**64 - 1)) for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("key"))
                     for t, (i, j) in enumerate(combinations(range(radius + 2), 2))])


class Forest:
    """BK-trees, one per unit: unit[i] and code[i] of each node, nodes of a unit in a row."""

    def __init__(self, unit: np.ndarray, code: np.ndarray):
        self.code = code
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
        self.units, self.roots = unit[first], first
        root_of = np.repeat(first, np.diff(np.r_[first, len(unit)]))
        todo = np.setdiff1d(np.arange(len(unit)), first, assume_unique=True)
        at, keys, kids = root_of[todo], [], []
        while len(todo):  # each round inserts one level of every tree
            key = at * 128 + np.bitwise_count(code[todo] ^ code[at])
            found, where, which = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            kids.append(todo[where])
            rest = np.ones(len(todo), bool)
            rest[where] = False
            at, todo = todo[where][which][rest], todo[rest]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.kids = np.concatenate(kids) if kids else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.kids = self.keys[order], self.kids[order]

    def search(self, unit: np.ndarray, code: np.ndarray, radius: int):
        """Yield (query index, node index) within the radius."""
        place = np.searchsorted(self.units, unit)
        place[place == len(self.units)] = 0
        known = np.flatnonzero(self.units[place] == unit) if len(self.units) else np.zeros(0, np.int64)
        for i in range(0, len(known), QUERIES):
            q = known[i:i + QUERIES]
            node = self.roots[place[q]]
            while len(q):
                d = np.bitwise_count(code[q] ^ self.code[node]).astype(np.int64)
                hit = d <= radius
                yield q[hit], node[hit]
                lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.keys, node * 128 + d + radius, side="right")
                n = hi - lo
                q = np.repeat(q, n)
                step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                node = self.kids[np.repeat(lo, n) + step]


def unit_links(unit: np.ndarray, role: np.ndarray, code: np.ndarray, radius: int):
    """Links of whole units (rows sorted by unit): role 0 is tree and query, 1 tree, 2 query."""
    tree, ask = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    forest, a, b = Forest(unit[tree], code[tree]), [], []
    for q, node in forest.search(unit[ask], code[ask], radius):
        x, y = ask[q], tree[node]
        other = code[x] != code[y]
        a.append(x[other])
        b.append(y[other])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    label = spanning(len(code), a, b)
    far = np.flatnonzero(label != np.arange(len(code)))
    return code[far].view(np.int64), code[label[far]].view(np.int64)


def near_links(nodes: DataFrame, radius: int = 4, tree: int = TREE) -> DataFrame:
    """Links (u, v) that span the groups of the distinct fingerprints ``fp``."""
    dealt = nodes.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("b")).select("fp", "b.t", "b.key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(tree)).cast("int")
    held = (dealt.join(sizes, ["t", "key"]).withColumn("parts", parts)
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    # unit (a, b), a <= b: the tree of part a meets the queries of part b
    units = held.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1)
                        .otherwise(2).alias("role"), "fp")
    cols = ["t", "key", "a", "b"]
    units = units.repartition(*cols).sortWithinPartitions(*cols)

    def run(batches):
        for rows, unit in whole_units(batches, 4, ROWS):
            u, v = unit_links(unit, rows.column(4).to_numpy(), rows.column(5).to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return units.mapInArrow(run, "u long, v long")


def rooted(nodes: DataFrame, radius: int = 4, tree: int = TREE) -> DataFrame:
    """The columns of nodes (fp, first) and ``root``, the smallest fingerprint of the group."""
    roots = connected_components(near_links(nodes, radius, tree))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(rows: DataFrame, radius: int = 4, tree: int = TREE) -> DataFrame:
    """(fp, component_id) of every fingerprint of rows (doc_id, fp)."""
    owned = rooted(write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes"), radius, tree)
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    return owned.join(least, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (hex), component_id."""
    rows = write_table(fingerprints(docs.select("doc_id", "text"), words_per_shingle, seed).drop("text"), "simhash-rows")
    groups = write_table(near_groups(rows, radius), "simhash-groups")
    # one fingerprint may be that of a third of all rows: both sides carry a salt
    return (rows.withColumn("salt", salt(F.col("doc_id"), SALTS))
            .join(all_salts(groups, "salt", SALTS), ["fp", "salt"])
            .select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Exactly one row of each group, columns unchanged: the one with the smallest id (null
    last), then the smallest fingerprint, hash of the text and row number. Rows are known by
    their number in the written table, as ids may be null or repeated."""
    own = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)])
    rows = write_table(fingerprints(own, words_per_shingle, seed).withColumn("_row", F.monotonically_increasing_id()),
                       "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", F.xxhash64("text").alias("hash"), "_row")
    nodes = rows.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    owned = write_table(rooted(write_table(nodes, "simhash-nodes"), radius), "simhash-roots")
    stays = (owned.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
             .select("root", F.col("first._row").alias("stays")))
    groups = write_table(owned.join(stays, "root").select("fp", "stays"), "simhash-groups")
    # one fingerprint may be that of a third of all rows: both sides carry a salt
    gone = (rows.select("fp", "_row").withColumn("salt", salt(F.col("_row"), SALTS))
            .join(all_salts(groups, "salt", SALTS), ["fp", "salt"]).filter("_row != stays").select("_row"))
    return rows.join(gone, "_row", "left_anti").select(*own.columns).toDF(*docs.columns)
