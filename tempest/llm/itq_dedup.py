"""Embedding near-deduplication by iterative quantisation.

Several rotations are learned, each from another random start, on a bounded sample: a
rotation alternates between the signs of the rotated vectors and the orthogonal matrix that
fits them best, so its bits are balanced and near the vectors. A code is the bits of all
rotations. Multi-index Hamming tables hold substrings of the code: vectors that agree on one
whole substring (under equal label and length) are candidates, and all of them are reranked
by the cosine of the original vectors in double precision.

Equal vectors are one class with a multiplicity. The classes of a table key are dealt into
blocks, and every pair of blocks is a unit of work of bounded size. A pair is judged in the
first table where its substrings agree, so links are counted without collecting pairs, and a
unit returns per class its links and the smallest class it is joined to.

Only pairs of cosine >= the threshold are ever linked. Pairs missed are those that differ in
every table. Signs are of centred vectors, so the share of bits in which a pair at the
threshold differs is derived from the distances of the sample to its mean: at cosine 0.93
12 % about a mean of zero, the more the larger the common component. Every length of substrings
has a number of tables that misses at most ``MISSED`` (at 12 %, (1 - 0.88 ** 8) ** 16 = 0.1 %);
of these the cheapest for the number of vectors a vector may meet is taken. So substrings grow
by about a bit and tables by a seventh when that number doubles (at 12 %), and the pairs judged
grow a little faster than the vectors instead of with their square; at 22 % (a mean of squared
norm 0.7) with a power of 1.4 to 1.65. Where a strong common component
asks for over ``MOST`` tables and these would cost more than all pairs (``layout``), all pairs
of the length are judged, in blocks; with more vectors the tables win again. All pairs are also
judged in lengths too short for a table and all but the ``FITTED`` commonest. tests/llm
measures the recall against brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and those of null label, link with nothing; vectors of different length do not link; null
ids are ordinary rows that count as links but are nobody's component unless alone; repeated
rows are equal vectors; an empty table gives an empty result; labels may have any type that
can be grouped and are equal as such. Columns other than vec_id,
embedding and label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm.common import all_salts, salt, whole_units, write_table
from tempest.llm.components import connected_components, spanning

#: vectors a rotation is fitted on, rounds of the fit
SAMPLE, ROUNDS = 8192, 25
#: bits of a substring: at least where the vectors allow it, and at most
SHORT, LONG = 8, 24
#: tables that are taken whatever they cost
MOST = 100
#: judged pairs that cost as much as one row of a table, and as one more key in it
ROW, KEY = 32, 0.125
#: share of pairs at the threshold that differ in every table, at most
MISSED = 0.001
#: vector lengths with rotations of their own; all pairs of any other length are judged
FITTED = 64
#: classes of a block; rows judged together; pairs reranked at once
BLOCK, ROWS, PAIRS = 1024, 16384, 65536


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Orthogonal d x d matrix: principal axes, then alternating signs and rotation."""
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1].T  # d x d
    v = x @ axes.T
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes.T @ r


def differing(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Per unit vector, the share of bits in which a pair at the threshold differs whose
    vectors are both as far from the mean."""
    apart = np.maximum(((sample - sample.mean(0)) ** 2).sum(1), 1e-12)
    return np.arccos(np.clip(1 - (1 - threshold) / apart, -1, 1)) / np.pi


def tables_needed(differ: np.ndarray, width: int) -> int:
    """Least number of tables of ``width`` bits that miss at most ``MISSED``; 0 if more than
    half as many as there are keys are needed."""
    alone, most = 1 - (1 - differ) ** width, 2 ** width // 2
    if not most or (alone ** most).mean() > MISSED:
        return 0
    low = 0  # too few
    while most - low > 1:
        mid = (low + most) // 2
        low, most = (low, mid) if (alone ** mid).mean() <= MISSED else (mid, most)
    return most


def layout(differ: np.ndarray, partners: float, longest: int) -> tuple[int, int]:
    """(width, tables) for vectors that each may meet ``partners`` others: the cheapest of at
    least ``SHORT`` bits, else the longest there is; (0, 1), one key for all, if there is none
    or it has over ``MOST`` tables and costs more than all pairs."""
    cost, short = {}, (0, 1)
    for w in range(1, min(longest, LONG) + 1):
        t = tables_needed(differ, w)
        if t and w < SHORT:
            short = w, t
        elif t:
            cost[w, t] = t * (ROW + KEY * t + partners / 2 ** (w + 1))
    if not cost:
        return short
    w, t = min(cost, key=cost.get)
    return (0, 1) if t > MOST and cost[w, t] >= ROW + partners / 2 else (w, t)


class Quantiser:
    """Mean and rotations of one vector length; codes and table keys."""

    def __init__(self, sample: np.ndarray, partners: float, threshold: float):
        d = sample.shape[1]
        self.width, tables = layout(differing(sample, threshold), partners, d // 2)  # bits of half the axes hardly depend on one another
        self.mean, self.starts = sample.mean(0), []
        if not self.width:
            return
        per = d // self.width
        turns = [learn_rotation(sample - self.mean, seed) for seed in range(-(-tables // per))]
        self.turn = np.hstack(turns)
        self.starts = [r * d + i * self.width for r in range(len(turns)) for i in range(per)][:tables]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Keys by table."""
        if not self.width:
            return np.zeros((len(x), 1), np.int32)
        bits = ((x - self.mean) @ self.turn >= 0).astype(np.uint8)
        weight = 1 << np.arange(self.width)
        return np.stack([bits[:, s:s + self.width] @ weight for s in self.starts], 1).astype(np.int32)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable vector of a label: id, label, dim, embedding, copies."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = (F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    return (vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
            .filter(usable).groupBy("label", "embedding")
            .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
            .withColumn("dim", F.size("embedding")))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(classes: DataFrame, threshold: float, sample: int) -> dict[int, Quantiser]:
    """A quantiser of each of the ``FITTED`` commonest vector lengths, on the ``sample``
    vectors with the smallest hash, for the number of classes that share a vector's label."""
    out, n = {}, F.col("n").cast("double")
    sizes = (classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim")
             .agg(F.sum("n").alias("count"), (F.sum(n * n) / F.sum(n)).alias("partners")).filter("count > 1"))
    for r in sizes.orderBy(F.desc("count"), "dim").limit(FITTED).collect():
        got = classes.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("embedding")).limit(sample).select("embedding").toArrow()
        out[r["dim"]] = Quantiser(unit_vectors(_matrix(got.column(0), r["dim"])), r["partners"], threshold)
    return out


def judge(unit, role, x, keys, table, copies, threshold: float):
    """Links within units: (index of the class, links, index of the smallest class joined)."""
    n = len(unit)
    end = np.searchsorted(unit, unit, side="right")
    links, a, b = np.zeros(n, np.int64), [], []
    left = np.arange(n)
    for step in range(1, int((end - left).max()) if n else 0):
        left = left[left + step < end[left]]
        for at in range(0, len(left), PAIRS):
            i = left[at:at + PAIRS]
            j = i + step
            ok = (role[i] == 0) & (role[j] == 0) | (role[i] + role[j] == 3)
            i, j = i[ok], j[ok]
            first = (keys[i] == keys[j]).argmax(1) == table[i]  # judged once, in the first table
            i, j = i[first], j[first]
            close = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            a.append(i[close])
            b.append(j[close])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    label = spanning(n, a, b)
    found = np.flatnonzero(links)
    return found, links[found], label[found]


def numbered_labels(classes: DataFrame) -> DataFrame:
    """The classes with a whole number for each label: its own if it is one."""
    if isinstance(classes.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return classes.withColumn("label", F.col("label").cast("long"))
    names = write_table(classes.select("label").distinct().withColumn("_number", F.monotonically_increasing_id()), "itq-labels")
    return classes.join(names, "label").drop("label").withColumnRenamed("_number", "label")


def class_links(classes: DataFrame, threshold: float, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(id, links, low) per class and unit with a link: links to other classes' vectors, and
    a class of the same component."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(fit(classes, threshold, sample))  # d x d matrices
    schema = "id long, label long, dim int, x array<double>, copies long, keys array<int>"

    def code(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                x = unit_vectors(_matrix(rows.column(3), d))
                n = len(rows)
                keys = shared.value[d].keys(x) if d in shared.value else np.zeros((n, 1), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(2),
                     pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), x.ravel()), rows.column(4),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())],
                    names=["id", "label", "dim", "x", "copies", "keys"])

    coded = write_table(classes.select("id", "label", "dim", "embedding", "copies").mapInArrow(code, schema), "itq-codes")
    at = ["label", "dim", "t", "key"]
    dealt = coded.select("*", F.posexplode("keys").alias("t", "key"))
    # keys held by more classes than a block: at most classes * tables / block of them
    sizes = (coded.select("label", "dim", F.posexplode("keys").alias("t", "key")).groupBy(*at)
             .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
             .select(*at, F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    held = (dealt.join(write_table(sizes, "itq-sizes"), at, "left").withColumn("parts", parts)
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    cols = [*at, "a", "b"]
    # unit (a, b), a <= b: the classes of part a meet those of part b
    role = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    units = held.select(*at, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                        role.alias("role"), "id", "copies", "x", "keys")
    units = units.repartition(*cols).sortWithinPartitions(*cols)

    def links(batches):
        for rows, unit in whole_units(batches, 6, ROWS):
            dims = rows.column("dim").to_numpy()
            for d in np.unique(dims):
                some = rows.filter(pa.array(dims == d))
                number = lambda c: some.column(c).to_numpy().astype(np.int64)
                keys = some.column("keys").combine_chunks().flatten().to_numpy().reshape(len(some), -1)
                ids = number("id")
                found, n, low = judge(unit[dims == d], number("role"), _matrix(some.column("x"), d), keys,
                                      number("t"), number("copies"), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(n), pa.array(ids[low])],
                                                 names=["id", "links", "low"])

    return units.mapInArrow(links, "id long, links long, low long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    # classes are numbered, as several may have no id
    classes = write_table(classes_of(vectors).withColumn("id", F.monotonically_increasing_id()), "itq-classes")
    found = write_table(class_links(numbered_labels(classes), threshold, sample, block), "itq-links")
    n = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    owned = (classes.join(n, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
             .select("label", "embedding", "vec_id", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                     F.coalesce("root", "id").alias("root")))
    least = owned.groupBy("root").agg(F.min("vec_id").alias("component"))
    digest = F.xxhash64("label", "embedding").alias("digest")
    info = write_table(owned.join(least, "root").select(
        "label", "embedding", "vec_id", "copies", digest, (F.col("links") + F.col("copies") - 1).alias("n"), "component"), "itq-info")
    alone = (F.col("copies") == 1) & F.col("vec_id").isNotNull()
    # one vector may be that of a third of all rows: the membership of copies carries a salt
    copied = all_salts(info.filter(~alone).select("label", "embedding", F.col("n").alias("n_c"),
                                                  F.col("component").alias("component_c")), "salt")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    joined = (rows.withColumn("digest", digest).withColumn("salt", salt(F.col("vec_id")))
              .join(copied, ["label", "embedding", "salt"], "left").drop("embedding")
              .join(info.filter(alone).select("vec_id", "digest", "n", "component"), ["vec_id", "digest"], "left"))
    component = F.coalesce("component_c", "component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_c", "n", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
