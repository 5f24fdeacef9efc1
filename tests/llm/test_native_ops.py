"""Exact dedup, sharding and mixing against plain Python."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tempest.llm import sharding
from tempest.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tempest.llm.mixing import mix, repeat_documents
from tempest.llm.sharding import least_loaded, shard_documents

SMOKE = "/root/testdata/sf0.001"
AWKWARD = [(3, "a b"), (1, "ab"), (2, "a  b "), (4, None), (5, ""), (6, " \t"), (7, "AB"), (None, "zz"), (None, None),
           (8, "z z"), (9, "naïve 🙂"), (9, "naïve 🙂"), (10, "x" * 200_000)]


def expected(rows):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[strip(t)]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    return out


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


DEDUP = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup_awkward_rows(documents):
    docs = documents(AWKWARD, hash=F.lit(1), kept=F.lit("x"), salt=F.lit(2), norm=F.lit("n"))
    assert rows_of(exact_duplicates(docs), *DEDUP) == sorted(expected(AWKWARD), key=repr)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    kept = {}  # one row of each class, the longest of those with the representative's id
    for (i, t), e in zip(AWKWARD, expected(AWKWARD)):
        if e[3] and len(t or "") > len(kept.get(e[4], (0, ""))[1] or "") or e[4] not in kept and e[3]:
            kept[e[4]] = i, t
    norm = lambda rows: sorted(((i, t or "") for i, t in rows), key=repr)
    assert norm(rows_of(left, "doc_id", "text")) == norm(kept.values())


def test_exact_dedup_separates_colliding_hashes(documents):
    docs = documents(AWKWARD)
    weak = lambda c: F.substring(F.md5(c.cast("binary")), 1, 0)  # noqa: E731  every text collides
    assert rows_of(exact_duplicates(docs, weak), *DEDUP) == sorted(expected(AWKWARD), key=repr)


def test_exact_dedup_hot_group(documents):
    rows = [(i, "hot text" + " " * (i % 3)) for i in range(600)] + [(1000 + i, f"t{i}") for i in range(300)]
    assert rows_of(exact_duplicates(documents(rows)), *DEDUP) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op9_mixing"])
def test_query_matches_sql(spark, name):
    from tools.check_oracle import digest

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMOKE}/documents.parquet')")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert digest(entry.queries()[name](spark, SMOKE).toPandas()) == digest(want)


def test_native_operators_use_no_python(spark):
    for name in ("op1_exact_dedup", "op9_mixing"):
        plan = entry.queries()[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD|CartesianProduct|NestedLoop", plan)


def test_least_loaded_takes_the_largest_first():
    assert least_loaded([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_sharding(documents):
    rows = [(i, f"text {i} " * (i % 40)) for i in range(400)] + [(1000 + i, "copy") for i in range(200)] + [(None, None), (5000, "")]
    docs = documents(rows, shard=F.lit(9), size=F.lit(1), g=F.lit(3))
    got = shard_documents(docs, shards=4, resolution=64).collect()
    assert len(got) == len(rows)
    size = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == size
    load, slots, home = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        home[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in home.values())
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values())


@pytest.mark.parametrize("shards", [3, 8])
def test_sharding_against_a_plain_schedule(documents, small, shards):
    """Where every group is an item of its own, shards hold what a list scheduler gives them."""
    rows = [(int(i), t) for i, t in zip(small.doc_id, small.text)] + [(900 + i, "copy of a text " * (i % 3)) for i in range(90)] + [(None, None)]
    got = shard_documents(documents(rows), shards=shards, resolution=1 << 20).collect()
    groups, load, home = Counter(), [0] * shards, {}
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    for text, size in sorted(groups.items(), key=lambda g: (-g[1], hashlib.md5(g[0].encode()).hexdigest())):
        k = load.index(min(load))
        home[text] = k
        load[k] += size
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), home[t or ""]) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    for k in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(n for key, n in want.items() if key[3] == k)))


@pytest.mark.parametrize("ids", ["null", "one"])
def test_sharding_of_rows_that_share_an_id(documents, ids, monkeypatch):
    monkeypatch.setattr(sharding.numbered, "__defaults__", (7,))
    same = None if ids == "null" else 4
    rows = [(same, f"text {i}") for i in range(150)] + [(same, "one text")] * 100 + [(i, f"other {i}") for i in range(100, 160)]
    got = shard_documents(documents(rows), shards=4).collect()
    size = Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == size
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def water(sizes, weights, budget):
    caps, level = {s: 2.0 * n for s, n in sizes.items()}, {}
    open_ = set(sizes)
    target = {}
    while open_:
        share = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if caps[s] <= weights[s] * share}
        if not over:
            target |= {s: weights[s] * share for s in open_}
            break
        target |= {s: caps[s] for s in over}
        open_ -= over
    return target


def test_mixing_targets_and_repeats(documents):
    rows = [(i, "w " * (i % 9), ["é", "a", "b", "z", None][i % 5 if i % 3 else 1]) for i in range(900)] + [(5000, None, "empty"), (None, "x y", "a")]
    docs = documents(rows, bucket=F.lit(0), target=F.lit(0), weight=F.lit(0), salt=F.lit(0))
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 9, s
    assert rows_of(mix(docs), "doc_id", "taken") == rows_of(mix(docs), "doc_id", "taken")
    again = repeat_documents(docs)
    assert again.columns == docs.columns
    words = Counter()
    for r in again.collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert words == +taken


def test_empty_tables(documents):
    empty = documents([])
    for out in (exact_duplicates(empty), drop_exact_duplicates(empty), shard_documents(empty), mix(empty), repeat_documents(empty)):
        assert out.count() == 0


#: names that operators give to columns of their own
INSIDE = ["row", "norm", "rank", "hash", "sha", "salt", "stays", "n", "best", "bucket", "size", "repeats", "copy", "target", "source_size",
          "whole", "cut", "fp", "root", "first", "stays", "_row", "_0", "_score", "_spans", "_mix_n", "_gone_id", "toxic", "held_out", "at"]


def test_stages_keep_clashing_columns_and_odd_ids(spark, documents):
    """Every filtering stage over columns named as its own, null and repeated ids."""
    from tempest.llm.simhash import drop_near_duplicates
    from tempest.llm.toxicity import drop_toxic

    texts = ["alpha beta gamma delta epsilon", "alpha beta  gamma delta epsilon", "something else entirely different here now", "", None]
    rows = [(i, t) for t in texts for i in (None, None, 1, 1, 2)]
    plain = documents(rows).drop("n_chars")
    docs = plain
    for name in dict.fromkeys(INSIDE):
        docs = docs.withColumn(name, F.lit(name))
    labels = spark.createDataFrame([(9, 1, 1)], "doc_id long, quality int, toxic int").filter("false")
    for stage, left in ((drop_exact_duplicates, 3), (drop_near_duplicates, 3), (lambda d: drop_toxic(d, labels), 25), (repeat_documents, None)):
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert left is None or len(got) == left
        assert all(r[name] == name for r in got for name in docs.columns[4:])
    kept = drop_exact_duplicates(docs).collect()
    assert sorted((r["text"] or "") for r in kept) == ["", texts[1], texts[2]]


@pytest.mark.parametrize("ids", ["null", "one"])
def test_mix_meets_targets_without_ids(documents, ids):
    rows = [(None if ids == "null" else 7, f"w{i} " * 10, f"s{i % 3}") for i in range(600)]
    got = mix(documents(rows)).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 20).all()
