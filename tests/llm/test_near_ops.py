"""SimHash, embedding and passage dedup against brute force."""
import hashlib
from decimal import Decimal

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempest.llm import bcr
from tempest.llm.components import connected_components, spanning
from tempest.llm import itq_dedup
from tempest.llm.itq_dedup import near_vectors
from tempest.llm.passages import earlier_windows, remove_passages, segments
from tempest.llm.simhash import Forest, drop_near_duplicates, fingerprint, near_groups, simhash_groups


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in ["", " \t", "one", "ONE two", "a b c d e", "naïve É é x y z " * 50, "the same " * 5]:
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_forest_finds_all_within_radius():
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, 1 << 12, 500, dtype=np.uint64))
    unit = np.sort(rng.integers(0, 3, len(code)))
    found = set()
    for q, n in Forest(unit, code).search(unit, code, 3):
        found |= set(zip(q.tolist(), n.tolist()))
    want = {(i, j) for i in range(len(code)) for j in range(len(code))
            if unit[i] == unit[j] and bin(int(code[i]) ^ int(code[j])).count("1") <= 3}
    assert found == want


def test_spanning_and_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    want = roots(441, links)
    a, b = np.array(links).T
    assert spanning(441, a, b).tolist() == want
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: w for i, w in enumerate(want) if i != w}


@pytest.mark.parametrize("tree", [1024, 7])
def test_near_groups_with_split_keys(spark, tree):
    """Many nodes share every key, so small trees meet many query blocks."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2)]
    codes = sorted({b ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(40)})
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    want = roots(len(codes), [(i, j) for i in range(len(codes)) for j in range(i) if bin(codes[i] ^ codes[j]).count("1") <= 4])
    got = {r["fp"]: r["component_id"] for r in near_groups(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), 4, tree).collect()}
    assert [got[s] for s in signed] == want


def test_simhash_documents(documents, small):
    rows = [(int(i), t) for i, t in zip(small.doc_id, small.text)] + [(9001, None), (9002, ""), (None, "one lone row"), (9003, "one lone row")]
    docs = documents(rows, fp=F.lit(1), component_id=F.lit(2), root=F.lit(3))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    fps = [plain_fingerprint(rows[k][1]) for k in order]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    want = sorted(((rows[k][0], f"{f:016x}", rows[order[r]][0]) for k, f, r in zip(order, fps, root)), key=repr)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_groups(docs).collect()), key=repr)
    assert got == want
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {w[2] for w in want}


def test_simhash_drop_with_null_and_repeated_ids(documents):
    """One row of each group stays whatever the ids; rows in no group all stay."""
    near = "one two three four five six seven eight nine ten"
    alone = [(None, "alpha beta gamma delta epsilon"), (None, "a wholly other text without an id"), (7, "red green blue cyan")]
    groups = [[(5, near), (None, near), (None, near.upper()), (7, near)],
              [(None, "copies without any id at all"), (None, "copies without any id at all")],
              [(8, "loaded twice under one id"), (8, "loaded twice under one id")]]
    rows = alone + [r for g in groups for r in g]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert len(set(want)) == len(alone) + len(groups)
    got = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(documents(rows)).collect()), key=repr)
    assert got == sorted(alone + [g[0] for g in groups], key=repr)


def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("label", T.IntegerType()), T.StructField("id", T.IntegerType())])
    return spark.createDataFrame([(*r, 1) for r in rows], schema)


@pytest.mark.parametrize("block", [1024, 9])
def test_embedding_dedup_recall(spark, block):
    """All links of clusters at cosine about 0.93 and up; blocks of nine split every key."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([c + rng.normal(size=(25, 32)) * s for c in centres for s in (0.1, 0.22)]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(9000 + i, rows[3][1], rows[3][2]) for i in range(20)]  # copies
    rows += [(9100, None, 0), (9101, [0.0] * 32, 0), (9102, [float("nan")] * 32, 0), (9103, [None] * 32, 0),
             (9104, rows[0][1], None), (9105, [], 0), (9106, [1.0, 2.0], 0), (None, rows[5][1], rows[5][2])]
    usable = [k for k, r in enumerate(rows) if r[0] is None or r[0] < 9100]
    y = np.array([rows[k][1] for k in usable], float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    lab = np.array([rows[k][2] for k in usable])
    link = (y @ y.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in near_vectors(vectors(spark, rows), 0.93, block=block).collect()}
    assert len(got) == len(rows)
    want = {rows[k][0]: int(n) for k, n in zip(usable, link.sum(1))}
    found = {i: got[i]["n_links"] for i in want}
    assert all(found[i] <= want[i] for i in want)
    assert sum(found.values()) >= 0.995 * sum(want.values()) > 0
    for i in range(9100, 9107):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[9000]["component_id"] == got[3]["component_id"]
    assert sum(r["kept"] for r in got.values()) < len(rows)


@pytest.mark.parametrize("common", [0.8, 0.9])
def test_embedding_dedup_recall_with_a_common_component(spark, common):
    """Unit vectors with a mean of squared norm 0.8 or 0.9, pairs about cosine 0.93 in clusters."""
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    own = np.concatenate([c + rng.normal(size=(25, 32)) * 0.75 for c in rng.normal(size=(16, 32))])
    x = (np.sqrt(common) * unit(rng.normal(size=32)) + np.sqrt(1 - common) * unit(own)).astype(np.float32)
    link = unit(x.astype(float)) @ unit(x.astype(float)).T >= 0.93
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), 0.93, block=64).collect()}
    want = link.sum(1)
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.995 * want.sum() > 0


def test_embedding_dedup_of_many_lengths(spark):
    """Links of a length after 66 shorter ones, and of the shorter ones."""
    rng = np.random.default_rng(10)
    rows = [(d, rng.normal(size=d).tolist(), 0) for d in range(1, 67)]
    rows += [(100 + d, [2.0 * x for x in rows[d - 1][1]], 0) for d in (3, 66)]
    pairs = rng.normal(size=(20, 1, 80)) + rng.normal(size=(20, 2, 80)) * 0.05
    rows += [(200 + i, v.tolist(), 0) for i, v in enumerate(pairs.reshape(40, 80))]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(vectors(spark, rows), 0.93).collect()}
    assert {i for i, n in got.items() if n} == {3, 66, 103, 166, *range(200, 240)} and set(got.values()) == {0, 1}


@pytest.mark.parametrize("n, common", [(500, 0.0), (5000, 0.0), (500, 0.7), (5000, 0.7)])
def test_embedding_dedup_recall_through_tables(spark, n, common):
    """Pairs about the threshold among many vectors alone, at sizes where tables are used."""
    rng = np.random.default_rng(n)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    own = rng.normal(size=(n // 5, 1, 64)) + rng.normal(size=(n // 5, 5, 64)) * (0.3 if common else 0.18)
    x = (np.sqrt(common) * unit(rng.normal(size=64)) + np.sqrt(1 - common) * unit(own.reshape(n, 64))).astype(np.float32)
    df = vectors(spark, [(i, v.tolist(), i // 2500) for i, v in enumerate(x)])
    quantiser = itq_dedup.fit(itq_dedup.numbered_labels(itq_dedup.classes_of(df)), 0.93, 8192)[64]
    assert quantiser.width >= 8 and len(quantiser.starts) <= itq_dedup.MOST
    y, lab = unit(x.astype(float)), np.arange(n) // 2500
    link = (y @ y.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, 0.93).collect()}
    want = link.sum(1)
    assert all(got[i] <= k for i, k in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum() > 0


def test_embedding_tables_grow_with_the_data():
    """Pairs judged at ten times the vectors: far below the hundredfold of all pairs."""
    for differ, power in ((0.12, 1.5), (0.22, 1.75)):
        pairs = []
        for n in (5e4, 5e5, 5e6, 5e7):
            w, t = itq_dedup.layout(np.array([differ]), n, 64)
            assert (1 - (1 - differ) ** w) ** t <= itq_dedup.MISSED
            pairs.append(n * n * t / 2 ** w)
        assert all(b < a * 10 ** power for a, b in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("kind, labels", [("double", [1.2, 1.7, 1.2]), ("string", ["a", "b", "a"]), ("long", [1, 1 + (1 << 32), 1]),
                                          ("decimal(4,2)", [Decimal("1.20"), Decimal("1.70"), Decimal("1.20")])])
def test_embedding_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, 2.0 + i / 1000, 0.5], label) for i, label in enumerate(labels)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0)}


def test_transform_in_small_chunks():
    rng = np.random.default_rng(5)
    for _ in range(60):
        parts = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 25)).astype(np.uint8) for _ in range(rng.integers(1, 8))]
        flat, lens = np.concatenate(parts), np.array([len(p) for p in parts])
        bwt, lcp = bcr.transform(flat, np.cumsum(lens) - lens, lens, 200, chunk=int(rng.integers(1, 40)))
        suffix = {}
        for t, seq, rows in bcr.suffix_rows(bwt, lens):
            suffix |= {int(r): parts[s].tobytes()[len(parts[s]) - t:] for s, r in zip(seq, rows)}
        order = [suffix[r] for r in sorted(suffix)]
        assert len(order) == lens.sum() and order == sorted(order, key=lambda s: s + b"\xff")
        for r in sorted(suffix)[1:]:
            a, b = suffix[r - 1], suffix[r]
            assert lcp[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def plain_passages(rows, match):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - match + 1):
            if b[p:p + match] in seen:
                gone[p:p + match] = b"\1" * match
            seen.add(b[p:p + match])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


def test_segments_cover_all_windows():
    rng = np.random.default_rng(6)
    parts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 5, 40, 41, 300, 0, 90)] + [b"ab" * 100]
    whole, lens = b"".join(parts), np.array([len(p) for p in parts])
    starts = np.cumsum(lens) - lens
    first, n, k = segments(np.frombuffer(whole, np.uint8), starts[lens > 0], 40, 8)
    windows = {w: a for f, m, a in zip(first, n, k) for w in range(f, f + m)}
    assert sorted(windows) == [s + i for s, m in zip(starts, lens) for i in range(m - 39)]
    by_text = {}
    for w, a in windows.items():  # equal windows have equal anchors
        assert by_text.setdefault(whole[w:w + 40], a) == a


@pytest.mark.parametrize("limit, block", [(8192, 4096), (2, 8)])
def test_passages(documents, limit, block):
    """Shared passages in different surroundings, copies, periods; limit 2 cuts most anchors
    into single windows."""
    rng = np.random.default_rng(7)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared = [word(150), word(64), "é" * 70, "ab" * 60]
    rows = [(i, word(int(rng.integers(0, 90))) + shared[i % 4] + word(int(rng.integers(0, 90)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200, None), (201, ""), (202, "a" * 500), (203, "x" * 39), (None, shared[0])]
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_passages(documents(rows, doc=F.lit(1), k=F.lit(2), spans=F.lit(3)),
                                                              match=40, gram=8, block=block, limit=limit).collect()}
    assert got == plain_passages(rows, 40)


def test_passages_rows_that_share_id_and_text(documents):
    text = "".join(chr(97 + i * 7 % 26) for i in range(80)) + "0123456789" * 2
    got = remove_passages(documents([(1, text), (1, text), (2, text)]), match=64, gram=32).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 100)]


def test_earlier_windows_across_chunks():
    rng = np.random.default_rng(8)
    parts = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(12)]
    lens = np.full(12, 60)
    seq, window = earlier_windows(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens, np.arange(12), np.zeros(12, int), 8, chunk=37)
    seen, want = set(), set()
    for i, p in enumerate(parts):
        for w in range(53):
            if p[w:w + 8] in seen:
                want.add((i, w))
            seen.add(p[w:w + 8])
    assert set(zip(seq.tolist(), window.tolist())) == want


def test_empty_tables(spark, documents):
    empty = documents([])
    assert simhash_groups(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    assert remove_passages(empty).count() == 0 and near_vectors(vectors(spark, [])).count() == 0
