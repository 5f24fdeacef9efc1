"""Language model, toxicity, byte BPE, token shards and the pipeline."""
import base64
import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tempest.llm import hmm, token_shards, toxicity
from tempest.llm.bpe import Codec, StreamDecoder, decode_documents, encode_documents, read_ranks, tokenizer_json
from tempest.llm.exact_dedup import drop_exact_duplicates
from tempest.llm.mixing import mix
from tempest.llm.simhash import drop_near_duplicates
from tempest.llm.token_shards import permute, read_records, write_shards

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SMOKE = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\n\n  x\t y", "it's the we'll 123 ½ ²", "naïve 🙂🙂 日本語 \u0000 �", "<|endoftext|>", "a" * 3000, "é" * 777,
         "word " * 5000, "  lead and trail  ", "don't 'S 's"]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(tokenizer_json(read_ranks(RANKS)), PATTERN)


def test_bpe_matches_and_round_trips(documents, oracle, small):
    rows = list(enumerate(TEXTS + small.text.tolist())) + [(None, "no id"), (3, "twice")]
    docs = documents(rows, ids=F.lit(1), n_tokens=F.lit(2))
    encoded = encode_documents(docs, RANKS, PATTERN, offsets=True)
    want = Counter()
    for i, t in rows:
        ids = oracle.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    got = encoded.collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == want
    for r, t in ((r, TEXTS[r["doc_id"]]) for r in got if r["doc_id"] in (4, 5)):
        assert all(0 <= a < b <= len(t) for a, b in zip(r["starts"], r["ends"])) and r["ends"][-1] == len(t)
    back = {r["doc_id"]: r["text"] for r in decode_documents(encoded.filter("doc_id <> 3"), RANKS).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i not in (None, 3))


def test_bpe_split_characters_and_slices(codec, oracle, monkeypatch):
    text = "日本語 🙂 naïve " * 20
    ids = codec.encode(text)
    decoder = StreamDecoder(codec)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], True) == text
    assert codec.decode(codec.encode("🙂")[:1]) == "�"
    spans = codec.offsets("a🙂b", codec.encode("a🙂b"))
    assert spans[0] == (0, 1) and spans[-1] == (2, 3) and all(s == (1, 2) for s in spans[1:-1])
    monkeypatch.setattr("tempest.llm.bpe.LONG", 10)
    monkeypatch.setattr("tempest.llm.bpe.SLICE", 3)
    assert codec.encode(text) == oracle.encode_ordinary(text)


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000):
        assert sorted(permute(np.arange(n), n, 7)) == list(range(n))
    assert list(permute(np.arange(50), 50, 1)) != list(permute(np.arange(50), 50, 2))


def test_token_shards(spark, scratch, oracle):
    target = f"file://{scratch}/shards"
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = write_shards(docs, target, RANKS, PATTERN, stride=64, shard_bytes=100_000).toPandas()
    assert sorted(got.slot) == list(range(len(texts))) and got.shard.nunique() > 2
    assert got.sort_values("slot").shard.is_monotonic_increasing
    for s, rows in got.groupby("shard"):
        size = os.path.getsize(f"{scratch}/shards/shard-{s:06d}.bin")
        assert size % 128 == 0 and size // 2 - rows.n_tokens.sum() < 64
        flat = read_records(target, s, 0, size // 128, 64).ravel()
        assert (read_records(target, s, 1, 2, 64).ravel() == flat[64:192]).all()
        at = 0
        for r in rows.sort_values("slot").itertuples():
            ids = flat[at:at + r.n_tokens]
            assert r.first_token == at and ids.tolist() == oracle.encode_ordinary(texts[r.doc_id] or "") + [50256]
            assert r.tokens_crc32 == zlib.crc32(ids.tobytes())
            at += r.n_tokens
    assert not [f for f in os.listdir(f"{scratch}/shards") if not f.endswith(".bin")]
    again = write_shards(docs, f"file://{scratch}/again", RANKS, PATTERN, stride=64, shard_bytes=100_000).toPandas()
    key = ["doc_id", "slot", "shard", "first_token", "tokens_crc32"]
    assert again[key].sort_values("slot").reset_index(drop=True).equals(got[key].sort_values("slot").reset_index(drop=True))


def test_token_shards_awkward_rows(spark, documents, scratch):
    path = f"{scratch}/docs"
    documents([(1, None), (1, ""), (None, "x"), (2, "x")], slot=F.lit(5), shard=F.lit(6)).write.parquet(path)
    got = write_shards(spark.read.parquet(path), f"file://{scratch}/s", RANKS, PATTERN).collect()
    assert sorted(r["slot"] for r in got) == [0, 1, 2, 3] and sorted(r["n_tokens"] for r in got) == [1, 1, 2, 2]
    documents([]).write.parquet(f"{scratch}/none")
    assert write_shards(spark.read.parquet(f"{scratch}/none"), f"file://{scratch}/n", RANKS, PATTERN).count() == 0


def forward(model, ids):
    a, total = model.start[0] * model.emit[ids[0]], 0.0
    for i in ids[1:]:
        total += math.log10(a.sum())
        a = a / a.sum() @ model.move * model.emit[i]
    return total + math.log10(a.sum())


def test_hmm_recursions_against_enumeration():
    rng = np.random.default_rng(1)
    model = hmm.Model(rng.random(5), 3)
    lens = np.array([4, 4, 3, 1])
    flat = rng.integers(0, 5, lens.sum()).astype(np.uint16)
    at = np.cumsum(lens) - lens
    got = hmm.log_likelihood(model, flat, at, lens)
    start, move, emit, like = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((5, 3)), []
    for a, n in zip(at, lens):  # every path of states
        ids, total, part = flat[a:a + n], 0.0, []
        for path in np.ndindex(*[3] * n):
            p = model.start[0][path[0]] * model.emit[ids[0], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[ids[t], path[t]]
            total += p
            part.append((path, p))
        like.append(math.log10(total))
        for path, p in part:
            start[0, path[0]] += p / total
            for t in range(n):
                emit[ids[t], path[t]] += p / total
                if t:
                    move[path[t - 1], path[t]] += p / total
    assert np.allclose(got, like) and np.allclose(got, [forward(model, flat[a:a + n]) for a, n in zip(at, lens)])
    s, m, seen, gamma = hmm.expected_counts(model, flat, at, lens, np.zeros(4, int))
    e = np.zeros((5, 3))
    np.add.at(e, seen, gamma)
    assert np.allclose(s, start) and np.allclose(m, move) and np.allclose(e, emit)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    topic = np.repeat(rng.integers(0, 2, 60), 20)
    flat = np.where(topic == 0, rng.integers(0, 5, 1200), rng.integers(5, 10, 1200)).astype(np.uint16)
    at, lens = np.arange(0, 1200, 20), np.full(60, 20)
    model = hmm.Model(np.full(10, 0.1), 2)
    scores = []
    for _ in range(6):
        scores.append(hmm.log_likelihood(model, flat, at, lens).sum())
        s, m, seen, g = hmm.expected_counts(model, flat, at, lens, np.zeros(60, int))
        e = np.zeros((10, 2))
        np.add.at(e, seen, g)
        model.update(s, m, e)
    assert scores == sorted(scores) and scores[-1] > scores[0] + 10


def base_scores(rows):
    tokens = {k: (t or "").encode().lower().split() + [b""] for k, (i, t) in enumerate(rows)}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for k in tokens if not held[k] for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return [(i, held[k], len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[k]))
            for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("own, near", [(32_000, 262_144), (20, 60)])
def test_lm_scores(documents, small, own, near):
    """With near = 60 most words meet their counts in the join."""
    rows = [(int(i), t) for i, t in zip(small.doc_id, small.text)] + [(9001, None), (9002, ""), (None, "É é THE the"), (9003, " \t\x0b"), (9003, " \t\x0b")]
    docs = documents(rows, row=F.lit(1), base=F.lit(2), word=F.lit("w"), n=F.lit(3))
    got = hmm.score_documents(docs, own=own, near=near, rare=16, rounds=3, states=4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want, got = sorted(base_scores(rows), key=key), sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=0, atol=1e-6)
    assert all(r[6] < 0 for r in got)
    total = sum(r[6] for r in got if r[1]) - sum(r[5] for r in got if r[1])
    assert total > 0 or own == 20  # held-out texts are likelier than under single words


def test_lm_class_shares_sum_to_one(documents, spark):
    rows = [(i, t) for i, t in enumerate(["a b c d e f g h", "a a b b k l", "m n o p a"])]
    counts = hmm.count_words(documents(rows), 7, 99)
    v = hmm.Vocabulary(counts, own=2, rare=4, near=3)
    assert v.total == 19 + 3 and v.distinct == 14 + 1 and abs(v.prior.sum() - 1) < 1e-12
    words = __import__("pyarrow").array(sorted({w for _, t in rows for w in t.split()}))
    cls, log_n, near, single, log_class = v.look_up(words)
    c = Counter(w for _, t in rows for w in t.split())
    for k in range(4):  # add-one shares of the words of a class, one share left to the unseen
        inside = [w for w, x in zip(words.to_pylist(), cls) if x == v.own + k]
        assert v.rare_total[k] == sum(c[w] + 1 for w in inside) + 1


def test_lm_words_of_one_count_fill_up_to_the_bound(documents, spark):
    """A step of counts that crosses the bound is taken in part, by hash, not left out whole."""
    counts = hmm.count_words(documents([(i, f"w{i % 400} w{i % 400}") for i in range(400)] + [(900, "top top top")]), 7, 99)
    for near, least in ((401, 401), (400, 340), (200, 150), (40, 10)):
        v = hmm.Vocabulary(counts, own=1000, rare=4, near=near)
        assert least <= len(v.words) <= near and v.own == len(v.words) and v.words[0].as_py() == "top"
        assert v.total == 803 + 401 and abs(v.prior.sum() - 1) < 1e-12
    with pytest.raises(ValueError):
        hmm.Vocabulary(counts, own=65_000, rare=600, near=10)


def test_packed_ids_of_whole_and_sliced_texts(codec, oracle, small, monkeypatch):
    spec = tokenizer_json(read_ranks(RANKS))
    encoder = token_shards._encoder(spec, PATTERN)
    texts = small.text.fillna("").tolist() + ["", " ", "a" * 3000 + "\n \n" * 50, "żółć 🙂<|endoftext|>\x00"]
    want = [np.array(oracle.encode_ordinary(t), "<u2").tobytes() for t in texts]
    assert [b"".join(token_shards.packed_ids(t, codec, encoder)) for t in texts] == want
    monkeypatch.setattr(token_shards, "WHOLE", 5)
    assert [b"".join(token_shards.packed_ids(t, codec, encoder)) for t in texts] == want


def test_shards_are_dealt_one_a_task(spark, documents, scratch):
    documents([(i, "a b c " * 40) for i in range(300)]).write.parquet(f"{scratch}/many")
    out = write_shards(spark.read.parquet(f"{scratch}/many"), f"file://{scratch}/dealt", RANKS, PATTERN, stride=64, shard_bytes=5_000)
    tasks = out.select("shard", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r["task"] for r in tasks}) == len({r["shard"] for r in tasks}) > 8


def test_lm_slices_of_texts_hold_every_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(hmm, "TEXT_BYTES", 10)
    texts = ["a" * 4, None, "b" * 30, "", "c" * 6, "d" * 4, "e"]
    parts = list(hmm.text_slices([pa.record_batch([pa.array(texts)], ["text"]), pa.record_batch([pa.array([], pa.string())], ["text"])], 0))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts and [len(p) for p in parts] == [2, 1, 3, 1]


def test_lm_empty(documents):
    assert hmm.score_documents(documents([]), rounds=1).count() == 0
    got = hmm.score_documents(documents([(10, "only held out words")]), held_out=zlib.crc32(b"10") % 7, rounds=1).collect()
    assert got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0 and abs(got[0]["base_score"]) < 1e-9 and got[0]["score"] < 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_finds_sentences(spark, documents):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows, labels, bad = [], [], {}
    for i in range(700):
        parts = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 12))]
        if i % 4 == 0:
            k = int(rng.integers(len(parts)))
            stem = ["zurko", "vexil"][i // 4 % 2]
            parts[k] += f" {stem}{''.join(rng.choice(list('aeiou'), 2))}"  # an inflected stem
            bad[i] = parts[k]
        rows.append((i, ". ".join(parts) + "."))
        if i < 600:
            labels.append((i, None, int(i % 4 == 0)))
    rows += [(9000, None), (9001, ""), (None, "hello"), (9002, "." * 50)]
    docs = documents(rows, score=F.lit(1), toxic=F.lit(1), held_out=F.lit(True))
    labels += [(7000, 1, 1), (1, 1, None), (2, 1, 7), (3, 0, 0), (3, 0, 0), (None, 0, 0)]
    got = toxicity.score_toxicity(docs, labelled(spark, labels), spans=True).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    unseen = [i for i in range(700) if i >= 600 or by[i]["held_out"]]
    assert np.mean([by[i]["predicted"] == (i % 4 == 0) for i in unseen]) > 0.97
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(700))
    text = dict(rows)
    hits = [i for i in unseen if i in bad and by[i]["predicted"]]
    named = [any(bad[i] in text[i][s["start"]:s["end"]] for s in by[i]["spans"]) for i in hits]
    assert np.mean(named) > 0.95
    for i in (9000, 9001, 9002, None):
        assert 0 <= by[i]["score"] < 0.5
    kept = toxicity.drop_toxic(docs, labelled(spark, labels))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_gradient():
    """The fit's gradient step lowers the loss of the noisy-or."""
    word_of, ids, doc_of, empty, y = np.array([0, 1, 2, 3]), np.array([0, 1, 0, 1]), np.array([0, 0, 1, 2]), np.array([1, 0, 2]), np.array([1, 0, 1])

    def loss(theta, prior):
        z = prior + theta[ids]
        none = -np.bincount(doc_of, np.logaddexp(0, z)) - empty * np.logaddexp(0, prior)
        return -np.where(y == 1, np.log(-np.expm1(none)), none).sum()
    before = loss(np.ones(2), -6.0)
    assert loss(*toxicity.fit_noisy_or(word_of, ids, doc_of, empty, y, 2, steps=5)) < before
    assert abs(toxicity.noisy_or(np.array([0.0, 0.0])) - 0.75) < 1e-12


def test_toxicity_scores_recomputed(spark, small):
    """The query's scores from the fitted weights, character by character and as a product."""
    import __spark_entry__ as entry

    docs, labels = (spark.read.parquet(f"{SMOKE}/{t}.parquet") for t in ("documents", "labels"))
    weights, prior = toxicity.train(docs, labels)
    assert weights
    got = {r["doc_id"]: r for r in entry.queries()["op6_toxicity"](spark, SMOKE).collect()}
    assert len(got) == len(small)
    for i, text in zip(small.doc_id, small.text):
        parts = [p for p in "".join("." if c in "!?\n" else c for c in text or "").split(".") if p]
        clean = 1.0
        for part in parts or [""]:
            held = set()
            for w in "".join(c if c.isalnum() and not c.isdecimal() else " " for c in part.lower()).split(" "):
                held |= {w} | ({w[:4] + "*", w[:5] + "*", w[:6] + "*"} if len(w) > 4 else set())
            clean *= 1 - 1 / (1 + math.exp(-prior - sum(weights.get(f, 0.0) for f in held)))
        r = got[i]
        assert abs(r["score"] - (1 - clean)) < 1e-4 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_toxicity_without_labels(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    assert [r["predicted"] for r in toxicity.score_toxicity(docs, labelled(spark, [])).collect()] == [0, 0]
    assert toxicity.score_toxicity(documents([]), labelled(spark, [(1, 1, 1)])).count() == 0


def test_pipeline_stages(spark):
    """Each stage against its operator's tested decisions, on the rows its predecessor kept."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    cols, ids = docs.columns, lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(corpus_pipeline.write_table(stage(spark, outs[-1], SMOKE), "test"))
    clean, unique, apart, mixed, tokens = outs[1:]
    assert all(x.columns == cols for x in outs[:-1])
    toxic = toxicity.score_toxicity(docs, spark.read.parquet(f"{SMOKE}/labels.parquet"))
    assert ids(clean) == ids(toxic.filter("predicted = 0"))
    pd_clean = clean.toPandas()
    norm = pd_clean.text.fillna("").str.replace(r"[\x20\x09-\x0D]", "", regex=True)
    assert len(ids(unique)) == norm.nunique() and ids(unique) == ids(drop_exact_duplicates(clean))
    assert ids(apart) == ids(drop_near_duplicates(unique))
    repeats = mix(apart).toPandas()
    assert ids(mixed) == sorted(i for i, n in zip(repeats.doc_id, repeats.repeats) for _ in range(n))
    assert ids(tokens) == ids(mixed) and tokens.filter("size(ids) <> n_tokens").count() == 0
    whole = corpus_pipeline.run(spark, SMOKE)
    assert pd.Series(ids(whole)).equals(pd.Series(ids(tokens)))


def test_pipeline_of_awkward_and_empty_documents(spark, documents):
    rows = [(1, None, None), (2, "", "a"), (3, "x " * 30, "a"), (3, "x " * 30, "a"), (None, "lone words here", None), (4, "X " * 30, "b")]
    for docs in (documents(rows), documents([])):
        first = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.write_table(stage(spark, docs, SMOKE), "awkward")
        assert (docs.count() > 0) == (first > 0)
