"""Collocations, token alignment and the quality classifier."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempest.llm import chunks as ch
from tempest.llm import collocations as co
from tempest.llm import quality as qu
from tempest.llm.alignment import align_documents, aligned
from tempest.llm.bpe import byte_characters
from tempest.llm.quotient import Layout

A, B, PATTERN = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@given(st.integers(1, 42), st.integers(0, 12), st.integers(0, 300), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_filters_lose_nothing(width, blocks, n, seed):
    rng = np.random.default_rng(seed)
    layout = Layout(width)
    ids = [rng.integers(0, min(1 << width, 50 if seed % 2 else 1 << 62), n).astype(np.uint64) for _ in range(3)]
    want = Counter(zip(*(x.tolist() for x in ids)))
    shards = []
    for cut in (slice(0, n // 3), slice(n // 3, None)):
        entries = layout.counted(*layout.permute(*layout.pack(*(x[cut] for x in ids))))
        shards += list(layout.filters(*entries, blocks))
    got = Counter()
    for block in {b for b, _ in shards}:
        parts = [layout.read(data, block, blocks) for b, data in shards if b == block]
        left, right, counts = layout.counted(*(np.concatenate(p) for p in zip(*parts)))
        back = layout.unpack(*layout.restore(left, right))
        for key, c in zip(zip(*(x.tolist() for x in back)), counts.tolist()):
            assert key not in got  # an n-gram lies in one block only
            got[key] = c
    assert got == want


def test_large_counters_and_streams():
    layout = Layout(5)
    left, right = layout.permute(*layout.pack(*(np.array([v], np.uint64) for v in (3, 4, 5))))
    (block, data), = layout.filters(left, right, np.array([10**12]), 4)
    assert layout.read(data, block, 4)[2].tolist() == [10**12]
    stream = np.array([0, 5, 5, 2, 2, 2, 1], np.int64)
    new, order, counts = ch.by_frequency(stream, 6, fixed=1)
    assert order[new].tolist() == stream.tolist() and counts.tolist()[1:3] == [3, 2]
    assert ch.unpack(ch.pack(new), len(new)).tolist() == new.tolist()


def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            if len(p) == 2 and any(100 * c >= 50 * a for (g, q), c in f.items()
                                   if g == lang and len(q) == 3 and c >= least and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                 for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
            for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


PHRASES = [("The red Fox, the red fox; the RED fox! a b", "en"), ("red fox red fox\x0bred\tfox é É", None), (None, "en"), ("", None),
           ("the red fox", "und"), ("ÀÉ àé b. b b b b", "fr"), (" \t ", "en"), ("the red fox", "und"), ("a,b a?b a b a b", "en"),
           ("x" * 5000 + " the red " + "x" * 5000, "en"), ("\u0000 z \u0000 z \u0000 z", "de")]


@pytest.mark.parametrize("chunk, block, slice_", [(2_000_000, 2_000_000, 4_000_000), (7, 2, 10)])
def test_collocations_match_brute_force(spark, monkeypatch, chunk, block, slice_):
    monkeypatch.setattr(co, "SLICE", slice_)
    docs = spark.createDataFrame([(None, t, g) for t, g in PHRASES], "doc_id long, text string, lang string")
    docs = docs.withColumn("phrase", F.lit("x")).withColumn("f", F.lit(1)).withColumn("chunk", F.lit(2)).repartition(3)
    got = co.collocations(docs, least=2, top=9, chunk=chunk, block=block).collect()
    assert {tuple(r) for r in got} == brute_phrases(PHRASES, 2, 9) and len(got) == len(set(got))


def test_collocations_of_given_texts_and_of_none(spark, small):
    rows = list(zip(small.text, small.lang))
    docs = spark.createDataFrame(small[["doc_id", "text", "lang"]])
    got = co.collocations(docs, least=8, top=100, chunk=3000).collect()
    assert {tuple(r) for r in got} == brute_phrases(rows, 8, 100)
    assert co.collocations(docs.filter("false")).count() == 0
    assert co.collocations(docs, least=10**9).count() == 0


def brute_alignment(rows):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in enumerate(byte_characters())}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    links, docs = Counter(), []
    for i, text in rows:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        sides = [[bytes(back[c] for c in tok.id_to_token(k)) for k in a], [piece(sp.id_to_piece(k)) for k in b]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            docs.append((i, 0, 0, 0, [], ""))
            continue
        ranges = []
        for side in sides:
            ends = np.cumsum([len(x) for x in side]).tolist()
            ranges.append(list(zip([0] + ends[:-1], ends)))
        found, j = [], 0
        for k, (x, y) in enumerate(ranges[0]):
            while ranges[1][j][1] <= x:
                j += 1
            m = j
            while m < len(b) and ranges[1][m][0] < y:
                found.append((a[k], b[m]))
                m += 1
        groups, at = [], 0
        for end in sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]}):
            groups.append("|".join(",".join(str(t) for t, (_, e) in zip(ids, r) if at < e <= end) for ids, r in zip((a, b), ranges)))
            at = end
        links.update(found)
        docs.append((i, len(a), len(b), len(groups), found, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (x, y), n in links.items():
        most[y] = max(most[y], n)
    return Counter((i, na, nb, g, len(found), sum(links[p] == most[p[1]] for p in found), sum(links[p] for p in found), sha)
                   for i, na, nb, g, found, sha in docs)


TEXTS = [None, "", " ", "\n\n  x\t y", "it's the we'll 123 ½ ²", "naïve 🙂🙂 日本語 �", "<|endoftext|> <s> </s>", "a▁b", "▁", "é" * 777,
         "word " * 3000, "  lead and trail  ", "don't 'S 's", "\u0000x"]


@pytest.mark.parametrize("size", [2_000_000, 50])
def test_alignment_matches_brute_force(documents, small, size):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "twice"), (3, "twice"), *zip(small.doc_id[:40] + 100, small.text.str.slice(0, 600))]
    docs = documents(rows, n_a=F.lit(1), found=F.lit(2), chunk=F.lit("x")).repartition(3)
    assert Counter(tuple(r) for r in align_documents(docs, A, PATTERN, B, size).collect()) == brute_alignment(rows)
    assert align_documents(docs.filter("false"), A, PATTERN, B).count() == 0


def test_alignment_in_full(documents):
    r, = aligned(documents([(1, "tokenizers differ: 日本")]), A, PATTERN, B).collect()
    assert r["a_last"][-1] == len(r["a_ids"]) - 1 and r["b_last"][-1] == len(r["b_ids"]) - 1
    assert len(r["a_last"]) == len(r["b_last"]) and sorted(set(r["a_last"])) == r["a_last"]


def test_additive_model_learns_tables_and_a_pair():
    rng = np.random.default_rng(3)
    x = rng.random((6000, len(qu.FIGURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.4)).astype(float)  # only the pair tells
    model = qu.Additive(0.0).fit(x[:4000], y[:4000])
    assert (2, 5) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.scores(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.9
    z = model.logits(x[:5])  # the sum of single entries
    for k in range(5):
        one = model.prior + sum(t[np.searchsorted(e, x[k, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
        one += sum(t[np.searchsorted(model.coarse[i], x[k, i], side="right"), np.searchsorted(model.coarse[j], x[k, j], side="right")]
                   for i, j, t in model.pairs)
        assert one == pytest.approx(z[k])


def test_figures():
    f = dict(zip(qu.FIGURES, qu.figures("He He HE!! x | 12.\nHe He")))
    assert f["repeat_share"] == pytest.approx(2 / 8) and f["lone_mark_share"] == pytest.approx(1 / 8)
    assert f["mark_tail_share"] == pytest.approx(1 / 8) and f["capitals_share"] == pytest.approx(1 / 8)
    assert qu.figures(None) == qu.figures("") == qu.figures(" \n") == [0.0] * len(qu.FIGURES)


def test_quality_held_out(spark):
    """Held-out accuracy over all labels of the given documents; labels of that fold don't matter."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = qu.score_quality(docs, labels).toPandas()
    known = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = known[known.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95 and len(got) == docs.count()
    assert (known[known.quality == 1].predicted == 1).all()
    turned = labels.withColumn("quality", F.when(qu.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = qu.score_quality(docs, turned).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()


def test_quality_edge_cases(spark, documents):
    rows = [(1, "good words here"), (2, None), (None, ""), (3, "A!! B!! C!!"), (3, "A!! B!! C!!"), (3, "other text"), (4, "long " * 50_000)]
    docs = documents(rows, quality=F.lit(7), score=F.lit(1), at=F.lit(0), x=F.lit("y"))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 1), (3, 0, 0), (4, 5, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = qu.score_quality(docs, labels, explain=True).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, None)}) == 1
    for only in (labels.filter("quality = 1"), labels.filter("false")):
        one = qu.score_quality(docs, only).collect()
        assert len({r["score"] for r in one}) == 1
    x, y = qu.labelled_sample(docs, labels, 7, 6, sample=2)
    assert len(x) <= 2 == x.ndim and len(y) == len(x)
    assert qu.score_quality(docs.filter("false"), labels).count() == 0
