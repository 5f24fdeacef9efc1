"""Registered queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tempest.llm.common import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


@query("op1_exact_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS l,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS m FROM documents),
k AS (SELECT doc_id, m, first_value(doc_id) OVER (PARTITION BY m ORDER BY l DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY m) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(m) AS text_sha256 FROM k
""")
def op1(spark, sf_dir):
    from tempest.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def op8(spark, sf_dir):
    from tempest.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op9_mixing", r"""
WITH d AS (SELECT doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 4))::INT AS bucket
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
      FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS held,
             sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open,
             1.5::DOUBLE * sum(source_size) OVER () AS budget
      FROM s WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max((budget - held) / open) AS level FROM c WHERE (budget - held) / open < cap / weight),
t AS (SELECT source, source_size, least(cap, weight * coalesce(level, 1e300)) AS target FROM c, v),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
m AS (SELECT source, bucket, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS upto
      FROM d GROUP BY source, bucket),
g AS (SELECT w.source, w.source_size, target, whole, target - whole * w.source_size AS rest,
             min({'gap': abs(upto - (target - whole * w.source_size)), 'bucket': bucket}) AS best
      FROM w JOIN m ON w.source IS NOT DISTINCT FROM m.source GROUP BY ALL)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN best.gap < rest AND bucket <= best.bucket THEN 1 ELSE 0 END) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
""")
def op9(spark, sf_dir):
    from tempest.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    import public_tokenizers

    from tempest.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, ids=False)


@query("op10_simhash_dedup")
def op10(spark, sf_dir):
    from tempest.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), words_per_shingle=4, radius=4).select(
        "doc_id", "fingerprint", "component_id")


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    from tempest.llm.hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), folds=7, held_out=2)


@query("op6_toxicity")
def op6(spark, sf_dir):
    from tempest.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0)


@query("op3_embedding_dedup")
def op3(spark, sf_dir):
    from tempest.llm.itq_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op7_passage_dedup")
def op7(spark, sf_dir):
    from tempest.llm.passages import remove_passages

    return remove_passages(table(spark, sf_dir, "documents"), match=100)


@query("op5_token_shards")
def op5(spark, sf_dir):
    import public_tokenizers

    from tempest.llm.common import scratch_path
    from tempest.llm.token_shards import write_shards

    return write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "token-shards"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) AS sizes(k)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT c.lang, c.k, c.phrase, c.a, cut, l.f AS l, r.f AS r, 1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS score
      FROM c, (VALUES (1), (2)) AS cuts(cut)
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
      WHERE cut < c.k),
s AS (SELECT lang, k, phrase, a, unnest(min({'score': score, 'cut': cut, 'l': l, 'r': r})) FROM x GROUP BY lang, k, phrase, a),
t AS (SELECT lang, max(a) AS a, phrase FROM (
        SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL
        SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3) GROUP BY lang, phrase),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
      FROM s LEFT JOIN t ON s.k = 2 AND s.lang = t.lang AND s.phrase = t.phrase WHERE t.a IS NULL OR 100 * t.a < 50 * s.a)
SELECT o.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
""")
def op11(spark, sf_dir):
    from tempest.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    from tempest.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_quality")
def op13(spark, sf_dir):
    from tempest.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held_out=0, threshold=0.3)
