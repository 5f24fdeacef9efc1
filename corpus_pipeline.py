"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
in the shared checkpoint folder and rereads it as the next stage's documents, so a lost
executor never reaches back over a stage. All stages but the last return the columns of
``documents``: toxic documents go, then all but one of equal texts, then all but one of each
near-duplicate group, then every document is repeated as the mix takes it, and the last stage
returns token ids.
"""

from __future__ import annotations

from tempest.llm.common import table, write_table


def toxicity(spark, docs, sf_dir):
    from tempest.llm.toxicity import drop_toxic

    return drop_toxic(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)


def exact_dedup(spark, docs, sf_dir):
    from tempest.llm.exact_dedup import drop_exact_duplicates

    return drop_exact_duplicates(docs)


def simhash_dedup(spark, docs, sf_dir):
    from tempest.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs, words_per_shingle=4, radius=4)


def mixing(spark, docs, sf_dir):
    from tempest.llm.mixing import repeat_documents

    return repeat_documents(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0)


def byte_bpe(spark, docs, sf_dir):
    import public_tokenizers

    from tempest.llm.bpe import encode_documents

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash_dedup),
          ("mixing", mixing), ("byte-level BPE", byte_bpe)]

#: training and fingerprints are beyond SQL; tests/llm compare with a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
