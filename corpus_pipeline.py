"""The corpus pipeline: language, toxicity, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

import uuid

from cdclake.llm import language_id, packing, secrets, simhash, toxicity
from cdclake.llm.common import read, ship
from cdclake.llm.queries import tokenizer
from cdclake.session import shared_dir

LEAST_LANGUAGE_SCORE = 0.3


def identified(spark, docs, sf_dir):
    """Drops documents without letters and those that fit no language it has learned."""
    ship(spark)
    model = language_id.train(language_id.learnable(docs))
    return language_id.keep_identified(docs, model, LEAST_LANGUAGE_SCORE)


def not_toxic(spark, docs, sf_dir):
    """Drops documents that score as toxic."""
    labels = toxicity.learnable(read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def one_of_each(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.keep_one_of_each(docs)


def without_secrets(spark, docs, sf_dir):
    """Replaces secrets in the texts; all documents stay."""
    return secrets.mask_secrets(docs, secrets.train(docs))


def packed(spark, docs, sf_dir):
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", identified), ("toxicity", not_toxic), ("near_dedup", one_of_each),
          ("secrets", without_secrets), ("packing", packed)]

# Trained models and token ids are nothing SQL can express. tests/llm/test_pipeline.py runs the
# stages and compares each with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
