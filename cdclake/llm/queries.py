"""One query per operator over its whole table, the pipeline, and their SQL."""

from pyspark.sql import functions as F

from cdclake.llm import (
    alignment, bpe, chat, hnsw, inner_products, language_id, licenses, merkle, order_minhash,
    packing, secrets, simhash, toxicity)
from cdclake.llm.common import read, remainder

QUERIES, ORACLES = {}, {}


def tokenizer(name):
    import public_tokenizers
    return public_tokenizers.path(name)


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred and score of all documents."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(language_id.learnable(docs))
    return language_id.identify(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


@query
def op2_simhash_dedup(spark, sf_dir):
    """doc_id, fingerprint and component_id of all documents."""
    found = simhash.groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op9_order_minhash(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how near they are."""
    return order_minhash.edits(read(spark, sf_dir, "documents"))


@query
def op10_hnsw_search(spark, sf_dir):
    """The 5 nearest of all other rows of `embeddings` for each id divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.index(vectors), vectors.where("vec_id % 50 = 0"))


@query
def op3_bpe(spark, sf_dir):
    """Token counts and digests of ids and decoded text of all documents."""
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op4_toxicity(spark, sf_dir):
    """doc_id, held_out, score and predicted of all documents."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.learnable(read(spark, sf_dir, "labels")))
    return toxicity.classify(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score", "predicted")


@query
def op5_packing(spark, sf_dir):
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op8_secret_scan(spark, sf_dir):
    """Secrets of all documents by kind, with the spans of the patterns and of the field."""
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
        "spans")


@query
def op6_license_scan(spark, sf_dir):
    """The licence of every document as a file of its source and language."""
    return licenses.scan(licenses.document_files(read(spark, sf_dir, "documents")))


@query
def op7_chat_format(spark, sf_dir):
    """All turns of `conversations` as messages, calls and results in canonical JSON."""
    return chat.link(*chat.question_calls(read(spark, sf_dir, "conversations")), chat.SCHEMAS)


@query
def op11_top_k(spark, sf_dir):
    """The 5 rows of `embeddings` with the highest integer inner product for each id divisible
    by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    return inner_products.search(inner_products.index(vectors), vectors.where("vec_id % 50 = 0"))


ORACLES["op11_top_k"] = inner_products.SQL


@query
def op12_token_alignment(spark, sf_dir):
    """How the tokens of two tokenizers align in every document."""
    return alignment.align(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"),
                           tokenizer("piece_bpe_32k.model"))


@query
def op13_merkle_manifest(spark, sf_dir):
    """Every document's leaf, the roots above it, its proof and whether it still folds to them."""
    return merkle.manifest(read(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = merkle.sql()
ORACLES["op6_license_scan"] = licenses.sql()
ORACLES["op7_chat_format"] = chat.SQL


@query
def pipeline(spark, sf_dir):
    """Packed sequences of the documents that the stages of the corpus pipeline keep."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
