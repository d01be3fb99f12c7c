"""Fragments whose 64-bit hashes collide by construction still get their own ids."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cdclake.llm import bpe, merges, packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def thue_morse(size, even, odd):
    """Letters by the parity of the ones in their position: a polynomial hash modulo 2^64 is
    the same for the word and its mirror, whatever its base."""
    return "".join(odd if i.bit_count() % 2 else even for i in range(size))


def wanted(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size", [1024, 2048])
@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("path, make", [(BYTES, bpe.encoder), (WORDS, packing.encoder)])
def test_colliding_fragments(path, make, turned, size):
    pair = [thue_morse(size, "a", "e"), thue_morse(size, "e", "a")]
    if turned:
        pair.reverse()
    own, right = make(path), wanted(path, pair)
    for _ in range(2):  # with an empty and with a warm cache
        assert [own.encode([t])[0].tolist() for t in pair] == right
    own._forget()
    assert [ids.tolist() for ids in own.encode(pair)] == right
    assert [ids.tolist() for ids in own.encode(pair[::-1])] == right[::-1]


def test_colliding_fragments_without_room_in_the_cache(monkeypatch):
    pair = [thue_morse(1024, "a", "e"), "some words", thue_morse(1024, "e", "a")]
    own = bpe.ByteEncoder(BYTES)
    monkeypatch.setattr(merges, "CACHE_WORDS", 1)
    assert [ids.tolist() for ids in own.encode(pair)] == wanted(BYTES, pair)
    monkeypatch.setattr(merges, "CACHE_WORDS", 1000)
    monkeypatch.setattr(merges, "CACHE_BYTES", 1500)
    assert [ids.tolist() for ids in own.encode(pair * 2)] == wanted(BYTES, pair * 2)


def test_digests_of_colliding_texts(spark):
    pair = [thue_morse(1024, "a", "e"), thue_morse(1024, "e", "a")]
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id LONG, text STRING").coalesce(1)
    got = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == list(enumerate(pair))
    assert bpe.digests(docs, BYTES).select("decoded_sha256").distinct().count() == 2
