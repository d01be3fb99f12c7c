"""Byte-level BPE by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never be merged over, so
the text may be cut there: fragments are encoded independently and their ids concatenated.
Only cuts that the split pattern also agrees with are used: not after white space, whose
runs look at what follows, not inside or next to characters beyond ASCII, and not between
punctuation and an apostrophe, which could then begin a contraction. Fragments recur, so
their ids are kept, within bounds; new ones are merged many at a time.
"""

import hashlib
from functools import lru_cache

import numpy as np
import regex

from cdclake.llm.common import map_batches, pieces, ship
from cdclake.llm.merges import Encoder, Merges, byte_symbols

# The split pattern of the vocabulary, with its white space written out.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class ByteEncoder(Encoder):
    def __init__(self, path):
        vocab = Merges(path).vocab
        byte = {c: b for b, c in enumerate(byte_symbols())}
        inside = np.zeros((256, 256), bool)
        raw = {i: bytes(byte[c] for c in token) for token, i in vocab.items()}
        for token in raw.values():
            for pair in zip(token, token[1:]):
                inside[pair] = True
        super().__init__(path, ~inside & safe_cuts())
        raw |= {i: token.encode() for token, i in self.merges.special.items()}
        self.tokens = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.numerals = [str(i) for i in range(len(self.tokens))]

    def words(self, fragment):
        if fragment.isalpha() or fragment[:1] == b" " and fragment[1:].isalpha():
            return [fragment]
        return [w.encode() for w in PATTERN.findall(fragment.decode())]

    def decode(self, ids):
        """The text of the ids; bytes that are no text become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def safe_cuts():
    """Pairs of ASCII bytes between which the split pattern splits alike on either side."""
    ascii_ = np.arange(256) < 128
    space = np.isin(np.arange(256), [*range(9, 14), 32])
    word = np.array([chr(i).isalnum() for i in range(256)]) & ascii_
    safe = (ascii_ & ~space)[:, None] & ascii_[None, :]
    safe[~word, ord("'")] = False
    return safe


@lru_cache(maxsize=2)
def encoder(path):
    return ByteEncoder(path)


def encode(docs, path):
    """doc_id and ids (array of int) of every row. A NULL text is empty and has no ids; texts
    of any length are encoded whole. Repeated rows are answered one by one, other columns
    play no part. `path` is the tokenizer's file, readable by every executor."""
    ship(docs.sparkSession)

    def run(batch):
        ids = encoder(path).encode([t or "" for t in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "ids": ids}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, ids array<int>", run)


def decode(encoded, path):
    """doc_id and text of every row of `encode`; NULL ids give an empty text."""
    ship(encoded.sparkSession)

    def run(batch):
        return {"doc_id": batch.column(0),
                "text": [encoder(path).decode(i or ()) for i in batch.column(1).to_pylist()]}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), f"doc_id {kind}, text string", run)


def digests(docs, path):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded and the ids decoded
    again, in one pass."""
    ship(docs.sparkSession)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batch):
        own = encoder(path)
        out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for start, end in pieces(texts):
            for ids in own.encode(texts[start:end]):
                ids = ids.tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha(",".join(map(own.numerals.__getitem__, ids))))
                out["decoded_sha256"].append(sha(own.decode(ids)))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"),
                       f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string",
                       run)
