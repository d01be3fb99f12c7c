"""Toxicity: embeddings of a window's subwords, averaged and put through a linear softmax,
both trained together. Words share the vectors of their character n-grams, so a misspelling
never seen before still scores by its parts."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cdclake.llm.common import filter_batches, map_batches, remainder, ship

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """`documents` bounds the expected training rows: a third of it toxic ones, the rest
    others; `longest` leaves rows with longer texts out of training. Scores are for whole
    texts of any length and are those of the worst window of `window` words. A subword that
    occurs in fewer than `least` training rows keeps a zero vector."""
    documents: int = 3000
    longest: int = 20_000
    window: int = 2
    grams: tuple = (3, 6)     # from, to
    bits: int = 18
    size: int = 8
    least: int = 4
    epochs: int = 12
    whole: int = 1            # epochs on whole texts before those on worst windows
    rate: float = 1.0
    rate_output: float = 0.01
    often: int = 4            # a subword's occurrences count so often at most in a step
    chunk: int = 1 << 20
    seed: int = 11


@dataclass(frozen=True)
class Model:
    value: np.ndarray         # what each subword adds to the difference of the two logits
    bias: float
    settings: Settings


_WORD_CHARACTERS = []


def word_characters():
    if not _WORD_CHARACTERS:
        _WORD_CHARACTERS.append(np.fromiter(
            (chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _WORD_CHARACTERS[0]


def spelled(text):
    """Lower-cased letters and digits, words between single blanks; None for no words."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    inside = word_characters()[codes]
    if not inside.any():
        return None
    codes = np.where(inside, codes, np.uint32(32))
    space = np.full(1, 32, np.uint32)
    codes = np.concatenate([space, codes, space])
    return codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]


def subwords(codes, s):
    """Yields (first position, bucket, valid) for stretches of the text and each size of
    n-gram: the hash bucket of the n-gram at each position, and whether it lies within one
    word and its two borders."""
    low, high = s.grams
    for at in range(0, len(codes), s.chunk):
        part = codes[at:at + s.chunk + high - 1]
        edge = part == 32
        h, inner = np.zeros(len(part), np.uint32), np.ones(len(part), bool)
        for n in range(min(high, len(part))):
            size = len(part) - n
            h = (h[:size] + part[n:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            inner = inner[:size]
            if n + 1 >= low:
                yield at, h[:s.chunk] >> np.uint32(32 - s.bits), inner[:s.chunk]
            if n:
                inner = inner & ~edge[n:]


def window_starts(codes, s):
    """First position of each window; a word begins at the border before it."""
    return np.flatnonzero(codes == 32)[:-1:s.window]


def bags(text, s):
    """All subwords of a text and the window each is in."""
    codes = spelled(text)
    if codes is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    starts, ids, windows = window_starts(codes, s), [], []
    for at, h, inner in subwords(codes, s):
        kept = np.flatnonzero(inner)
        ids.append(h[kept])
        windows.append(np.searchsorted(starts, at + kept, "right") - 1)
    ids, windows = np.concatenate(ids), np.concatenate(windows)
    order = np.argsort(windows, kind="stable")
    return ids[order], windows[order]


def window_means(text, value, s):
    """Mean of `value` over the subwords of each window; None for no words."""
    codes = spelled(text)
    if codes is None:
        return None
    total, count = np.zeros(len(codes), np.float32), np.zeros(len(codes), np.int32)
    for at, h, inner in subwords(codes, s):
        total[at:at + len(h)] += value[h] * inner
        count[at:at + len(h)] += inner
    starts = window_starts(codes, s)
    return (np.add.reduceat(total, starts, dtype=np.float64)
            / np.maximum(np.add.reduceat(count, starts), 1))


def fit(texts, labels, settings=Settings()):
    """Embedding and softmax, both by stochastic gradients, one document at a time.

    The first epochs average over whole texts. A document is toxic by its worst window, so
    the later ones train on the window that scores highest under the model so far. The step
    of a subword's vector is not divided by the number of subwords it is averaged with.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    occurs = np.zeros(1 << s.bits, np.int32)
    for text in texts:
        occurs[np.unique(bags(text, s)[0])] += 1
    active = np.flatnonzero(occurs >= s.least)
    slot = np.full(1 << s.bits, -1, np.int32)
    slot[active] = np.arange(len(active))
    docs = []       # per text: slots window by window, where each begins, all subwords in each
    for text, y in zip(texts, labels):
        ids, windows = bags(text, s)
        if len(ids):
            sizes, ids = np.bincount(windows).astype(np.int32), slot[ids]
            kept = np.bincount(windows[ids >= 0], minlength=len(sizes))
            begins = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            ids = ids[ids >= 0]
            common, counts = np.unique(ids, return_counts=True)
            docs.append((ids, begins, sizes, common, counts.astype(np.int32), int(y)))
    embedding = np.zeros((len(active), s.size), np.float32)
    output = np.zeros((s.size, 2), np.float32)
    output[:, 1] = rng.choice([-1, 1], s.size) / np.sqrt(2 * s.size)
    output[:, 0] = -output[:, 1]
    share = np.clip(np.mean([d[-1] for d in docs]) if docs else 0.5, 0.01, 0.99)
    bias = np.log(np.array([1 - share, share], np.float32))
    for epoch in range(s.epochs):
        rate = s.rate * (1 - epoch / s.epochs)
        value = np.append(embedding @ (output[:, 1] - output[:, 0]), 0)
        for d in rng.permutation(len(docs)):
            ids, begins, sizes, common, counts, y = docs[d]
            size = sizes.sum()
            if epoch >= s.whole and len(sizes) > 1:
                total = np.concatenate([[0], np.cumsum(value[ids], dtype=np.float64)])
                worst = ((total[begins[1:]] - total[begins[:-1]]) / sizes).argmax()
                common, counts = np.unique(ids[begins[worst]:begins[worst + 1]],
                                           return_counts=True)
                size = sizes[worst]
            rows = embedding[common]
            mean = (counts @ rows) / size
            p = softmax(mean @ output + bias)
            p[y] -= 1
            embedding[common] = rows - np.outer(
                rate * np.minimum(counts, s.often), output @ p).astype(np.float32)
            output -= s.rate_output * rate * np.outer(mean, p).astype(np.float32)
            bias = bias - s.rate_output * rate * p
    value = np.zeros(1 << s.bits, np.float32)
    value[active] = embedding @ (output[:, 1] - output[:, 0])
    return Model(value, float(bias[1] - bias[0]), s)


def softmax(logits):
    e = np.exp(logits - logits.max())
    return e / e.sum()


def train(docs, labels, settings=Settings()):
    """A model from `text` of the rows given and `toxic` of `labels`, or None.

    The rows are drawn at random, toxic ones and others each up to their share of
    `documents` in expectation. A document with several labels counts as toxic if one says
    so; NULL ids, texts and labels teach nothing.
    """
    s = settings
    marks = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")))
    count = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n"))
             .collect()}                                     # two rows at most
    if not count:
        return None
    wanted = {1: s.documents / 3, 0: s.documents * 2 / 3}
    drawn = None
    for y, n in count.items():
        part = marks.where(F.col("toxic") == y).where(
            F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30)) / (1 << 30)
            < min(1.0, wanted[y] / n))
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = drawn.collect()                                  # about `documents` rows
    chosen = docs.sparkSession.createDataFrame(
        pd.DataFrame(drawn, columns=["doc_id", "toxic"]), marks.schema)
    rows = (docs.select("doc_id", "text").where(F.char_length("text") <= s.longest)
            .join(F.broadcast(chosen), "doc_id")             # bounded by `documents`
            .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
            .collect())
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], s) if rows else None


def score(model, texts):
    """Scores in [0, 1]; 0 for a text without words and where nothing was learned."""
    out = []
    for text in texts:
        means = window_means(text, model.value, model.settings) if model else None
        out.append(0.0 if means is None else float(1 / (1 + np.exp(-means.max() - model.bias))))
    return out


def classify(docs, model, threshold=THRESHOLD):
    """doc_id, score and predicted (1 if the score reaches the threshold) of every row.

    NULL and empty texts, and those without letters or digits, score 0. Repeated rows are
    answered one by one; other columns play no part.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)     # 2 ** bits numbers

    def run(batch):
        scores = score(shared.value, batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "score": scores,
                "predicted": [int(x >= threshold) for x in scores]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"),
                       f"doc_id {kind}, score double, predicted int", run)


def keep_clean(docs, model, threshold=THRESHOLD):
    """Rows whose score stays below the threshold, all columns as they are."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accept(texts):
        return [x < threshold for x in score(shared.value, texts)]

    return filter_batches(docs, "text", accept)


def learnable(rows):
    """Rows whose labels may be learned from: crc32 of the id modulo 4 is not 2."""
    return rows.where(remainder("doc_id", 4) != 2)
