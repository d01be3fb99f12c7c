"""Language identification: sparse multinomial logistic regression on TF-IDF of character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, its scores
calibrated by a temperature.

The temperature is that of rows the weights have not seen: every sampled row is left out of one
of `folds` trainings, and its logits there, of the whole text and of short stretches of it, are
compared with its label. So it says how sure the model may be of a short text, too. As a text
of letters that no learned language uses fits none of them, a score is also multiplied by the
share of the text's letters that are known.
"""

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from cdclake.llm.common import filter_batches, map_batches, remainder, ship

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`per_language` bounds the expected training rows per language; all else is whole."""
    grams: int = 3
    bits: int = 13
    per_language: int = 300
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.05
    chunk: int = 1 << 20
    seed: int = 7
    folds: int = 3
    stretches: tuple = (2, 6, 20)   # words
    usual: float = 0.01             # a language's letter is in this share of its documents


@dataclass(frozen=True)
class Model:
    languages: tuple
    weights: np.ndarray       # (2 ** bits + 1, languages); the last row is the bias
    idf: np.ndarray
    temperature: float
    settings: Settings
    known: np.ndarray         # code points of the letters that some language uses


_LETTERS = []


def letters():
    """Truth of isalpha() by code point; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(
            (chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letters_of(text):
    """Code points of the lower-cased letters of a text."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    return codes[letters()[codes]]


def gram_counts(text, s):
    """Hash buckets of the n-grams and how often each occurs, of the lower-cased letters with
    every run of other characters as one space; None for a text without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, np.uint32(32))
    space = np.full(1, 32, np.uint32)
    codes = np.concatenate([space, codes, space])
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    counts = np.zeros(1 << s.bits, np.int64)
    for at in range(0, len(codes), s.chunk):
        part = codes[at:at + s.chunk + s.grams - 1]
        h, buckets = np.zeros(len(part), np.uint32), []
        for n in range(min(s.grams, len(part))):
            h = (h[:len(part) - n] + part[n:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            buckets.append(h[:s.chunk] >> np.uint32(32 - s.bits))
        counts += np.bincount(np.concatenate(buckets), minlength=1 << s.bits)
    index = np.flatnonzero(counts)
    return index, counts[index]


def vector(counts, idf):
    """Indices and values of the TF-IDF vector of length one, with the bias at the end."""
    index, count = counts
    value = (1 + np.log(count)) * idf[index]
    value /= np.sqrt(value @ value) or 1.0
    return np.append(index, len(idf)), np.append(value, 1.0).astype(np.float32)


def document_frequencies(docs, known, s):
    """In how many documents each n-gram bucket occurs, their number, and the letters that are
    in at least the `usual` share of some language's documents: all of `docs` (text, lang)."""
    size = 1 << s.bits

    def run(batches):
        import pyarrow as pa
        seen, total, used = np.zeros(size, np.int64), 0, {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = gram_counts(text, s)
                if counts is not None:
                    seen[counts[0]] += 1
                    total += 1
                    own = used.setdefault(lang, {})
                    for code in np.unique(letters_of(text)).tolist():
                        own[code] = own.get(code, 0) + 1
        index = np.flatnonzero(seen)
        rows = [(lang, code, n) for lang, own in used.items() for code, n in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * (len(index) + 1) + [r[0] for r in rows], pa.string()),
             pa.array([*index.tolist(), -1, *(r[1] for r in rows)], pa.int32()),
             pa.array([*seen[index].tolist(), total, *(r[2] for r in rows)], pa.int64())],
            names=["lang", "code", "n"])

    sizes = F.create_map(*[x for lang, n in known.items() for x in (F.lit(lang), F.lit(n))])
    counts = (docs.select("text", "lang").mapInArrow(run, "lang string, code int, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    least = F.col("n") >= s.usual * sizes[F.col("lang")]
    # 2 ** bits rows and the letters of all scripts at most.
    found = (counts.where(F.col("lang").isNull() | least)
             .groupBy(F.col("lang").isNull().alias("gram"), "code").agg(F.max("n").alias("n"))
             .collect())
    df = np.zeros(size)
    for gram, code, n in found:
        if gram and code >= 0:
            df[code] = n
    total = next((n for gram, code, n in found if gram and code < 0), 0)
    return df, total, np.array(sorted(code for gram, code, _ in found if not gram), np.int64)


def ftrl(rows, labels, classes, size, s):
    """Weights after online training; coordinates below the L1 penalty are exactly zero."""
    z = np.zeros((size, classes))
    n = np.zeros((size, classes))
    order = np.random.default_rng(s.seed)

    def weights(index):
        zi = z[index]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[index])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            w = weights(index)
            p = softmax(value @ w)
            p[labels[i]] -= 1
            g = value[:, None] * p
            root = np.sqrt(n[index])
            n[index] += g * g
            z[index] += g - (np.sqrt(n[index]) - root) / s.alpha * w
    return weights(slice(None)).astype(np.float32)


def softmax(logits):
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


LOWEST, HIGHEST = 1e-3, 1e3


def best_temperature(logits, labels):
    """The divisor of the logits with the least log loss, by golden-section search. The targets
    are smoothed, (n + 1) / (n + 2) for the label of n rows, so that rows without an error have
    a best one, too."""
    if not len(logits) or logits.shape[1] < 2:
        return 1.0
    rows = np.arange(len(labels))
    right = (len(rows) + 1) / (len(rows) + 2)
    target = np.full(logits.shape, (1 - right) / (logits.shape[1] - 1))
    target[rows, labels] = right

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum()

    low, high, ratio = np.log(LOWEST), np.log(HIGHEST), (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def stretches_of(text, s):
    """Runs of so many words of a text, each from a place drawn by the text itself."""
    words = text.split()
    out = []
    for size in s.stretches:
        if len(words) > size:
            start = zlib.crc32(f"{size} {len(words)} {words[0]} {words[-1]}".encode(
                "utf-8", "replace")) % (len(words) - size)
            out.append(" ".join(words[start:start + size]))
    return out


def train(docs, settings=Settings()):
    """A model from the columns `text` and `lang` of all rows given, or None.

    Document frequencies and usual letters come from every row with a language. The weights
    come from about `per_language` rows of each language, drawn by a hash of the text, and of
    `doc_id` where there is one, so that neither the order nor the partitions of the rows
    matter. Rows without text, letters or language teach nothing.
    """
    s = settings
    key = [c for c in ("doc_id", "text") if c in docs.columns]
    draw = F.pmod(F.xxhash64(F.lit(s.seed), *key), F.lit(1 << 30)) / float(1 << 30)
    docs = docs.select("text", "lang", draw.alias("draw")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    df, total, known = document_frequencies(docs, sizes, s)
    idf = np.log((1 + total) / (1 + df)) + 1
    share = F.create_map(*[x for lang, n in sizes.items() for x in (
        F.lit(lang), F.lit(min(1.0, s.per_language / n)))])
    sample = docs.where(F.col("draw") < share[F.col("lang")]).select("text", "lang")

    def features(batch):
        out = {"row": [], "lang": [], "whole": [], "i": [], "x": []}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name = hashlib.md5(text.encode("utf-8", "replace")).hexdigest()
            for n, part in enumerate([text, *stretches_of(text, s)]):
                counts = gram_counts(part, s)
                if counts is None:
                    continue
                index, value = vector(counts, idf)
                for column, cell in zip(out.values(), (f"{name}{n}", lang, n == 0, index, value)):
                    column.append(cell)
        return out

    rows = map_batches(sample, "row string, lang string, whole boolean, i array<int>, "
                       "x array<float>", features).toArrow().combine_chunks().to_batches()
    found = sorted(((batch.column(1)[k].as_py(), batch.column(0)[k].as_py(),
                     batch.column(2)[k].as_py(), batch.column(3)[k].values.to_numpy(),
                     batch.column(4)[k].values.to_numpy())
                    for batch in rows for k in range(len(batch))), key=lambda r: r[:3])
    whole = [r for r in found if r[2]]
    languages = tuple(sorted({r[0] for r in whole}))
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    size = len(idf) + 1

    def fitted(chosen):
        return ftrl([r[3:] for r in chosen], [number[r[0]] for r in chosen], len(languages),
                    size, s)

    # Copies of a text are in one fold; the folds of a language are dealt in turn.
    texts, fold = {}, {}
    for lang, row, *_ in whole:
        own = texts.setdefault(lang, {})
        fold[lang, row[:32]] = own.setdefault(row[:32], len(own)) % s.folds
    logits, labels = [], []
    for left_out in range(s.folds):
        seen = [r for r in whole if fold[r[0], r[1][:32]] != left_out]
        if len({r[0] for r in seen}) < len(languages):
            continue  # a language of one row would be unknown
        w = fitted(seen)
        for lang, row, _, index, value in found:
            if fold.get((lang, row[:32])) == left_out:
                logits.append(value @ w[index])
                labels.append(number[lang])
    logits = np.array(logits, float).reshape(-1, len(languages))
    return Model(languages, fitted(whole), idf,
                 best_temperature(logits, np.array(labels, int)), s, known)


def known_letters(model):
    """Truth of being a known letter by code point; kept with the model in each process."""
    if not hasattr(model, "_table"):
        table = np.zeros(0x110000, bool)
        table[model.known] = True
        object.__setattr__(model, "_table", table)
    return model._table


def predict(model, texts):
    """Languages and scores in [0, 1] of a list of texts."""
    langs, scores = [], []
    for text in texts:
        counts = gram_counts(text, model.settings) if model else None
        if counts is None:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        index, value = vector(counts, model.idf)
        p = softmax((value @ model.weights[index]).astype(float) / model.temperature)
        best = int(p.argmax())
        langs.append(model.languages[best])
        scores.append(float(p[best] * known_letters(model)[letters_of(text)].mean()))
    return langs, scores


def identify(docs, model):
    """doc_id, lang_pred and score of every row of `docs`; other columns play no part.

    A NULL or empty text, or one without letters, is `und` with score 0, as is every text
    if there was nothing to learn from. Letters of no learned language lower the score, to 0
    where there are no others. Repeated rows are answered one by one; of equally
    likely languages the alphabetically first is taken.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (2 ** bits) x languages

    def run(batch):
        langs, scores = predict(shared.value, batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": langs, "score": scores}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"),
                       f"doc_id {kind}, lang_pred string, score double", run)


def keep_identified(docs, model, least):
    """Rows whose language is known with at least this score, all columns as they are; without
    a model all rows that have letters. A NULL or empty text goes; repeated rows, a NULL id and
    columns of any name are kept or go by their text alone; an empty table stays empty."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accept(texts):
        if shared.value is None:
            return [gram_counts(t, Settings()) is not None for t in texts]
        langs, scores = predict(shared.value, texts)
        return [lang != UNKNOWN and s >= least for lang, s in zip(langs, scores)]

    return filter_batches(docs, "text", accept)


def learnable(docs):
    """Rows whose labels may be learned from: crc32 of the id modulo 3 is not 1."""
    return docs.where(remainder("doc_id", 3) != 1)
