"""Alignment of the tokens of two tokenizers over the same bytes.

The tokens of both cover the same bytes. Every token points to the farthest-right token that
overlaps it: the other tokenizer's token over its last byte, or, if that ends where it ends
itself, the second tokenizer's of the two, which points to itself. Doubling the pointers of all
tokens of many texts at once until nothing changes leaves each token with the last one of its
group; these labels cut the tokens into the smallest runs that both tokenizers end together.

Corpus counts of linked ids need one pass over the texts: a task writes its texts in chunks,
each with a dictionary of its different id pairs and, per text, numbers into it. Only
dictionaries are shuffled, one row per chunk and pair however often it occurs, so a pair that
is in every text is one row per chunk.
"""

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cdclake.llm.bpe import encoder
from cdclake.llm.common import pieces, ship
from cdclake.llm.merges import ragged
from cdclake.session import materialised

SPACE_MARK = "▁"
CHUNK_CHARS = 4_000_000
CACHE_WORDS, CACHE_CHARS = 500_000, 8_000_000
# Groups with more links than this are linked by their different ids, not token by token.
LINKED_SINGLY = 4096
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


class Pieces:
    """Ids of a sentencepiece model. No piece goes on after a space that follows another
    character, so the text may be cut there; the space that the model adds to each part is
    the one cut off. Parts met before are kept, within bounds."""

    def __init__(self, path):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n)
                       else n.replace(SPACE_MARK, " ").encode() for n in names]
        self.cuts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", n) for n in names)
        self.lone = self.model.piece_to_id(SPACE_MARK)
        self._forget()

    def _forget(self):
        self.known, self.chars = {}, 0
        self.starts = self.counts = np.zeros(0, np.int64)
        self.faithful = np.zeros(0, bool)
        self.ids = np.zeros(0, np.int32)

    def parts(self, text):
        if not self.cuts:
            return [text]
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return re.split("(?<=[^ ]) ", text)

    def _learn(self, parts):
        found = self.model.encode(parts, num_threads=1)
        found = [ids if part else [self.lone] for part, ids in zip(parts, found)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        faithful = [b"".join(map(self.tokens.__getitem__, ids)) == b" " + part.encode()
                    for part, ids in zip(parts, found)]
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.chars += sum(map(len, parts))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.faithful = np.concatenate([self.faithful, faithful])
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.int32)])

    def encode(self, texts):
        """Ids of non-empty texts in a row, how many each has, and whether their bytes are
        those of a space and the text."""
        parts, ends = [], [0]
        for text in texts:
            parts += self.parts(text)
            ends.append(len(parts))
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        at = list(map(self.known.get, parts))
        new = list(dict.fromkeys(p for p, i in zip(parts, at) if i is None))
        if new:
            self._learn(new)
            at = list(map(self.known.get, parts))
        at = np.array(at, np.int64)
        counts = self.counts[at]
        ids = self.ids[ragged(self.starts[at], counts)]
        begins = np.array(ends[:-1], np.int64)
        return ids, np.add.reduceat(counts, begins), np.logical_and.reduceat(
            self.faithful[at], begins)


def groups_of(a_ends, b_ends):
    """Group numbers, from 0 and in order, of the tokens of two covers of the same bytes, given
    where each token ends; by pointer jumping."""
    n = len(a_ends)
    over = np.searchsorted(b_ends, a_ends)         # the second's token over the last byte
    back = np.searchsorted(a_ends, b_ends)
    last = a_ends[back] == b_ends
    to = np.concatenate([n + over, np.where(last, n + np.arange(len(b_ends)), back)])
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    number = np.cumsum(last) - 1
    labels = number[to - n]
    return labels[:n], labels[n:]


@dataclass
class Aligned:
    """What one batch of texts gives, per text, and its different (text, pair) with how often
    each is linked."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    shown: list
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, first, second):
        self.first, self.second = encoder(first), Pieces(second)
        self.a_size = np.array([len(t) for t in self.first.tokens], np.int64)
        self.b_size = np.array([len(t) for t in self.second.tokens], np.int64)
        self.bits = len(self.b_size).bit_length()
        plain = [[str(i) + end for i in range(max(len(self.a_size), len(self.b_size)))]
                 for end in (",", "|", ";")]
        self.width, self.numerals = len(plain[0]), [x for own in plain for x in own]

    def align(self, texts):
        """`Aligned` of a list of texts; None, empty ones and those whose bytes a tokenizer
        does not give back have no tokens."""
        at = [i for i, t in enumerate(texts) if t and SPACE_MARK not in t]
        given = [texts[i] for i in at]
        zeros = np.zeros(len(texts), np.int64)
        if not given:
            none = np.zeros(0, np.int64)
            return Aligned(zeros, zeros, zeros, zeros, [""] * len(texts), none, none, none)
        a, ends = self.first._encode([" " + t for t in given])
        a_counts = np.diff(ends, prepend=0)
        b, b_counts, good = self.second.encode(given)
        good &= self._faithful(a, ends, given)
        if not good.all():
            a, b = a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)]
            a_counts, b_counts = a_counts * good, b_counts * good
        a_group, b_group = groups_of(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        count = int(b_group[-1]) + 1 if len(b) else 0
        a_own, b_own = np.bincount(a_group, minlength=count), np.bincount(b_group, minlength=count)
        at = np.array(at, np.int64)
        text = np.empty(count, np.int64)                       # of each group
        text[b_group] = np.repeat(np.arange(len(given)), b_counts)
        out = [zeros.copy() for _ in range(4)]
        out[0][at], out[1][at] = a_counts, b_counts
        out[2][at] = np.bincount(text, minlength=len(given))
        links = np.zeros(len(given), np.int64)
        np.add.at(links, text, a_own * b_own)
        out[3][at] = links
        shown = [""] * len(texts)
        for i, own in zip(at.tolist(), self._shown(a, b, a_group, b_group, a_own, b_own,
                                                   a_counts + b_counts)):
            shown[i] = own
        where, pair, times = self._pairs(a, b, a_own, b_own, text)
        return Aligned(*out, shown, at[where], pair, times)

    def _faithful(self, ids, ends, texts):
        made = b"".join(map(self.first.tokens.__getitem__, ids.tolist()))
        wanted = [b" " + t.encode() for t in texts]
        bytes_to = np.concatenate([[0], np.cumsum(self.a_size[ids])])[ends]
        sizes = np.diff(bytes_to, prepend=0)
        same_size = sizes == np.fromiter(map(len, wanted), np.int64, len(wanted))
        if same_size.all() and made == b"".join(wanted):
            return same_size
        return np.array([made[j - n:j] == w for j, n, w in
                         zip(bytes_to.tolist(), sizes.tolist(), wanted)])

    def _shown(self, a, b, a_group, b_group, a_own, b_own, tokens):
        """`a1,a2|b1;a3|b2,b3` for each text of so many tokens."""
        a_before, b_before = np.cumsum(a_own) - a_own, np.cumsum(b_own) - b_own
        a_last = np.arange(len(a)) == (a_before + a_own - 1)[a_group]
        b_last = np.arange(len(b)) == (b_before + b_own - 1)[b_group]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before[a_group]] = a + self.width * a_last
        order[np.arange(len(b)) + (a_before + a_own)[b_group]] = b + self.width * 2 * b_last
        parts, end = list(map(self.numerals.__getitem__, order.tolist())), 0
        for n in tokens.tolist():
            yield "".join(parts[end:end + n])[:-1]
            end += n

    def _pairs(self, a, b, a_own, b_own, text):
        """(text, pair of ids, links) of the different pairs of each text."""
        a_from, b_from = np.cumsum(a_own) - a_own, np.cumsum(b_own) - b_own
        links = a_own * b_own
        single = np.flatnonzero(links <= LINKED_SINGLY)
        count = links[single]
        place = ragged(np.zeros(len(single), np.int64), count)
        step = np.repeat(b_own[single], count)
        codes = [self._code(a[np.repeat(a_from[single], count) + place // step],
                            b[np.repeat(b_from[single], count) + place % step])]
        texts, times = [np.repeat(text[single], count)], [np.ones(len(place), np.int64)]
        for g in np.flatnonzero(links > LINKED_SINGLY).tolist():
            left, left_times = np.unique(a[a_from[g]:a_from[g] + a_own[g]], return_counts=True)
            right, right_times = np.unique(b[b_from[g]:b_from[g] + b_own[g]], return_counts=True)
            codes.append(self._code(left[:, None], right[None, :]).ravel())
            texts.append(np.full(len(codes[-1]), text[g]))
            times.append(np.outer(left_times, right_times).ravel())
        texts, codes = np.concatenate(texts), np.concatenate(codes)
        room = self.bits + len(self.a_size).bit_length()
        order = (np.argsort(texts << room | codes) if len(text).bit_length() + room < 63
                 else np.lexsort((codes, texts)))
        texts, codes, times = texts[order], codes[order], np.concatenate(times)[order]
        new = np.r_[True, (texts[1:] != texts[:-1]) | (codes[1:] != codes[:-1])][:len(texts)]
        begins = np.flatnonzero(new)
        return texts[new], codes[new], (np.add.reduceat(times, begins) if len(begins)
                                        else times[:0])

    def _code(self, a, b):
        return a.astype(np.int64) << self.bits | b

    def ids(self, codes):
        return (codes >> self.bits).astype(np.int32), (codes & (1 << self.bits) - 1).astype(
            np.int32)


@lru_cache(maxsize=1)
def aligner(first, second):
    return Aligner(first, second)


def _schema():
    import pyarrow as pa
    long, whole = pa.int64(), pa.int32()
    return pa.schema([
        ("chunk", long), ("doc_id", pa.list_(long)), ("n_a", pa.list_(long)),
        ("n_b", pa.list_(long)), ("n_groups", pa.list_(long)), ("n_links", pa.list_(long)),
        ("groups", pa.list_(pa.string())), ("pairs", pa.list_(whole)), ("a", pa.list_(whole)),
        ("b", pa.list_(whole)), ("docs", pa.list_(whole)), ("entries", pa.binary())])


CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, "
         "n_groups array<long>, n_links array<long>, groups array<string>, pairs array<int>, "
         "a array<int>, b array<int>, docs array<int>, entries binary")


def packed(numbers, times):
    import zstandard
    return zstandard.ZstdCompressor(1).compress(
        numbers.astype(np.int32).tobytes() + times.astype(np.int64).tobytes())


def unpacked(entries):
    import zstandard
    data = zstandard.ZstdDecompressor().decompress(entries)
    count = len(data) // 12
    return np.frombuffer(data, np.int32, count), np.frombuffer(data, np.int64, count, count * 4)


def chunks(docs, first, second):
    """One row per about `CHUNK_CHARS` characters of whole texts: per text its numbers, the
    SHA-256 of its groups and how many different pairs it links; the chunk's different pairs
    (a, b) with the number of its texts that link them; and, packed, for each text the places
    of its pairs among these and how often each is linked."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        own, schema = aligner(first, second), _schema()
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            parts = [x for _, x in held]
            codes = np.concatenate([x.pair for x in parts])
            pairs, places = np.unique(codes, return_inverse=True)
            a, b = own.ids(pairs)
            return pa.RecordBatch.from_pylist([{
                "chunk": number, "doc_id": [i for ids, _ in held for i in ids],
                **{name: np.concatenate([getattr(x, name) for x in parts])
                   for name in ("n_a", "n_b", "n_groups", "n_links")},
                "groups": [s for x in parts for s in x.shown],
                "pairs": np.concatenate([np.bincount(x.text, minlength=len(x.n_a))
                                         for x in parts]),
                "a": a, "b": b, "docs": np.bincount(places, minlength=len(pairs)),
                "entries": packed(places, np.concatenate([x.times for x in parts]))}],
                schema=schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in pieces([t or "" for t in texts]):
                found = own.align(texts[start:end])
                found.shown = [hashlib.sha256(s.encode()).hexdigest() if s else ""
                               for s in found.shown]
                held.append((ids[start:end], found))
                size += sum(len(t or "") for t in texts[start:end])
                if size >= CHUNK_CHARS:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNK)


def counted(chunks):
    """(a, b, n, best): in how many texts of the corpus each pair of ids is linked, and whether
    no pair of the same `a` is in more."""
    n = (chunks.select(F.inline(F.arrays_zip("a", "b", "docs"))).groupBy("a", "b")
         .agg(F.sum("docs").alias("n")))
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def align(docs, first, second):
    """Per row its numbers of tokens, groups and links, how the corpus sees its links, and the
    SHA-256 of its groups; columns as in `RESULT`.

    `first` is the file of a byte-level BPE tokenizer, given a space and the text, `second` a
    sentencepiece model, which adds the space; special tokens in a text are plain text. A text
    that is NULL or empty, or that a tokenizer does not give back byte by byte (such as one
    with U+2581), has no tokens: zeros and an empty `groups_sha256`. Texts of any length are
    aligned whole. Every row counts as a document, also one repeated or without an id; equal
    counts of an id are all its best. Other columns play no part; an empty table gives no rows.
    """
    table = materialised(chunks(docs, first, second))
    seen = (table.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("place", "pair"))
            .select("chunk", "place", "pair.a", "pair.b").join(counted(table), ["a", "b"])
            .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(
                "place", (F.col("n") * 2 + F.col("best").cast("long")).alias("code"))))
                .alias("seen"))
            .select("chunk", F.col("seen.code").alias("seen")))
    whole = table.drop("a", "b", "docs").join(seen, "chunk", "left")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                places, times = unpacked(row["entries"])
                code = np.array(row["seen"] or [], np.int64)[places]
                ends = np.concatenate([[0], np.cumsum(row["pairs"], dtype=np.int64)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
                        for x in (times * (code & 1), times * (code >> 1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (
                        row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"],
                        *sums)] + [pa.array(row["groups"], pa.string())],
                    names=[f.split()[0] for f in RESULT.split(", ")])

    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs",
                        "entries", "seen").mapInArrow(run, RESULT)
