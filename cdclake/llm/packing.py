"""Packing by best-fit decreasing: token sequences of documents into windows of fixed size.

A document longer than a window is first cut into full windows. What remains of each
document is placed, longest first, into the window with the least room that still takes it;
a segment tree over the room left finds that window. Every task packs the documents of its
own partition, so nothing is shuffled and no task holds more than its split.
"""

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext

from cdclake.llm.bpe import SPACE
from cdclake.llm.common import arrow_type, pieces, ship
from cdclake.llm.merges import Encoder, byte_symbols

WINDOW, END_ID = 2048, 1
BLOCK = 16_384            # remainders placed together; bounds a task's memory
LOOSE = 64                # a window with more room left is cut at powers of two instead

# The split pattern of the vocabulary, with its white space written out.
PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")

# Latin, Greek, Cyrillic, common punctuation, kana, Han and Hangul of the first versions.
SETTLED = regex.compile("[\0-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa"
                        "\u4e00-\u9fa5\uac00-\ud7a3]+")

# ASCII letters in lower case, white space as blanks: neither changes the ids.
PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\v\f\r", b" " * 5))
SYMBOL_BYTES = {c: b for b, c in enumerate(byte_symbols())}


class WordEncoder(Encoder):
    """Ids of a vocabulary with word ends. It drops white space and splits letters, digits and
    the rest, so a text may be cut between ASCII characters of different kinds; only what
    follows an apostrophe may belong to it."""

    def __init__(self, path):
        from tokenizers import Tokenizer
        kind = np.array([1 if c.isalpha() else 2 if c.isdigit() else 0 if c.isspace() else 3
                         for c in map(chr, range(128))] + [4] * 128)
        kind[28:32] = 3                            # separators, no white space to the pattern
        a, b = kind[:, None], kind[None, :]
        cut = (a != b) & (a != 0) & (a != 4) & (b != 4)
        cut[ord("'")] = b[0] == 0
        super().__init__(path, cut)
        self.library = Tokenizer.from_file(path)

    def to_bytes(self, text):
        return super().to_bytes(text).translate(PLAIN)

    def words(self, fragment):
        word = fragment.strip()
        if word.isalpha():
            return [word]
        text = fragment.decode()
        if SETTLED.fullmatch(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        else:                                      # letters that Unicode versions differ on
            text = self.library.normalizer.normalize_str(text)
            return [split_bytes(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return [w.encode() for w in PATTERN.findall(text)]


def split_bytes(symbols):
    return bytes(map(SYMBOL_BYTES.__getitem__, symbols))


@lru_cache(maxsize=2)
def encoder(path):
    return WordEncoder(path)


class Rooms:
    """Open windows by the room they have left, and a segment tree over the rooms that says
    below which node there is one."""

    def __init__(self, window):
        self.size = 1 << window.bit_length()
        self.open = [[] for _ in range(window + 1)]
        self.tree = bytearray(2 * self.size)

    def _mark(self, room):
        node = room + self.size
        self.tree[node] = bool(self.open[room])
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def add(self, room, window):
        self.open[room].append(window)
        if len(self.open[room]) == 1:
            self._mark(room)

    def take(self, length):
        """(room, window) of least room, at least `length`; None if there is none."""
        node = length + self.size
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.open[room].pop()
        if not self.open[room]:
            self._mark(room)
        return room, window


def best_fit(lengths, window):
    """Lists of item numbers, one per window: best fit, longest first, ties in order."""
    rooms, out = Rooms(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            room, at = window, len(out)
            out.append([])
        else:
            room, at = found
        out[at].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], at)
    return out


def sequences(remainders, window, loose):
    """Yields sequences of (document, start, ids): the windows of `best_fit`. One with more
    than `loose` tokens of room left is cut at powers of two, which need no padding."""
    size = [len(r[2]) // 4 for r in remainders]
    for items in best_fit(size, window):
        fill = sum(size[i] for i in items)
        if window - fill <= loose:
            yield [remainders[i] for i in items]
            continue
        row, room = [], 1 << (fill.bit_length() - 1)
        for doc, start, ids in (remainders[i] for i in items):
            while ids:
                part, ids = ids[:4 * room], ids[4 * room:]
                row.append((doc, start, part))
                start, room, fill = start + len(part) // 4, room - len(part) // 4, \
                    fill - len(part) // 4
                if not room and fill:
                    yield row
                    row, room = [], 1 << (fill.bit_length() - 1)
        yield row


def pack(docs, path, window=WINDOW, end_id=END_ID, block=BLOCK, loose=LOOSE):
    """Pieces of all rows of `docs`: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset.

    A document is the ids of its text and then `end_id`; a NULL or empty text is `end_id`
    alone. Full windows of a long document stand alone; remainders are placed `block` at a
    time. Sequence ids are unique, not dense: the number of the partition and a counter in
    it. Every row is a document of its own, also where ids repeat or are NULL; equal lengths
    are placed in the order of the rows. Other columns play no part.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = docs.select("doc_id").schema
    id_type = arrow_type(schema["doc_id"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        columns, waiting = [[] for _ in names], []

        def write(sequence):
            nonlocal number
            offset = 0
            for (doc, total), start, ids in sequence:
                length = len(ids) // 4
                for column, x in zip(columns, (doc, start, length, zlib.crc32(ids), total,
                                               number, offset)):
                    column.append(x)
                offset += length
            number += 1

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type)]
                + [pa.array(c, pa.int64()) for c in columns[1:]], names=names)
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, last in pieces(texts):
                for doc, ids in zip(doc_ids[first:last], encoder(path).encode(texts[first:last])):
                    ids = ids.astype("<u4").tobytes() + end
                    total, full = len(ids) // 4, len(ids) // 4 // window * window
                    for at in range(0, full, window):
                        write([((doc, total), at, ids[4 * at:4 * (at + window)])])
                    if full < total:
                        waiting.append(((doc, total), full, ids[4 * full:]))
                if len(waiting) >= block:
                    for sequence in sequences(waiting, window, loose):
                        write(sequence)
                    waiting.clear()
                if len(columns[0]) >= block:
                    yield flush()
        for sequence in sequences(waiting, window, loose):
            write(sequence)
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long")
