"""Byte-pair merges of many words at once, from the merge list of a public tokenizer's file."""

import heapq
import json

import numpy as np

from cdclake.llm.common import pieces

NONE = np.int32(2 ** 31 - 1)
LONG_WORD = 48
CACHE_WORDS = 1_000_000
CACHE_BYTES = 32_000_000


def byte_symbols():
    """The printable character that byte-level vocabularies write for each byte: itself if it
    is visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Merges:
    """Merge table of a byte-level BPE file. With an end-of-word suffix, the last byte of each
    word is a symbol of its own."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = np.array([self.vocab[c] for c in symbols], np.int32)
        self.final = np.array([self.vocab[c + suffix] for c in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        cut = len(suffix)
        self.made = np.array([self.vocab[(a[:-cut] if cut and a.endswith(suffix) else a) + b]
                              for a, b in pairs], np.int32)
        self.levels = self._levels((self.left << 16) | self.right)
        self.ranks = None

    @staticmethod
    def _slot(keys, bits):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                >> np.uint64(64 - bits)).astype(np.int64)

    def _levels(self, keys):
        """Hash tables; keys whose slot is taken go to the next one."""
        levels, ranks, bits = [], np.arange(len(keys), dtype=np.int32), 18
        while len(keys):
            slots = self._slot(keys, bits)
            _, first = np.unique(slots, return_index=True)
            table, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            table[slots[first]], value[slots[first]] = keys[first], ranks[first]
            levels.append((bits, table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, bits = keys[rest], ranks[rest], bits + 1 if len(levels) > 2 else bits - 2
        return levels

    def rank(self, left, right):
        """Ranks of pairs of symbols, NONE for pairs that do not merge."""
        keys = (left.astype(np.int64) << 16) | right
        out, todo = np.full(keys.shape, NONE, np.int32).ravel(), None
        flat = keys.ravel()
        for bits, table, value in self.levels:
            k = flat if todo is None else flat[todo]
            slot = self._slot(k, bits)
            there = table[slot]
            hit = there == k
            at = np.flatnonzero(hit) if todo is None else todo[hit]
            out[at] = value[slot[hit]]
            other = np.flatnonzero(~hit & (there >= 0))
            todo = other if todo is None else todo[other]
            if not len(todo):
                break
        return out.reshape(keys.shape)

    def encode(self, words):
        """Ids of all words (bytes) in a row, and how many each has. Of the pairs of a word
        the one of lowest rank merges first, the leftmost of equal ones."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts, parts = np.zeros(len(words), np.int64), []
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            if size > LONG_WORD:
                found = [self._encode_long(words[i]) for i in at]
                own = np.array([len(ids) for ids in found])
                ids = np.concatenate(found)
            elif size:
                ids, own = self._encode_equal([words[i] for i in at], int(size))
            else:
                continue
            counts[at] = own
            parts.append((at, own, ids))
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for at, own, ids in parts:
            out[ragged(starts[at], own)] = ids
        return out, counts

    def symbols(self, data):
        ids = self.inner[data]
        ids[..., -1] = self.final[data[..., -1]]
        return ids

    def _encode_equal(self, words, size):
        """Words of one length: each step merges one pair in every word that has one. The
        symbols of a word are linked by position; merged ones drop out of the links."""
        n = len(words)
        ids = self.symbols(np.frombuffer(b"".join(words), np.uint8).reshape(n, size))
        if size == 1:
            return ids.ravel(), np.ones(n, np.int64)
        ranks = np.full((n, size), NONE)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (n, 1))
        before = after - 2
        row = np.arange(n)                      # words that still have a pair
        while len(row):
            own = ranks[row]
            j = own.argmin(axis=1)
            best = own[np.arange(len(j)), j]
            live = best != NONE
            row, j, best = row[live], j[live], best[live]
            k = after[row, j]                   # the right half of the pair goes
            ids[row, j] = self.made[best]
            ids[row, k] = -1
            ranks[row, k] = ranks[row, j] = NONE
            far = after[row, j] = after[row, k]
            some = far < size
            r, x, y = row[some], j[some], far[some]
            before[r, y] = x
            ranks[r, x] = self.rank(ids[r, x], ids[r, y])
            near = before[row, j]
            some = near >= 0
            r, x, y = row[some], near[some], j[some]
            ranks[r, x] = self.rank(ids[r, x], ids[r, y])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _encode_long(self, word):
        """One word by a heap of pairs over a linked list: n log n steps."""
        if self.ranks is None:
            self.ranks = {(int(a), int(b)): r for r, (a, b) in
                          enumerate(zip(self.left, self.right))}
        ids = self.symbols(np.frombuffer(word, np.uint8)).tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := (ids[x], ids[after[x]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], x, *p))
        return np.array([i for i in ids if i >= 0], np.uint32)


def ragged(starts, counts):
    """Positions of runs that begin at `starts` and have `counts` members, one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Encoder:
    """Texts cut into fragments that are encoded independently, each different one once.

    `cut` says for each pair of bytes whether the text may be cut between them. The ids of
    fragments met before are kept, up to `CACHE_WORDS` fragments or `CACHE_BYTES` of their
    text, then forgotten together. They are found by a 64-bit hash, and the bytes of every
    fragment are compared with those that the hash found: one that only shares the hash is
    encoded by itself. `words(fragment)` gives the words in which a fragment's bytes may merge.
    """

    def __init__(self, path, cut):
        self.merges, self.cut = Merges(path), cut.ravel()
        self.special = {t: np.array([i], np.uint32) for t, i in self.merges.special.items()}
        draw = np.random.default_rng(1)
        self.byte_value = draw.integers(1, 2 ** 63, 256, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self._powers(1 << 20)
        self._forget()

    def words(self, fragment):
        raise NotImplementedError

    def to_bytes(self, text):
        return text.encode("utf-8", "replace")

    def _powers(self, size):
        self.up = np.full(size, self.base).cumprod(dtype=np.uint64)
        self.down = np.full(size, self.back).cumprod(dtype=np.uint64)

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.counts = self.places = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.text = np.zeros(0, np.uint8)

    def _hashes(self, data, starts, ends):
        if len(data) > len(self.up):
            self._powers(1 << len(data).bit_length())
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte_value[data] * self.up[:len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        return (h + (ends - starts).astype(np.uint64)) * self.base

    def _merged(self, fragments):
        """Ids of the fragments in a row, where each one's begin and how many it has."""
        words = [self.words(f) for f in fragments]
        ids, counts = self.merges.encode([w for own in words for w in own])
        ends = np.concatenate([[0], np.cumsum(counts)])
        of_fragment = np.cumsum([0, *map(len, words)])
        starts = ends[of_fragment[:-1]]
        return ids, starts, ends[of_fragment[1:]] - starts

    def _learn(self, keys, fragments):
        """Keep the ids of new fragments; False if there is no room."""
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        if (len(self.keys) + len(keys) > CACHE_WORDS
                or len(self.text) + int(sizes.sum()) > CACHE_BYTES):
            return False
        ids, starts, counts = self._merged(fragments)
        at = np.searchsorted(self.keys, keys)
        places = np.cumsum(sizes) - sizes + len(self.text)
        self.starts = np.insert(self.starts, at, starts + len(self.ids))
        self.counts = np.insert(self.counts, at, counts)
        self.places = np.insert(self.places, at, places)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.ids = np.concatenate([self.ids, ids])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(fragments), np.uint8)])
        return True

    def _lookup(self, keys):
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _encode(self, texts):
        """Ids of texts without special tokens, and where each text's end."""
        data = [self.to_bytes(t) for t in texts]
        edges = np.cumsum([0, *map(len, data)])
        data = b"".join(data)
        if not data:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        b = np.frombuffer(data, np.uint8)
        first = np.zeros(len(b) + 1, bool)
        pairs = b[:-1].astype(np.uint16) << 8
        first[1:-1] = self.cut[pairs | b[1:]]
        first[edges] = True
        first[-1] = False
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(b))
        h = self._hashes(b, starts, ends)
        order = np.argsort(h)
        ordered = h[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        keys, inverse = ordered[new], np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        example = order[new]

        def fragments(chosen):
            return [data[i:j] for i, j in zip(starts[chosen].tolist(), ends[chosen].tolist())]

        at, known = self._lookup(keys)
        kept = True
        if not known.all():
            kept = self._learn(keys[~known], fragments(example[~known]))
            if not kept:
                self._forget()
                kept = self._learn(keys, fragments(example))
            at, _ = self._lookup(keys)
        if kept:
            text, ids, places, sizes, run_starts, run_counts = (
                self.text, self.ids, self.places[at], self.sizes[at], self.starts[at],
                self.counts[at])
        else:
            ids, run_starts, run_counts = self._merged(fragments(example))
            text, places, sizes = b, starts[example], (ends - starts)[example]
        ids, run_starts, run_counts = self._checked(
            b, starts, ends, text, places[inverse], sizes[inverse], ids, run_starts[inverse],
            run_counts[inverse], fragments)
        total = np.concatenate([[0], np.cumsum(run_counts)])
        return ids[ragged(run_starts, run_counts)], total[np.searchsorted(starts, edges[1:])]

    def _checked(self, b, starts, ends, text, places, sizes, ids, run_starts, run_counts,
                 fragments):
        """Where the fragment that a hash found has other bytes, the right ids instead."""
        own = ends - starts
        other = own != sizes
        at = np.repeat(np.where(other, starts, places) - starts, own) + np.arange(len(b))
        if other.any():  # of another length: compared with itself, as it is replaced anyway
            alike = np.repeat(other, own)
            at[alike] = 0
            alike |= text[at] == b
        else:
            alike = text[at] == b
        other |= ~np.logical_and.reduceat(alike, starts)
        wrong = np.flatnonzero(other)
        if len(wrong):
            more, begins, counts = self._merged(fragments(wrong))
            run_starts, run_counts = run_starts.copy(), run_counts.copy()
            run_starts[wrong], run_counts[wrong] = begins + len(ids), counts
            ids = np.concatenate([ids, more])
        return ids, run_starts, run_counts

    def encode(self, texts):
        """Ids of each text as an array; the text of a special token becomes its id."""
        plain, plan = [], []
        for text in texts:
            own = [text]
            for token in self.special if "<|" in text else ():
                own = [y for x in own for y in (
                    _around(x, token) if x not in self.special else [x])]
            plan.append(own)
            plain += [x for x in own if x not in self.special]
        found = []
        for start, end in pieces(plain):
            ids, ends = self._encode(plain[start:end])
            found += np.split(ids, ends[:-1])
        found = iter(found)
        return [_joined([self.special[x] if x in self.special else next(found) for x in own])
                for own in plan]


def _around(text, token):
    parts = text.split(token)
    return [y for x in parts[:-1] for y in (x, token)] + parts[-1:]


def _joined(arrays):
    return arrays[0] if len(arrays) == 1 else np.concatenate(arrays)
