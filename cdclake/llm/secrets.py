"""Secrets in texts: patterns for the known forms, and a linear-chain conditional random field
that tags each token as beginning, inside or outside a secret, for forms like them.

The field learns from what the patterns mark in a bounded sample. Its features are the shape
of a token, the tokens around it and those of the file. Tokens whose score for "outside"
exceeds the others by more than any transition can make up are outside on the best path
whatever stands around them; Viterbi decoding runs between these.
"""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from cdclake.llm.common import map_batches, pieces, ship

# The patterns of the base kinds and the least length of what they must match.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LIKELY = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
          r"|(?-i)AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
MASK = "[SECRET]"


def base_spans(text):
    """(start, end, kind, start of the secret itself) of all matches, by start and kind."""
    found, small = [], text.lower()
    if any(word in small for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), 1, m.start()) for m in ACCESS.finditer(text)]
    if max(map(len, text.split()), default=0) >= 24:
        found += [(*m.span(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


@dataclass(frozen=True)
class Settings:
    """About `documents` texts, half of them with a pattern, are learned from, of each a
    stretch of at most `longest` characters; `windows` sequences of `length` tokens at most
    are trained on. Decoding is of whole texts."""
    documents: int = 600
    longest: int = 50_000
    windows: int = 2500
    length: int = 48
    epochs: int = 40
    rate: float = 0.3
    penalty: float = 1e-4
    seed: int = 5


B, I, O = range(3)                                     # noqa: E741
# Kinds of characters: white space, lower, upper, digit, joining sign, other sign, other letter.
_KINDS = []


def character_kinds():
    if not _KINDS:
        kinds = np.full(0x110000, 5, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                kinds[i] = 0
            elif c.isalnum():
                kinds[i] = 6
        for i in range(128):
            c = chr(i)
            kinds[i] = (0 if c.isspace() else 1 if c.islower() else 2 if c.isupper() else
                        3 if c.isdigit() else 4 if c in "+/_.-" else 5)
        _KINDS.append(kinds)
    return _KINDS[0]


# By kind: the group whose runs are tokens, and counters of 12 bits that add up in one sum;
# tokens too long for them are counted anew.
GROUPS = np.array([0, 1, 1, 1, 1, 2, 1], np.uint8)
COUNTERS = np.array([0, 1, 1 << 12, 1 << 24, 1 << 36, 1 << 36, 1 << 36], np.uint64)
TURN = np.uint64(1 << 48)
SHAPES, COARSE, WORDS = 10 * 5 * 4 * 7, 4 * 3 * 2, 1 << 13
SIZES = (1, SHAPES, 27 * 10, 6 * 4 * 5, WORDS, WORDS, WORDS, WORDS * 5, COARSE ** 3, 168 * COARSE)
OFFSETS = np.cumsum((0, *SIZES))
BASE = 0x9E3779B97F4A7C15
_POWERS = []


def powers(n):
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        _POWERS[:] = [np.full(size, x, np.uint64).cumprod(dtype=np.uint64)
                      for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS


def features(texts):
    """(text number, start, end, rows) of all tokens of some texts: runs of word characters
    and joining signs, and runs of other signs. `rows[k]` is each token's value of feature k
    as a row of the weights. No feature looks beyond its text."""
    codes = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    edges = np.cumsum([0, *map(len, codes)])
    codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    none = np.zeros(0, np.int64)
    kinds = character_kinds()[codes]
    group = GROUPS[kinds]
    first = np.zeros(len(codes) + 1, bool)
    first[1:-1] = group[1:] != group[:-1]
    first[edges] = True
    bounds = np.flatnonzero(first)
    kept = group[bounds[:-1]] > 0 if len(codes) else none.astype(bool)
    starts, ends = bounds[:-1][kept], bounds[1:][kept]
    n = len(starts)
    if not n:
        return none, none, none, np.zeros((len(SIZES), 0), np.int64)
    owner = np.searchsorted(edges, starts, "right") - 1
    size = ends - starts
    total = np.zeros(len(codes) + 1, np.uint64)
    turn = (kinds[1:] == 3) != (kinds[:-1] == 3)         # digits and others taking turns
    turn &= (group[1:] == 1) & ~first[1:-1]
    step = COUNTERS[kinds]
    step[1:] += turn * TURN
    np.cumsum(step, out=total[1:])
    counts = total[ends] - total[starts]
    lower, upper, digit, sign, turns = (
        ((counts >> np.uint64(12 * k)) & np.uint64(4095)).astype(np.int64) for k in range(5))
    for i in np.flatnonzero(size > 4095):
        a, b = starts[i], ends[i]
        seen = np.bincount(kinds[a:b], minlength=7)
        lower[i], upper[i], digit[i], sign[i] = *seen[1:4], seen[4:].sum()
        turns[i] = np.count_nonzero(step[a:b] >= TURN)
    up, down = powers(len(codes))
    small = (codes | ((kinds == 2).astype(np.uint32) << np.uint32(5))).astype(np.uint64)
    small *= up[:len(codes)]
    np.cumsum(small, out=total[1:])
    word = (total[ends] - total[starts]) * down[starts]
    word = ((word ^ (word >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(51)
    word = word.astype(np.int64)
    word[size > 20] = 1                                  # long tokens count by shape alone

    def shift(x, by):
        """`x` of the token `by` places before (after, if negative); 0 beyond the text."""
        out = np.zeros_like(x)
        if 0 < by < n:
            out[by:] = np.where(owner[by:] == owner[:-by], x[:-by], 0)
        elif 0 < -by < n:
            out[:by] = np.where(owner[:by] == owner[-by:], x[-by:], 0)
        return out

    long = np.minimum(size, 24) + (size > 31) + (size > 39)
    digits = np.minimum(digit * 4 // size, 4)
    case = (lower > 0) * 2 + (upper > 0)
    turns = np.minimum(turns, 13)
    shape = ((np.minimum(long // 3, 9) * 5 + digits) * 4 + case) * 7 + turns // 2
    coarse = (np.minimum(long // 7, 3) * 3 + np.minimum(digits, 2)) * 2 + (case > 0)
    wordy = (lower + upper + digit > 0) & (size <= 20)
    last = np.maximum.accumulate(np.where(wordy, np.arange(n), -1))
    before = np.concatenate([[-1], last[:-1]])
    there = (before >= 0) & (owner[before] == owner)
    near = np.where(there, word[before], 0) * 5 + np.where(
        there, np.minimum(np.arange(n) - before, 4), 0)
    m = len(texts)
    of_text = np.maximum(np.bincount(owner, size, m), 1)
    density = np.minimum(np.bincount(owner, digit, m) * 20 // of_text, 20).astype(np.int64)
    capitals = np.minimum(np.bincount(owner, upper, m) * 7 // of_text, 7).astype(np.int64)
    file = density * 8 + capitals
    columns = (np.zeros(n, np.int64), shape, long * 10 + np.minimum(turns, 9),
               (np.minimum(sign, 5) * 4 + case) * 5 + digits, word, shift(word, 1),
               shift(word, -1), near, (shift(coarse, 1) * COARSE + shift(coarse, 2)) * COARSE
               + coarse, file[owner] * COARSE + coarse)
    rows = np.stack([c + o for c, o in zip(columns, OFFSETS)])
    return owner, starts - edges[owner], ends - edges[owner], rows


@dataclass(frozen=True)
class Model:
    weights: np.ndarray       # one row of three for each value of each feature
    moves: np.ndarray         # (3, 3), from and to
    margin: float


def tags(text, starts, ends):
    """The tags that the patterns give to the tokens of a text."""
    out = np.full(len(starts), O)
    for _, end, _, start in base_spans(text):
        inside = np.flatnonzero((ends > start) & (starts < end))
        if len(inside):
            out[inside] = I
            out[inside[0]] = B
    return out


def fit(texts, settings=Settings()):
    """Weights by gradient steps on the likelihood of the tags, over all windows at once."""
    s, rng = settings, np.random.default_rng(settings.seed)
    marked, plain = [], []
    for text in texts:
        _, starts, ends, rows = features([text])
        y = tags(text, starts, ends)
        for at in range(0, len(y), s.length):
            own = rows[:, at:at + s.length], y[at:at + s.length]
            (marked if (own[1] != O).any() else plain).append(own)
    if not marked:
        return None
    rng.shuffle(plain)
    rng.shuffle(marked)
    chosen = marked[:s.windows // 2]
    chosen += plain[:s.windows - len(chosen)]
    n = len(chosen)
    x = np.zeros((len(SIZES), s.length, n), np.int64)
    y, real = np.full((s.length, n), O), np.zeros((s.length, n), bool)
    for i, (rows, own) in enumerate(chosen):
        x[:, :len(own), i], y[:len(own), i], real[:len(own), i] = rows, own, True
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(len(SIZES), s.length, n)
    weights, moves = np.zeros((len(used), 3)), np.zeros((3, 3))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full((3, 3), 1e-8)
    target, both = np.eye(3)[y], real[1:] & real[:-1]
    observed = np.einsum("tni,tnj,tn->ij", target[:-1], target[1:], both)
    for _ in range(s.epochs):
        score = weights[x].sum(0)
        forward, backward = score.copy(), np.zeros_like(score)
        for t in range(1, s.length):
            step = _log_sum(forward[t - 1][:, :, None] + moves, 1) + score[t]
            forward[t] = np.where(real[t][:, None], step, forward[t - 1])
        for t in range(s.length - 2, -1, -1):
            step = _log_sum(moves + (score[t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t] = np.where(real[t + 1][:, None], step, backward[t + 1])
        total = _log_sum(forward[-1], 1)
        p = np.exp(forward + backward - total[:, None])
        pair = np.exp(forward[:-1][:, :, :, None] + moves
                      + (score[1:] + backward[1:])[:, :, None, :] - total[:, None, None])
        expected = (pair * both[:, :, None, None]).sum((0, 1))
        change = ((target - p) * real[:, :, None]).reshape(-1, 3)
        g = np.stack([sum(np.bincount(x[k].ravel(), change[:, c], len(used))
                          for k in range(len(SIZES))) for c in range(3)], 1) / n
        g -= s.penalty * weights
        m = (observed - expected) / n - s.penalty * moves
        seen_w += g * g
        seen_m += m * m
        weights += s.rate * g / np.sqrt(seen_w)
        moves += s.rate * m / np.sqrt(seen_m)
    table = np.zeros((OFFSETS[-1], 3), np.float32)
    table[used] = weights
    return Model(table, moves, certain_margin(moves))


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def viterbi(score, moves):
    """The best tags of one sequence; of equal paths the one with the lower tag."""
    best, back = score[0], []
    for row in score[1:]:
        options = best[:, None] + moves
        back.append(options.argmax(axis=0))
        best = options.max(axis=0) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def certain_margin(moves):
    """More than any choice of neighbours can gain by leaving the tag O."""
    gain = [(moves[a, y] + moves[y, b]) - (moves[a, O] + moves[O, b])
            for a in range(3) for b in range(3) for y in (B, I)]
    return max(0.0, *gain, *(moves[:, [B, I]] - moves[:, [O]]).ravel(),
               *(moves[[B, I]] - moves[[O]]).ravel())


def tagged_spans(model, texts):
    """For each text (start, end) of each run of tokens from a beginning, or from an inside
    that follows an outside."""
    owner, starts, ends, rows = features(texts)
    out = [[] for _ in texts]
    if not len(starts):
        return out
    score = model.weights[rows[0]]
    for row in rows[1:]:
        score += model.weights[row]
    unsure = np.flatnonzero(score[:, O] - score[:, :O].max(1) <= model.margin)
    gaps = np.flatnonzero((np.diff(unsure) > 1) | np.diff(owner[unsure]).astype(bool)) + 1
    for run in np.split(unsure, gaps) if len(unsure) else ():
        text, first, last = owner[run[0]], run[0], run[-1] + 1
        first -= first > 0 and owner[first - 1] == text
        last += last < len(owner) and owner[last] == text
        open_ = None
        for i, tag in enumerate(viterbi(score[first:last], model.moves), first):
            if tag == O:
                open_ = None
            elif tag == B or open_ is None:
                open_ = [int(starts[i]), int(ends[i])]
                out[text].append(open_)
            else:
                open_[1] = int(ends[i])
    return out


def outside(text, tagged, base):
    """What the tagged spans cover beyond the base spans, both by start: one sweep over both.
    A remainder without a letter or digit is punctuation around a secret and no span."""
    out, i = [], 0
    for a, b in tagged:
        while i < len(base) and base[i][1] <= a:
            i += 1
        at, k = a, i
        while at < b:
            end = min(b, base[k][0]) if k < len(base) else b
            part = text[at:end]
            if any(c.isalnum() for c in part):
                out.append((end - len(part.lstrip()), at + len(part.rstrip()), 3))
            if end == b:
                break
            at, k = max(at, base[k][1]), k + 1
    return out


def joined(spans):
    """(start, end) of the stretches that spans by start cover together."""
    out = []
    for a, b, *_ in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def find(model, texts):
    """For each text all spans (start, end, kind) by start, then kind: what the patterns
    match, and of what the field tags besides the parts that none of these covers."""
    out = []
    for at, to in pieces(texts, 200_000):
        some = texts[at:to]
        extra = tagged_spans(model, some) if model else [()] * len(some)
        for text, tagged in zip(some, extra):
            base = [(a, b, k) for a, b, k, _ in base_spans(text)]
            own = outside(text, tagged, joined(base))
            out.append(sorted(base + own, key=lambda x: (x[0], x[2])))
    return out


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def train(docs, settings=Settings()):
    """A field from the `text` of a bounded sample, or None if no row has a secret.

    Rows with a pattern come from the whole table: `documents` / 2 different texts at most,
    those least by a hash; as many without one are drawn by the same hash. So the field does
    not depend on partitions, on repeated rows or on how rare secrets are. Of a text over
    `longest` characters a stretch is learned from, around its first match if there is one.
    NULL texts play no part.
    """
    s = settings
    draw = F.pmod(F.xxhash64(F.lit(s.seed), "text"), F.lit(1 << 48))
    rows = docs.select("text").where("text IS NOT NULL").withColumn("draw", draw)
    found = F.regexp_instr("text", F.lit(LIKELY))
    last = (rows.where(found > 0).select("draw").distinct().orderBy("draw")
            .limit(max(1, s.documents // 2)).agg(F.max("draw").alias("last")).first()["last"])
    if last is None:
        return None
    few = int(min(1.0, s.documents / 2 / docs.count()) * (1 << 48))
    size = F.char_length("text")
    at = F.when(F.col("found") > 0, F.greatest(F.lit(1), F.col("found") - s.longest // 2)) \
        .otherwise(1 + F.pmod("draw", F.greatest(F.lit(1), size - s.longest + 1)))
    chosen = (rows.where((F.col("draw") <= last) | (F.col("draw") < few))
              .withColumn("found", found)
              .where(F.when(F.col("found") > 0, F.col("draw") <= last)
                     .otherwise(F.col("draw") < few))
              .select("draw", F.substring("text", at.cast("int"), F.lit(s.longest)).alias("text"))
              .groupBy("draw").agg(F.max("text").alias("text")))
    return fit(sorted(r["text"] for r in chosen.collect()), s)


def scan(docs, model):
    """doc_id, n_assign, n_access, n_hex, base and spans of every row; the last two as
    kind:start:end by start, comma-joined, in code points with the end exclusive.

    A NULL or empty text has no span. Texts are scanned whole; repeated rows are answered
    one by one; other columns play no part. Without a model only the patterns are used.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # rows: sum of SIZES

    def run(batch):
        out = {"doc_id": batch.column(0), "n_assign": [], "n_access": [], "n_hex": [],
               "base": [], "spans": []}
        for spans in find(shared.value, [t or "" for t in batch.column(1).to_pylist()]):
            base = [x for x in spans if x[2] < 3]
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[2] == k for x in base))
            out["base"].append(written(base))
            out["spans"].append(written(spans))
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_assign long, "
                       "n_access long, n_hex long, base string, spans string", run)


def masked(text, spans, mask=MASK):
    """The text with every span replaced; overlapping spans count as one."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs, model, mask=MASK):
    """All rows and columns, with secrets in `text` replaced and `n_chars`, where there is
    such a column, set to the new length of texts that changed. A NULL text stays NULL."""
    import pyarrow as pa
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), docs.columns
    length = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            spans = find(shared.value, [t or "" for t in old])
            new = [t and masked(t, own, mask) for t, own in zip(old, spans)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                known = batch.column(length).to_pylist()
                columns[length] = pa.array([n if a == b else len(b) for n, a, b in
                                            zip(known, old, new)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
