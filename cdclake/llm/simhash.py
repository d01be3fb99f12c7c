"""Near copies by SimHash: fingerprints of word shingles, linked at a few differing bits.

The links are found by segment popcounts. A fingerprint is cut into 32 segments of two bits;
the number of ones in each (0, 1 or 2) is a point of a grid, and two fingerprints are at
least as far apart in bits as their points are in Manhattan distance. Points within 3 of
each other are within 1 of each other in the first or in the second 16 dimensions, so the
range join looks into a cell and its upper neighbours along each axis, half by half; then
the distance over all dimensions is checked, and last the bits themselves.
"""

import numpy as np
from pyspark.sql import functions as F

from cdclake.llm.common import checkpointed, components, map_batches, ship

SHINGLE, MAX_BITS, SEED = 3, 3, 42
AXES = 16                                # two-bit segments of each half
EVEN = 0x5555555555555555
CHUNK = 1 << 16
HASHES = ("hash_1", "hash_2")


def shingle_hashes(text, size=SHINGLE):
    """XXH64 of each shingle; ASCII letters in lower case, words between ASCII white space."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    return [xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)]


def fingerprint(text, size=SHINGLE):
    """64 bits as a signed number: those set in more than half the shingles; 0 for none."""
    hashes = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at:at + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs, size=SHINGLE, hashed=False):
    """doc_id and fp of every row, with two hashes of the text if `hashed`."""
    ship(docs.sparkSession)
    hashes = HASHES if hashed else ()

    def run(batch):
        return {"doc_id": batch.column(0),
                "fp": [fingerprint(t, size) for t in batch.column(1).to_pylist()],
                **{name: batch.column(i) for i, name in enumerate(hashes, 2)}}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "text", *[h.alias(n) for n, h in text_hashes().items() if n in hashes]),
        ", ".join([f"doc_id {kind}", "fp long", *[f"{n} long" for n in hashes]]), run)


def text_hashes():
    """Two hashes of a text by name: 128 bits, so that different texts do not share both."""
    return dict(zip(HASHES, (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))))


def points(fps):
    """Popcounts of the segments in unary code: the bits of every segment, sorted. The
    Manhattan distance of two points is then the number of differing bits of the codes."""
    x = F.col("fp")
    right = F.shiftrightunsigned(x, 1)
    some = x.bitwiseOR(right).bitwiseAND(F.lit(EVEN))
    both = x.bitwiseAND(right).bitwiseAND(F.lit(EVEN))
    return fps.select("fp", some.bitwiseOR(F.shiftleft(both, 1)).alias("at"))


def links(fps, max_bits=MAX_BITS):
    """Pairs (a, b), a < b, of different fingerprints with at most `max_bits` (up to 3)
    differing bits. `fps` has one row per fingerprint."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the two halves find up to 3 differing bits")
    mask = F.lit(0xFFFFFFFF)
    halves = points(fps).select("fp", "at", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("at").bitwiseAND(mask).alias("cell")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("at", 32).alias("cell")),
    )).alias("h")).select("fp", "at", "h.half", "h.cell")
    # One step up along an axis: 00 -> 01 -> 11; full segments have none.
    steps = F.array(F.col("cell"), *[
        F.when(F.col("cell").bitwiseAND(F.lit(2 << 2 * i)) == 0,
               F.col("cell").bitwiseOR(F.when(
                   F.col("cell").bitwiseAND(F.lit(1 << 2 * i)) == 0, F.lit(1 << 2 * i))
                   .otherwise(F.lit(2 << 2 * i)))) for i in range(AXES)])
    probes = (halves.withColumn("to", F.explode(steps)).where("to IS NOT NULL")
              .select("half", "to", F.col("fp").alias("x"), F.col("at").alias("x_at"),
                      (F.col("to") == F.col("cell")).alias("home")))
    cells = halves.select("half", F.col("cell").alias("to"), F.col("fp").alias("y"),
                          F.col("at").alias("y_at"))
    apart = F.bit_count(F.col("x_at").bitwiseXOR(F.col("y_at")))
    in_first = F.bit_count(F.col("x_at").bitwiseXOR(F.col("y_at")).bitwiseAND(mask))
    met = (probes.join(cells, ["half", "to"])
           .where((F.col("x") != F.col("y")) & (~F.col("home") | (F.col("x") < F.col("y"))))
           .where((F.col("half") == 0) | (in_first > 1))    # each pair in one half only
           .where(apart <= max_bits)
           .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def rooted(found, value, max_bits=MAX_BITS):
    """fp, first (the least `value` of its rows) and root, the smallest fingerprint reachable
    over links, of every different fingerprint of `found`."""
    nodes = checkpointed(found.groupBy("fp").agg(F.min(value).alias("first")))
    roots = components(links(nodes.select("fp"), max_bits))
    return (nodes.join(roots, nodes["fp"] == roots["node"], "left")
            .select("fp", "first", F.coalesce("root", "fp").alias("root")))


def groups(docs, size=SHINGLE, max_bits=MAX_BITS):
    """doc_id, fp and component_id, the smallest id reachable over links, of every row.

    A NULL or empty text has no shingle and fingerprint 0, which links as any other. Equal
    fingerprints are one node, however many documents share it, so copies are never
    paired. A row without an id gets the smallest id of its group, NULL if there is none;
    repeated rows are answered one by one. Other columns play no part.
    """
    found = checkpointed(fingerprints(docs, size))
    placed = rooted(found, F.col("doc_id"), max_bits)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one_of_each(docs, size=SHINGLE, max_bits=MAX_BITS):
    """Of each group the row with the smallest id, all columns as they are.

    Rows without an id come after all others. Of rows that share the smallest id of their
    group that whose text has the smallest hashes stays, of those that share the text too any
    one. Unrelated texts under one id are in different groups and all stay.
    """
    found = checkpointed(fingerprints(docs, size, hashed=True))
    placed = rooted(found, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *HASHES),
                    max_bits)
    key = next(n for n in ("_key", "_key_of_row", "_key_of_row_") if n not in docs.columns)
    least = placed.groupBy("root").agg(F.min("first").alias("first"))
    chosen = least.select(F.struct("first.doc_id", *[f"first.{h}" for h in HASHES]).alias(key))
    own = F.struct("doc_id", *[h.alias(n) for n, h in text_hashes().items()])
    # Struct keys: NULL ids are equal. Both steps use the same key, so texts move once.
    kept = docs.withColumn(key, own).join(chosen, key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
