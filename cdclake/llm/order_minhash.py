"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is a sequence of words, words over 24 characters cut into pieces of 8; its k-mers are
runs of `k` words, each numbered by how often it occurred before. A hash deals the numbered
k-mers into `bins`; of each bin the `keep` smallest are taken, put back into text order and
hashed together. Two texts agree in a bin if they share these k-mers in the same order, so
the likeness falls with edit distance, not only with the words that differ.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cdclake.llm.common import checkpointed, same

K, BINS, KEEP = 2, 64, 2
PLACE_BITS = 28                                    # positions; the other 36 bits are a hash
PLACE = (1 << PLACE_BITS) - 1


def _hash_part(x):
    return x.bitwiseAND(F.lit(~PLACE))


def with_fingerprint(df, text, name, k=K, bins=BINS, keep=KEEP):
    """`df` with an array column: one number per bin that has k-mers, the bin in the upper
    bits and 16 bits of the hash below; empty for a NULL text or one without words.

    Every step is a projection of its own that refers to the one before several times, so
    that the planner computes each of them once.
    """
    columns, shift = df.columns, 64 - (bins - 1).bit_length()
    if bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    step = iter(n for n in (f"_omh{i}" for i in range(1000)) if n not in columns)
    words, sorted_, runs, numbered, chosen, firsts = (next(step) for _ in range(6))

    def bin_of(x):
        return F.shiftrightunsigned(x, shift)

    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "\n\t\r", "   ")
    split = F.filter(F.split(plain, " ", -1), lambda w: w != "")
    long = F.flatten(F.transform(split, lambda w: F.when(F.length(w) <= 24, F.array(w)).otherwise(
        F.regexp_extract_all(w, F.lit(r"(?s).{1,8}"), F.lit(0)))))
    df = df.withColumn(words, F.when(plain.rlike("[^ ]{25}"), long).otherwise(split))
    # k-mers by hash, then by position.
    df = df.withColumn(sorted_, F.sort_array(F.transform(words, lambda w, i: _hash_part(
        F.xxhash64(w, *[F.get(F.col(words), i + j) for j in range(1, k)])).bitwiseOR(
            i.cast("bigint")))))
    here, size = F.col(sorted_), F.size(sorted_)
    df = df.withColumn(runs, F.when(size > 0, F.filter(
        F.sequence(F.lit(0), size - 1), lambda j: (j == 0) | (
            _hash_part(F.get(here, j)) != _hash_part(F.get(here, j - 1))))).otherwise(
                F.array().cast("array<int>")))
    # The same k-mers hashed with their number, then sorted again.
    run_end = lambda r: F.coalesce(F.get(F.col(runs), r + 1), size)
    df = df.withColumn(numbered, F.sort_array(F.flatten(F.transform(runs, lambda s, r: F.transform(
        F.slice(here, s + 1, run_end(r) - s), lambda x, o: _hash_part(
            F.xxhash64(_hash_part(x), o)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))))))))
    order = F.col(numbered)
    df = df.withColumn(chosen, F.filter(order, lambda x, j: (j < keep) | (
        bin_of(x) != bin_of(F.get(order, j - keep)))))
    picked = F.col(chosen)
    df = df.withColumn(firsts, F.filter(
        F.transform(picked, lambda x, j: F.when((j == 0) | (
            bin_of(x) != bin_of(F.get(picked, j - 1))), j)), lambda j: j.isNotNull()))
    first_end = lambda r: F.coalesce(F.get(F.col(firsts), r + 1), F.size(chosen))

    def signed(f, r):
        own = F.slice(picked, f + 1, first_end(r) - f)
        placed = F.sort_array(F.transform(own, lambda x: F.shiftleft(
            x.bitwiseAND(F.lit(PLACE)), 64 - PLACE_BITS).bitwiseOR(
                F.shiftrightunsigned(x, PLACE_BITS))))
        text_order = F.transform(placed, lambda x: x.bitwiseAND(F.lit((1 << 36) - 1)))
        return (F.shiftleft(bin_of(F.get(picked, f)).cast("int"), 16).bitwiseOR(
            F.xxhash64(text_order).bitwiseAND(F.lit(0xFFFF)).cast("int")))

    return df.select(*columns, F.transform(firsts, signed).alias(name))


def likeness(a, b):
    """Share of the bins used by either text in which both agree; 1 for two empty ones."""
    bins = [F.transform(x, lambda v: F.shiftright(v, 16)) for x in (a, b)]
    either = F.size(F.array_union(*bins))
    return F.when(either == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / either)


def written(fingerprint):
    """Four hexadecimal digits of the bin and hash of each part, in a row."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.lpad(F.hex(v), 6, "0"))), "")


def following(keys, key):
    """Each row of `keys`, distinct by the columns `key`, with the key of the next one as
    `next_...`, by these columns descending; after the last comes the first.

    The rows are cut into ranges, and rows at the end of a range look up the first row of
    the next one, so no task sees more than a range.
    """
    order = [F.col(c).desc_nulls_last() for c in key]
    width = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(keys.repartitionByRange(width, *order)
                       .withColumn("_range", F.spark_partition_id()))
    this = F.struct(*key)
    within = Window.partitionBy("_range").orderBy(*order)
    marked = cut.withColumn("_next", F.lead(this).over(within)).withColumn(
        "_place", F.row_number().over(within))
    # One row per range; as many as there are shuffle partitions at most.
    firsts = marked.where("_place = 1").select("_range", this.alias("_first"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("_range")
    all_ranges = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("_range", F.coalesce(
        F.lead("_first").over(by_range), F.first("_first").over(all_ranges)).alias("_after"))
    joined = marked.join(after, "_range").withColumn("_next", F.coalesce("_next", "_after"))
    return joined.select(*keys.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in key])


def edits(docs, k=K, bins=BINS, keep=KEEP):
    """Fingerprints of all rows and of their edited texts: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text ends, in place of its last floor(n_chars / 3) code points, in the first
    as many (or all) of the next document, by descending doc_id and, among rows that share
    one, by a hash of the text; a NULL id is the last, and after the last comes the first. A
    NULL text is empty. A row that repeats is one document for this order and is answered as
    often as it is there. Equal texts have equal fingerprints. Other columns play no part.

    The texts move once, by their key, and of the next document only what the edit needs.
    """
    key = ["doc_id", "h"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    marks = checkpointed(with_fingerprint(rows, "text", "mark", k, bins, keep).select(
        *key, F.char_length("text").alias("n"), "mark").dropDuplicates(key))
    pairs = following(marks.select(*key, "n"), key).withColumn(
        "need", F.floor(F.col("n") / 3).cast("int"))
    by_next = (F.col("t.doc_id").eqNullSafe(F.col("p.next_doc_id"))
               & F.col("t.h").eqNullSafe(F.col("p.next_h")))
    marks = marks.select(*key, "mark")
    after = (marks.alias("t").join(pairs.alias("p"), by_next)
             .select("p.doc_id", "p.h", F.col("t.mark").alias("next_mark")))
    given = (rows.alias("t").join(pairs.alias("p"), by_next)
             .select("p.doc_id", "p.h", "p.n", "p.need",
                     F.expr("substring(t.text, 1, p.need)").alias("ending"))
             .dropDuplicates(key))
    both = (rows.alias("r").join(given.alias("g"), same("r", "g", key))
            .join(marks.alias("m"), same("r", "m", key))
            .join(after.alias("a"), same("r", "a", key))
            .select("r.doc_id", "g.n", "m.mark", "a.next_mark", F.concat(
                F.expr("substring(r.text, 1, g.n - g.need)"), "g.ending").alias("edited")))
    marked = with_fingerprint(both, "edited", "edited_mark", k, bins, keep)
    return marked.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), written(F.col("mark")).alias("fingerprint"),
        written(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"))
