"""From change logs to current state."""

from functools import reduce
from itertools import takewhile
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORE, APPLY, NONE = "ignore", "apply", None
PER_CUT = 40


def _names(value):
    return [value] if isinstance(value, str) else list(value)


def latest_by_key(log, key, order, deletes=IGNORE):
    """The newest row per key, by the `order` columns and then by all remaining ones.

    The remaining columns settle ties, so the result never depends on the order or the
    partitioning of the input. Deletes:

    * ignore - delete events are dropped first: a deleted key keeps its last row;
    * apply  - a key whose newest event is a delete goes;
    * None   - the log has no `op` column.

    Written as an aggregate: each task keeps one row per key before the shuffle, so the
    history of a hot key never meets in one task.
    """
    keys, order = _names(key), _names(order)
    rest = [c for c in log.columns if c not in keys and c not in order]
    if deletes == IGNORE:
        log = log.where(F.col("op") != "d")
    elif deletes == APPLY:
        log = log.where(F.col("op").isNotNull())
    newest = (log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_newest"))
              .select(*keys, "_newest.*").select(*log.columns))
    return newest.where(F.col("op") != "d") if deletes == APPLY else newest


def _places(log, keys, order, rest):
    """For each row the number of cuts at or before it along (keys, newest first).

    The cuts are evenly spaced rows of a sorted sample, about `PER_CUT` rows for each of as
    many cells as a shuffle has partitions, and enter the plan as values: every pass over
    the log finds the same cells, whatever its partitions. Columns of nested types, and all
    after them, do not cut.
    """
    kinds = {f.name: f.dataType for f in log.schema}
    by = list(takewhile(lambda c: isinstance(kinds[c], T.AtomicType), keys + order + rest))
    newer = [c for c in by if c not in keys]
    width = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, PER_CUT * width / max(log.count(), 1))
    sample = (log.select(*by).sample(share, seed=1)
              .orderBy(*[c for c in by if c in keys], *[F.col(c).desc_nulls_last() for c in newer])
              .collect()) if by else []
    step = max(1, -(-len(sample) // width))
    cuts = sample[step::step]
    if not cuts:
        return F.lit(0)

    def spot(value):
        """Keys and the rest apart, as one ascends and the other descends."""
        return F.struct(*[F.struct(*[value(c).cast(kinds[c]).alias(c) for c in part], F.lit(0))
                          .alias(name)
                          for name, part in (("k", [c for c in by if c in keys]), ("o", newer))])

    table = F.array(*[spot(lambda c, row=row: F.lit(row[c])) for row in cuts])
    row = spot(F.col)

    def passed(cut):
        return (cut["k"] < row["k"]) | ((cut["k"] == row["k"]) & (cut["o"] >= row["o"]))

    # Halving steps: the number of cuts passed grows by a step where the cut there is passed.
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def advance(at, step):
        there = at + step
        return F.when((there <= len(cuts)) & passed(F.get(table, there - 1)), there).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), advance)


def rank_changes(log, key, order, bucket=None, name="rn"):
    """row_number() per key, newest first, for histories of any length.

    The rows are cut into cells along (key, newest first) and ranked within (key, cell), so
    that the history of one hot key spreads over many tasks. The number of newer rows in
    other cells, known from a small count per cell, travels with each cell as one extra row
    and is added on.

    The cells are of about even size for any distribution, a hot key and ties of the order
    columns included; only rows equal in all columns stay together. A `bucket` column that
    grows with the leading `order` column, such as its day, cuts them further. The log is
    read once for the sample that gives the cuts, once for the counts and once for the
    ranks, and must hold the same rows each time; it is not written.
    """
    keys, order = _names(key), _names(order)
    rest = [c for c in log.columns if c not in keys and c not in order]
    newest_first = [F.col(c).desc_nulls_last() for c in order + rest]
    cell = -_places(log, keys, order, rest)
    rows = log.withColumn("_bucket", cell if bucket is None else F.struct(bucket, cell))
    later = (Window.partitionBy(*keys).orderBy(F.col("_bucket").desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
               .select(*keys, "_bucket",
                       F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_offset")))
    marked = (rows.withColumn("_offset", F.lit(None).cast("bigint"))
              .unionByName(offsets, allowMissingColumns=True))
    within = Window.partitionBy(*keys, "_bucket").orderBy(
        F.col("_offset").desc_nulls_last(), *newest_first)
    rank = F.row_number().over(within) - 1 + F.max("_offset").over(within)
    return (marked.withColumn(name, rank).where(F.col("_offset").isNull())
            .select(*log.columns, name))


def as_of(log, ts_ms):
    """The log as it stood at a point in time."""
    return log.where(F.col("ts_ms") <= ts_ms)


def upsert(current, changes, key, order, deletes=APPLY):
    """Current state after a batch of changes; columns as in `current`, one row per key.

    `changes` has `op` and the `order` columns. Where `current` has `op` and the order
    columns too, deletes stay in it as rows, and the result is that of the whole log, in
    whatever pieces and order it comes: `live` gives the rows that are not deleted. Where it
    only has the order columns, late changes lose against newer rows, but one older than the
    delete of its key brings the key back, as there is no row for it. Otherwise every change
    is newer.

    The changes are reduced to one per key first. The state then only meets them in semi
    and anti joins: a batch small enough to be broadcast leaves the state unshuffled.
    """
    keys, order = _names(key), _names(order)
    dated = set(order) <= set(current.columns)
    keeps = dated and "op" in current.columns
    kept = F.col("op") != "d" if deletes == IGNORE else F.col("op").isNotNull()
    columns = dict.fromkeys([*current.columns, *order, "op"])
    newest = latest_by_key(changes.where(kept).select(*columns), keys, order, NONE).alias("n")

    def same(left, right):
        return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])

    if dated:
        # With its deletes the state has all that settles ties in a log.
        by = order + [c for c in columns if c not in keys and c not in order] if keeps else order
        newer = (F.struct(*[F.col(f"s.{c}") for c in by])
                 > F.struct(*[F.col(f"n.{c}") for c in by]))
        late = current.alias("s").join(newest, same("s", "n") & newer, "left_semi")
        newest = newest.join(late.select(*keys).alias("l"), same("n", "l"), "left_anti").alias("n")
    rest = current.alias("s").join(newest, same("s", "n"), "left_anti")
    return rest.unionByName((newest if keeps else live(newest)).select(*current.columns))


def live(state):
    """The rows of a state that are not deletes."""
    return state.where(F.col("op") != "d")


def align(df, contract):
    """Columns and types of the contract: unknown columns go, missing ones are NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.type).alias(f.name)
        for f in contract.fields])
