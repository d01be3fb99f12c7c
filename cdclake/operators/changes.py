"""Change events: decoding, snapshots and differences."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdclake.functions.images import row_image

# Fixed value: topics are named <prefix><table>.
TOPIC_PREFIX = "ecom.public."

_IMAGE = "op STRING, ts_ms STRING, before STRING, after STRING"
ENVELOPE = f"{_IMAGE}, payload STRUCT<{_IMAGE.replace(' STRING', ': STRING')}>"


def decode_envelope(raw, prefix=TOPIC_PREFIX, keep_delete_image=False, sequence=None):
    """Broker records (topic, value) -> bronze rows.

    The change fields sit at the top level or under `payload`, by the sender's
    converter; each record is parsed once for both. Records without a value keep their
    row with NULL fields; records of other topics go. A delete carries no `after`; with
    `keep_delete_image` its `before` takes that place, so that deletes can be applied.
    `sequence` names a column of the records that grows within a key, such as the broker's
    offset; it becomes `seq` and settles equal times.
    """
    pattern = "^.*?" + prefix.replace(".", r"\.") + "(.*)"
    change = F.from_json(F.col("value").cast("string"), ENVELOPE)
    seq = [F.col(sequence).cast("bigint").alias("seq")] if sequence else []
    rows = raw.select(F.regexp_extract("topic", pattern, 1).alias("table_name"),
                      change.alias("e"), *seq)

    def either(name):
        return F.coalesce(f"e.{name}", f"e.payload.{name}")

    after = either("after")
    if keep_delete_image:
        after = F.coalesce(after, F.when(either("op") == "d", either("before")))
    return rows.where(F.col("table_name") != "").select(
        "table_name",
        either("op").alias("op"),
        either("ts_ms").try_cast("bigint").alias("ts_ms"),
        after.alias("after"),
        F.current_timestamp().alias("ingest_ts"),
        *(["seq"] if sequence else []),
    )


def snapshot_to_changes(df, table, ts_ms, op="r", columns=None):
    """Initial snapshot: every row as one change event, a read unless `op` says otherwise."""
    op = op if hasattr(op, "cast") else F.lit(op)
    return df.select(
        F.lit(table).alias("table_name"),
        op.alias("op"),
        ts_ms.alias("ts_ms"),
        row_image(df, columns).alias("after"),
        F.current_timestamp().alias("ingest_ts"),
    )


def diff_to_changes(old, new, key):
    """Changes that lead from one snapshot to another: c, u and d events with both images.

    Both snapshots have the same columns and at most one row per key. Rows are compared
    null-safe, so a field going to or from NULL is an update.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = new.columns
    before, after = F.col("o"), F.col("n")
    same_key = reduce(and_, [before[k].eqNullSafe(after[k]) for k in keys])
    op = F.when(before.isNull(), "c").when(after.isNull(), "d").otherwise("u")
    # The images are written for rows that differ only, after the join.
    return (old.select(F.struct(*columns).alias("o"))
            .join(new.select(F.struct(*columns).alias("n")), same_key, "full_outer")
            .where(~before.eqNullSafe(after))
            .select(*[F.coalesce(after[k], before[k]).alias(k) for k in keys], op.alias("op"),
                    F.when(before.isNotNull(), row_image(old, columns, "o")).alias("before"),
                    F.when(after.isNotNull(), row_image(new, columns, "n")).alias("after")))


PART = "_part"


def with_part(df, key, parts):
    """`df` with the part its key falls into; stored by this column, a snapshot is read only
    where it differs. One that has the column keeps it."""
    keys = [key] if isinstance(key, str) else list(key)
    if PART in df.columns:
        return df
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def digests(df, key, parts=1024):
    """(part, rows, digest): what tells whether two snapshots agree on a part, whatever the
    order of their rows. The digest is 128 bits; NULLs count, nested values by their JSON."""
    df = with_part(df, key, parts)
    fields = [f for f in df.schema if f.name != PART]
    flat = [F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if isinstance(
        f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in fields]
    # A hash passes over NULLs, so which columns are NULL is hashed with them.
    flat.append(F.concat(*[F.col(f.name).isNull().cast("int").cast("string") for f in fields]))
    halves = [F.bit_xor(F.xxhash64(F.lit(seed), *flat)) for seed in (1, 2)]
    return df.groupBy(PART).agg(F.count("*").alias("rows"), F.array(*halves).alias("digest"))


def unequal_parts(old, new):
    """The parts in which two snapshots' digests differ; at most as many as there are parts."""
    both = old.alias("o").join(new.alias("n"), PART, "full_outer")
    return sorted(r[PART] for r in both.where(
        ~F.col("o.rows").eqNullSafe(F.col("n.rows"))
        | ~F.col("o.digest").eqNullSafe(F.col("n.digest"))).select(PART).collect())


def diff_by_digests(old, new, key, parts=1024, known=None):
    """`diff_to_changes` that shuffles only the parts whose digests differ.

    Each snapshot is read once for its digests, which leave a task as one row per part, and
    once for the rows of unequal parts; `known` are digests of `old` kept from the last time.
    For snapshots that differ little. The columns of `old` and `new` have the same types.
    """
    columns = [c for c in new.columns if c != PART]
    old, new = with_part(old, key, parts), with_part(new, key, parts)
    differ = unequal_parts(digests(old, key, parts) if known is None else known,
                           digests(new, key, parts))
    near = F.col(PART).isin(differ) if differ else F.lit(False)
    return diff_to_changes(old.where(near).select(*columns), new.where(near).select(*columns), key)
