"""What the operators share: tables, id remainders, Arrow passes, checkpoints, components."""

import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cdclake.session import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])
SUB_BATCH_CHARS = 500_000


def ship(spark):
    """Let Python workers import this package from where the driver has it.

    A cluster whose machines do not have that folder gets the package by --py-files.
    """
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def read(spark, sf_dir, table):
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(column, divisor):
    """crc32 of an id as text, modulo a divisor; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def checkpointed(df):
    """Written to the folder of `spark.checkpoint.dir` and cut from its lineage.

    The files stay until the folder is cleared, or until Spark's cleaner finds that nothing
    refers to them, where `spark.cleaner.referenceTracking.cleanCheckpoints` is set.
    """
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def map_batches(df, schema, function):
    """`function(RecordBatch) -> dict of columns`, batch by batch; columns as in `schema`."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = [f.name for f in schema]
    types = [arrow_type(f) for f in schema]

    def run(batches):
        for batch in batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t)
                 for c, t in ((columns[n], t) for n, t in zip(names, types))], names=names)

    return df.mapInArrow(run, schema)


def arrow_type(field: StructField):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(field.dataType)


def filter_batches(df, column, accept):
    """Rows of `df`, all columns as they are, whose text `accept(texts) -> bools` keeps."""
    position = df.columns.index(column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(accept(batch.column(position).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pieces(texts, size=SUB_BATCH_CHARS):
    """Slices of a list of texts with about `size` characters each, whole texts only."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def same(left, right, columns):
    """Join condition on columns of two aliased frames that are equal or both NULL."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


def _state(edges):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                    .alias("h")).head()
    return row["n"], row["h"]


def components(edges):
    """(node, root) for every node of an undirected graph of edges (a, b); root is the
    smallest node reachable.

    Alternates two steps on edges that point from larger to smaller nodes: all larger
    neighbours of a node move to its smallest neighbour, then all smaller ones do. The
    paths halve, so the number of rounds is near the logarithm of the longest path. Each
    step is one aggregation and one join, which the planner can split at a hot node; no
    node's neighbours are gathered. Every round is checkpointed.
    """
    u, v = F.col("u"), F.col("v")
    now = checkpointed(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select(v.alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        now, before = checkpointed(small), state
        state = _state(now)
        if state == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(v.alias("node"), v.alias("root")).distinct())
