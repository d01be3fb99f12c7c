"""Session settings, and the one shared folder that jobs may write interim data to."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the aggregation after it then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def get_session(app="cdclake", master=None, conf=None):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark):
    """Apply the settings the operators rely on to a session somebody else made."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


# Of files that the library writes for itself: about half of what the session's default takes.
CODEC = "zstd"


@contextmanager
def settings(spark, values):
    """Session settings for one job; what they were before comes back after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield spark
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark):
    """Folder every executor sees, as named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cdclake-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def shuffles_dropped(spark):
    """While this lasts, a query's shuffle files go as soon as it has ended, and not only when
    the driver happens to collect its garbage. For queries whose plans are run once; Spark
    before 4.1 passes over the setting."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def materialised(df, **options):
    """`df` written to the shared folder and read back.

    Cuts the plan, survives the loss of executors, and later reads take only the columns
    they need. The files stay until the folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/interim-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Hand rows to all cores before work that is heavy per row, if `df` has fewer
    partitions than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
