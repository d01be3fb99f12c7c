"""Rollups of metric samples (ts, metric, labels, value)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

SAMPLE_DDL = "ts TIMESTAMP, metric STRING, labels MAP<STRING, STRING>, value DOUBLE"


def _names(by):
    return [by] if isinstance(by, str) else list(by)


def with_series(samples):
    """Adds `series`, one text per metric and set of labels: maps cannot be grouped by."""
    labels = F.array_sort(F.map_entries("labels"))
    return samples.withColumn("series", F.to_json(F.struct("metric", labels.alias("labels"))))


def has_label(label):
    """Samples where a label is set and not empty."""
    return F.col("labels")[label] != ""


def counter_rate(samples, window_seconds=60, bucket_seconds=3600, by="series"):
    """Per-second increase of counters over a trailing window, at every sample.

    The increase between two samples of a series is their difference; a counter that went
    down was reset, and counts with its new value. The increases at the samples in
    [ts - window, ts] are summed and divided by the window length; nothing is extrapolated
    at the edges. The first sample of a series has no increase.

    One series may be most of the table, so the work goes by (series, time bucket). Rows at
    the end of a bucket, within the window of the next one, are also sent there; the last
    sample before those, known from a small aggregate per bucket, travels along as a row
    for the first difference. `by` is the column, or columns, that tell series apart.
    """
    by = _names(by)
    span, width = window_seconds * 1_000_000, max(window_seconds, bucket_seconds) * 1_000_000
    bucket = ((F.col("_us") - F.pmod("_us", F.lit(width))) / F.lit(width)).cast("bigint")
    rows = (samples.where(F.col("value").isNotNull())
            .select(*by, "ts", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
            .withColumn("_own", bucket))
    in_tail = F.col("_us") >= (F.col("_own") + 1) * F.lit(width) - F.lit(span)

    # Last sample before the tail of each bucket and last sample at all -> what precedes
    # the rows sent to the next bucket that has rows.
    sample = F.struct("_us", "value")
    last = rows.groupBy(*by, "_own").agg(
        F.max(F.when(~in_tail, sample)).alias("body"), F.max(sample).alias("end"))
    history = Window.partitionBy(*by).orderBy("_own")
    adjacent = F.lag("_own").over(history) == F.col("_own") - 1
    before = F.when(
        adjacent, F.coalesce(F.lag("body").over(history), F.lag("end", 2).over(history))
    ).otherwise(F.lag("end").over(history))
    carried = (last.select(*by, F.col("_own").alias("_bucket"), before.alias("s"))
               .where(F.col("s").isNotNull())
               .select(*by, "_bucket", "s._us", "s.value"))

    spread = rows.withColumn("_bucket", F.explode(
        F.when(in_tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    chunk = Window.partitionBy(*by, "_bucket")
    previous = F.lag("value").over(chunk.orderBy("_us", "value"))
    step = (F.when(previous.isNull(), F.lit(0))
            .when(F.col("value") < previous, F.col("value"))
            .otherwise(F.col("value") - previous))
    recent = chunk.orderBy("_us").rangeBetween(-span, 0)
    return (spread.unionByName(carried, allowMissingColumns=True)
            .withColumn("_step", step)
            .withColumn("increase", F.sum("_step").over(recent))
            .where(F.col("_own") == F.col("_bucket"))
            .select(*by, "ts", "value", "increase",
                    (F.col("increase") / F.lit(float(window_seconds))).alias("rate")))


def sum_by(samples, label, value="value"):
    """Sum over series at each time, per value of a label; samples without it are left out."""
    return (samples.where(has_label(label))
            .groupBy("ts", F.col("labels")[label].alias(label))
            .agg(F.sum(value).alias("value")))


def series_count(samples, label):
    """Number of series per metric that have a label."""
    return (with_series(samples.where(has_label(label)))
            .groupBy("metric").agg(F.countDistinct("series").alias("series")))


def _last_value():
    known = F.when(F.col("value").isNotNull(), F.struct("ts", "value"))
    return F.max(known)["value"]


def last_not_null(samples, by="series"):
    """Newest value of each series that is not NULL; series without one show NULL."""
    return samples.groupBy(*_names(by)).agg(_last_value().alias("value"))


def timeseries(samples, step, by="series"):
    """Gauges at a fixed step: the last value of each series in each step that has one."""
    return (samples.where(F.col("value").isNotNull())
            .groupBy(*_names(by), F.window("ts", step)["start"].alias("step"))
            .agg(_last_value().alias("value")))
