import datetime
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.operators import metrics as M

EPOCH = datetime.datetime(2024, 1, 1)
DDL = "series STRING, ts TIMESTAMP, value DOUBLE"


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


def brute_rate(samples, window):
    """{(series, second): increase} by looking at every pair of neighbours."""
    out = {}
    for name in {s for s, _, _ in samples}:
        points = sorted((t, v) for s, t, v in samples if s == name and v is not None)
        steps = [(t, 0 if n == 0 else (v if v < points[n - 1][1] else v - points[n - 1][1]))
                 for n, (t, v) in enumerate(points)]
        for t, _ in steps:
            out[name, t] = sum(d for u, d in steps if t - window <= u <= t)
    return out


@pytest.mark.parametrize("window,bucket,seed", [
    (60, 60, 1), (60, 300, 2), (45, 100, 3), (100, 10, 4), (60, 100_000, 5)])
def test_rate_matches_brute_force(spark, window, bucket, seed):
    """A hot series over many buckets, with resets, gaps, missing values and sparse series."""
    draw = random.Random(seed)
    samples, value = [], 0.0
    for t in range(0, 3000, 15):
        value = 0.0 if draw.random() < 0.05 else value + draw.randint(0, 9)
        if draw.random() < 0.85 and not 900 < t < 1500:
            samples.append(("hot", t, value if draw.random() < 0.95 else None))
    for n in range(6):
        for t in sorted(draw.sample(range(3000), 5)):
            samples.append((f"s{n}", t, float(draw.randint(0, 50))))
    df = spark.createDataFrame([(s, at(t), v) for s, t, v in samples], DDL).repartition(5)
    got = {(r["series"], int((r["ts"] - EPOCH).total_seconds())): (r["increase"], r["rate"])
           for r in M.counter_rate(df, window, bucket).collect()}
    wanted = brute_rate(samples, window)
    assert got.keys() == wanted.keys()
    for key, (increase, rate) in got.items():
        assert increase == pytest.approx(wanted[key])
        assert rate == pytest.approx(wanted[key] / window)


def test_rate_before_the_epoch(spark):
    old = datetime.datetime(1969, 12, 31, 23, 59, 0)
    points = [("s", old + datetime.timedelta(seconds=15 * n), float(n)) for n in range(9)]
    got = M.counter_rate(spark.createDataFrame(points, DDL), 30, 30)
    assert [r["increase"] for r in got.orderBy("ts").collect()] == [0, 1, 2, 3, 3, 3, 3, 3, 3]


def samples(spark):
    return spark.createDataFrame([
        (at(0), "cpu", {"name": "a", "host": "x"}, 1.0),
        (at(0), "cpu", {"host": "y", "name": "a"}, 2.0),
        (at(0), "cpu", {"name": "a", "host": "y"}, 4.0),
        (at(0), "cpu", {"name": "", "host": "x"}, 8.0),
        (at(0), "cpu", {"host": "x"}, 16.0),
        (at(7), "cpu", {"name": "b", "host": "x"}, None),
        (at(5), "cpu", {"name": "b", "host": "x"}, 3.0)], M.SAMPLE_DDL)


def test_sum_by_skips_empty_labels(spark):
    got = rows(M.sum_by(samples(spark), "name").select("name", "value"))
    assert got == [("a", 7.0), ("b", 3.0), ("b", None)]


def test_series_do_not_depend_on_label_order(spark):
    assert rows(M.series_count(samples(spark), "name")) == [("cpu", 3)]


def test_last_not_null(spark):
    last = M.last_not_null(M.with_series(samples(spark)))
    assert {r["value"] for r in last.where(F.col("series").contains('"b"')).collect()} == {3.0}
    gone = M.last_not_null(M.with_series(samples(spark).withColumn(
        "value", F.lit(None).cast("double"))))
    assert {r["value"] for r in gone.collect()} == {None}


def test_timeseries_takes_the_last_of_each_step(spark):
    df = spark.createDataFrame([("s", at(t), float(t)) for t in (0, 14, 15, 44)], DDL)
    got = [(r["step"], r["value"]) for r in M.timeseries(df, "15 seconds").orderBy("step").collect()]
    assert got == [(at(0), 14.0), (at(15), 15.0), (at(30), 44.0)]
