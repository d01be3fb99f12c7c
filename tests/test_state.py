import itertools

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cdclake.operators.state import (
    APPLY, _places, align, as_of, latest_by_key, live, rank_changes, upsert)
from cdclake.contracts import ORDERS

LOG = "k STRING, op STRING, ts_ms BIGINT, v STRING"


def log(spark, *events):
    return spark.createDataFrame(list(events), LOG)


def test_deleted_key_keeps_its_last_row_by_default(spark):
    df = log(spark, ("1", "r", 1, "a"), ("1", "u", 2, "b"), ("1", "d", 3, None))
    assert rows(latest_by_key(df, "k", "ts_ms")) == [("1", "u", 2, "b")]
    assert rows(latest_by_key(df, "k", "ts_ms", APPLY)) == []


def test_key_made_again_after_its_delete(spark):
    df = log(spark, ("1", "r", 1, "a"), ("1", "d", 2, None), ("1", "c", 3, "b"))
    assert rows(latest_by_key(df, "k", "ts_ms", APPLY)) == [("1", "c", 3, "b")]


def test_events_without_op_never_reach_the_state(spark):
    df = log(spark, (None, None, None, None), ("1", "c", 1, "a"))
    for deletes in ("ignore", "apply"):
        assert rows(latest_by_key(df, "k", "ts_ms", deletes)) == [("1", "c", 1, "a")]


def test_ties_and_missing_times(spark):
    df = log(spark, ("1", "u", 5, "a"), ("1", "u", 5, "b"), ("1", "u", None, "z"))
    assert rows(latest_by_key(df, "k", "ts_ms")) == [("1", "u", 5, "b")]


def test_null_is_a_key(spark):
    df = log(spark, (None, "u", 1, "a"), (None, "u", 2, "b"), ("1", "u", 1, "c"))
    assert rows(latest_by_key(df, "k", "ts_ms")) == [("1", "u", 1, "c"), (None, "u", 2, "b")]


def test_same_as_the_window_form(spark):
    """The aggregate keeps what row_number() = 1 keeps under the same total order."""
    events = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("k"),
        F.when(F.xxhash64("id") % 5 == 0, "d").otherwise("u").alias("op"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 50).alias("ts_ms"),
        F.col("id").cast("string").alias("v"))
    events.createOrReplaceTempView("changes")
    wanted = spark.sql("""
        SELECT k, op, ts_ms, v FROM (
          SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts_ms DESC, op DESC, v DESC) rn
          FROM changes WHERE op <> 'd') WHERE rn = 1""")
    assert rows(latest_by_key(events, "k", "ts_ms")) == rows(wanted)


EVENTS = st.lists(st.tuples(
    st.sampled_from(["1", "2", "3", None]), st.sampled_from(["r", "u", "d"]),
    st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(["a", "b", None])),
    min_size=1, max_size=12)
QUICK = settings(max_examples=12, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(events=EVENTS, order=st.randoms(use_true_random=False))
def test_order_partitions_and_copies_change_nothing(spark, events, order):
    mixed = events + events
    order.shuffle(mixed)
    for deletes in ("ignore", "apply"):
        once = latest_by_key(log(spark, *events).coalesce(1), "k", "ts_ms", deletes)
        again = latest_by_key(log(spark, *mixed).repartition(3), "k", "ts_ms", deletes)
        assert rows(once) == rows(again)


@QUICK
@given(events=EVENTS, cut=st.integers(0, 6))
def test_upsert_of_a_log_in_two_parts(spark, events, cut):
    """state(L1) + L2 = state(L1 + L2), when deletes are ignored and order is kept."""
    known = [e for e in events if e[2] is not None]
    first = log(spark, *known).where(F.col("ts_ms") <= cut)
    second = log(spark, *known).where(F.col("ts_ms") > cut)
    state = latest_by_key(first, "k", "ts_ms").drop("op")
    both = latest_by_key(log(spark, *known), "k", "ts_ms").drop("op")
    assert rows(upsert(state, second, "k", "ts_ms", "ignore")) == rows(both)


@QUICK
@given(events=EVENTS, picks=st.lists(st.booleans(), min_size=12, max_size=12))
def test_upsert_with_its_deletes_is_the_whole_log_in_any_pieces(spark, events, picks):
    parts = [[e for e, p in zip(events, picks) if p == side] for side in (True, False)]
    state = latest_by_key(log(spark, *parts[0]) if parts[0] else log(spark, *events).limit(0),
                          "k", "ts_ms", None)
    changes = log(spark, *parts[1]) if parts[1] else log(spark, *events).limit(0)
    wanted = latest_by_key(log(spark, *events), "k", "ts_ms", "apply")
    assert rows(live(upsert(state, changes, "k", "ts_ms"))) == rows(wanted)


def test_upsert_applies_deletes_and_refuses_late_changes(spark):
    state = spark.createDataFrame([("1", 5, "a"), ("2", 5, "b")], "k STRING, ts_ms BIGINT, v STRING")
    changes = log(spark, ("1", "u", 4, "late"), ("2", "d", 6, None), ("3", "c", 6, "c"))
    assert rows(upsert(state, changes, "k", "ts_ms")) == [("1", 5, "a"), ("3", 6, "c")]


def test_upsert_into_a_state_without_times(spark):
    state = spark.createDataFrame([("1", "z"), ("2", "b")], "k STRING, v STRING")
    changes = log(spark, ("1", "u", 4, "a"), ("2", "d", 6, None))
    assert rows(upsert(state, changes, "k", "ts_ms")) == [("1", "a")]


def test_upsert_with_null_and_compound_keys(spark):
    ddl = "a STRING, b INT, ts_ms BIGINT, v STRING"
    state = spark.createDataFrame([(None, 1, 5, "x"), ("k", None, None, "y"), ("k", 2, 5, "z")], ddl)
    changes = spark.createDataFrame(
        [("u", None, 1, 6, "new"), ("u", "k", None, 1, "dated"), ("d", "k", 2, 5, None),
         ("u", None, None, 1, "first")], "op STRING, " + ddl)
    assert rows(upsert(state, changes, ["a", "b"], "ts_ms")) == sorted(
        [(None, 1, 6, "new"), ("k", None, 1, "dated"), (None, None, 1, "first")], key=repr)


def test_a_small_batch_leaves_the_state_where_it_is(spark, tmp_path):
    spark.range(1000).selectExpr("string(id) k", "id ts_ms", "string(id) v").write.parquet(
        f"{tmp_path}/state")
    state = spark.read.parquet(f"{tmp_path}/state")
    changes = log(spark, ("7", "u", 5000, "new"), ("8", "d", 5000, None), ("9", "u", 1, "late"))
    changes.write.parquet(f"{tmp_path}/changes")
    out = upsert(state, spark.read.parquet(f"{tmp_path}/changes"), "k", "ts_ms")
    assert out.count() == 999 and out.where("v = 'new'").count() == 1
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0]


def test_as_of_the_end_is_the_state(spark):
    df = log(spark, ("1", "r", 1, "a"), ("1", "u", 2, "b"), ("2", "c", 3, "c"))
    assert rows(as_of(df, 3)) == rows(df)
    assert rows(latest_by_key(as_of(df, 1), "k", "ts_ms")) == [("1", "r", 1, "a")]


@pytest.mark.parametrize("bucket", [False, True])
def test_rank_changes_counts_across_buckets(spark, bucket):
    """One key holds most rows and spans all buckets; compared with counting in Python."""
    events = [("hot" if i % 3 else f"k{i % 5}", "u", (i * 7919) % 400, str(i)) for i in range(600)]
    events += [("hot", "u", 77, f"burst {i:03}") for i in range(300)]
    events += [(None, "u", 3, "x"), (None, "u", None, "y"), ("hot", "u", None, "z")]
    cut = F.floor(F.col("ts_ms") / 50) if bucket else None
    got = rank_changes(log(spark, *events), "k", "ts_ms", cut)
    order = lambda e: (e[2] is not None, e[2] or 0, e[1], e[3])
    wanted = []
    for _, group in itertools.groupby(sorted(events, key=lambda e: str(e[0])), lambda e: e[0]):
        ranked = sorted(group, key=order, reverse=True)
        wanted += [(*e, n) for n, e in enumerate(ranked, 1)]
    assert rows(got) == sorted(wanted, key=repr)


def test_cells_of_a_hot_key_are_even_and_nothing_is_written(spark, monkeypatch):
    """Most rows are one key at one time, so the columns after the order must cut as well."""
    events = [("hot", "u", 7, f"{i * 37 % 4001:05}") for i in range(4000)]
    events += [(f"k{i % 50}", "u", i, "x") for i in range(2000)]
    df = log(spark, *events)
    sizes = [r["count"] for r in df.groupBy(
        _places(df, ["k"], ["ts_ms"], ["op", "v"])).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 3 * 6000 / 8
    ranked = rank_changes(df, "k", "ts_ms")
    hot = ranked.where("k = 'hot'").orderBy("rn").collect()
    assert [r["rn"] for r in hot] == list(range(1, 4001))
    assert [r["v"] for r in hot] == sorted((e[3] for e in events[:4000]), reverse=True)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "interim-" not in plan and "parquet" not in plan


@pytest.mark.parametrize("kind", ["timestamp", "date", "decimal(9,2)", "double", "binary"])
def test_cuts_of_any_type(spark, kind):
    number = F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 500)
    value = {"timestamp": F.timestamp_seconds(number), "binary": number.cast("string"),
             "date": F.date_add(F.lit("2024-01-01").cast("date"), number.cast("int"))}.get(
                 kind, number).cast(kind)
    df = spark.range(900).select((F.col("id") % 3).alias("k"), value.alias("at"), "id")
    window = Window.partitionBy("k").orderBy(F.col("at").desc_nulls_last(), F.desc("id"))
    assert rows(rank_changes(df, "k", "at")) == rows(
        df.withColumn("rn", F.row_number().over(window)))


def test_align(spark):
    df = spark.createDataFrame([("7", "web", 1)], "order_id STRING, channel STRING, extra INT")
    out = align(df, ORDERS)
    assert out.schema == ORDERS.schema
    assert rows(out) == [(7, None, None, "web", None)]


def test_one_row_per_key_leaves_each_task(spark):
    plan = (latest_by_key(log(spark, ("1", "u", 1, "a")), "k", "ts_ms")
            ._jdf.queryExecution().executedPlan().toString())
    assert plan.index("Exchange") < plan.index("partial_max")
