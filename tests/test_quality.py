import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.operators import quality as Q
from cdclake.operators.integrity import orphan_keys, orphans
from cdclake.plans.jobs import top_customer_checks
from cdclake.session import settings


@pytest.fixture
def customers(spark):
    return spark.createDataFrame([(1, "a", 5000.0), (2, "b", 6000.0), (None, "c", None)],
                                 "custkey BIGINT, name STRING, acctbal DOUBLE")


def outcome(df):
    return {r["check"]: (r["observed"], r["passed"]) for r in df.collect()}


def test_strictness_is_a_choice(customers):
    got = outcome(Q.run_suite(customers, top_customer_checks()))
    assert got["acctbal in range"] == (0.0, True)        # 5000 counts, NULL is skipped
    assert got["min(acctbal) > 5000"] == (5000.0, False)
    assert got["custkey is not null"] == (1.0, False)
    strict = outcome(Q.run_suite(customers, [
        Q.values_between("acctbal", 5000, 6000, strict=True, name="s")]))
    assert strict["s"] == (2.0, False)


def test_empty_table(customers):
    got = outcome(Q.run_suite(customers.where("false"), top_customer_checks()))
    assert got["row count"] == (0.0, False)
    assert got["min(acctbal) > 5000"] == (None, False)
    assert got["acctbal in range"] == (0.0, True)


def test_row_count_bounds(customers):
    checks = [Q.row_count_between(1, 3, "a"), Q.row_count_between(maximum=2, name="b"),
              Q.row_count_between(name="c")]
    assert {k: v[1] for k, v in outcome(Q.run_suite(customers, checks)).items()} == {
        "a": True, "b": False, "c": True}


def test_gate_names_every_failure(customers):
    with pytest.raises(Q.QualityError) as error:
        Q.gate(Q.run_suite(customers, top_customer_checks()))
    assert "custkey is not null" in str(error.value) and "min(acctbal)" in str(error.value)
    assert len(Q.gate(Q.run_suite(customers, [Q.row_count_between(1)]))) == 1


def test_suite_is_one_scan(spark, tmp_path, customers):
    customers.write.parquet(f"{tmp_path}/c")
    df = Q.run_suite(spark.read.parquet(f"{tmp_path}/c"), top_customer_checks())
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_same_count_looks_at_numbers_only(spark):
    a, b = spark.range(3), spark.range(10, 13)
    assert outcome(Q.same_count(a, b, "n")) == {"n": (0.0, True)}
    assert outcome(Q.references(a, b, "id", "r")) == {"r": (3.0, False)}
    assert outcome(Q.same_count(a, spark.range(5), "n")) == {"n": (-2.0, False)}


def test_orphans_with_a_hot_key(spark):
    child = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") == 1, None)
        .otherwise(F.col("id") % 10).alias("k"), "id")
    parent = spark.range(9).select(F.col("id").alias("p"))
    lost = [(r["k"], r["id"]) for r in child.collect() if r["k"] in (-1, 9)]
    assert rows(orphans(child, parent, "k", "p")) == sorted(lost, key=repr)
    counted = dict(rows(orphan_keys(child, parent, "k", "p")))
    assert sum(counted.values()) == len(lost) and counted[-1] == 300


def test_verify_non_empty(customers):
    count, best = Q.verify_non_empty(customers, "acctbal", 2)
    assert count == 3 and [r["custkey"] for r in best] == [2, 1]
    with pytest.raises(Q.QualityError):
        Q.verify_non_empty(customers.where("false"), "acctbal")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_is_split(spark, how):
    """With thresholds fit for test data, the planner splits the hot key of a join, also
    where an aggregation follows. The values must reach the join: the keys alone compress."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4096",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings(spark, conf):
        hot = spark.range(60_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"),
            F.xxhash64("id").alias("v"))
        keys = spark.range(0, 60_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("w"))
        joined = hot.join(keys, "k", how).groupBy("k").agg(
            F.countDistinct("v").alias("n"), F.max("w").alias("w"))
        counts = {r["k"]: r["n"] for r in joined.collect()}
        assert counts[7] == 20_001 and counts[4] == 1 and len(counts) == 40_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
