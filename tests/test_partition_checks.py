import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.operators import quality as Q
from cdclake.plans.partition_checks import PartitionChecks

@pytest.fixture(scope="module")
def checks(spark):
    return [
        Q.row_count_between(5, 500), Q.not_null("v"), Q.values_between("v", 1, 90),
        Q.no_rows_where(F.col("s") == "bad", "no bad rows"),
        Q.metric_threshold(Q.least("v"), ">", 3, "least"),
        Q.metric_threshold(Q.greatest("v"), "<", 95, "greatest"),
        Q.metric_threshold(Q.summed("v"), ">", 10, "sum"),
        Q.metric_threshold(Q.average("v"), ">", 40, "average"),
        Q.metric_threshold(Q.counted(F.count("v")), ">", 1, "count"),
        Q.metric_threshold(Q.distinct("v"), ">", 20, "distinct")]


@pytest.fixture
def table(spark):
    return spark.range(300).select(
        F.when(F.col("id") % 60 > 0, F.col("id") % 6).alias("day"),
        F.when(F.col("id") % 13 > 0, F.col("id") * 31 % 97).alias("v"),
        F.when(F.col("id") % 50 == 7, "bad").otherwise("good").alias("s"))


def test_states_of_partitions_merge_to_the_full_pass(table, tmp_path, checks):
    suite = PartitionChecks(table, str(tmp_path), checks, "day")
    assert rows(suite.results()) == rows(Q.run_suite(table.limit(0), checks))
    suite.take(table.where("day < 3"), {"run": 1})
    assert rows(suite.results()) == rows(Q.run_suite(table.where("day < 3"), checks))
    assert not suite.take(table, {"run": 1})
    suite.take(table.where("day >= 2 OR day IS NULL"), {"run": 2})
    assert rows(suite.results()) == rows(Q.run_suite(table, checks))
    assert rows(suite.results("day = 4")) == rows(Q.run_suite(table.where("day = 4"), checks))
    suite.drop(table.where("day = 1").select("day"))
    assert rows(suite.results()) == rows(
        Q.run_suite(table.where("day <> 1 OR day IS NULL"), checks))


def test_a_partition_taken_again_has_its_new_rows_only(table, tmp_path, checks):
    suite = PartitionChecks(table, str(tmp_path), checks, ["day", "s"])
    suite.take(table)
    mended = table.withColumn("s", F.lit("good"))
    suite.drop(table.where("s = 'bad'").select("day", "s"))
    suite.take(mended)
    assert rows(suite.results()) == rows(Q.run_suite(mended, checks))
    Q.gate(suite.results().where("check = 'no bad rows'"))


def test_one_check_by_partition(table, tmp_path, checks):
    suite = PartitionChecks(table, str(tmp_path), checks, "day")
    suite.take(table)
    wanted = [(r["day"], float(r["n"]), r["n"] == 0) for r in table.groupBy("day").agg(
        F.count_if(F.col("s") == "bad").alias("n")).collect()]
    assert rows(suite.by_partition("no bad rows")) == sorted(wanted, key=repr)


def test_the_table_is_not_read_for_results(spark, table, tmp_path, checks):
    table.write.parquet(f"{tmp_path}/table")
    stored = spark.read.parquet(f"{tmp_path}/table")
    suite = PartitionChecks(stored, f"{tmp_path}/states", checks, "day")
    suite.take(stored)
    assert not any(f.endswith("/table") or "/table/" in f for f in
                   suite.results().inputFiles())
    assert PartitionChecks(stored, f"{tmp_path}/states", checks[:3], "day").table.root != \
        suite.table.root


def test_a_metric_without_a_state_is_refused(table, tmp_path):
    check = Q.metric_threshold(F.median("v"), ">", 3, "median")
    with pytest.raises(ValueError, match="median"):
        PartitionChecks(table, str(tmp_path), [check], "day")
