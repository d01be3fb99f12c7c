from dataclasses import replace

import pytest
from conftest import FOLDER, rows
from pyspark.sql import functions as F

from cdclake.__main__ import main
from cdclake.checks.tables import Tables
from cdclake.contracts import CONTRACTS
from cdclake.operators import lineage as G
from cdclake.operators.quality import QualityError
from cdclake.plans import jobs
from cdclake.sources.files import read_csv_table, tpch_customer
from cdclake.sources.generator import generate_ecommerce


def bronze(spark, lake, log):
    lake.namespace(spark, lake.bronze.split(".")[0])
    log.write.partitionBy("table_name").saveAsTable(lake.bronze)


def test_full_refresh(spark, lake):
    bronze(spark, lake, Tables(spark, FOLDER).bronze())
    report = jobs.run_pipeline(spark, lake)
    kinds = [r["item"] for r in report.collect()]
    assert kinds.count("rows") == 3 and kinds.count("top product") == 3
    events = spark.table(lake.lineage)
    assert events.count() == 8
    up = G.upstream(G.lineage_edges(events), f"lake.{lake.gold}.customer_ltv")
    assert f"lake.{lake.bronze}" in {r["dataset"] for r in up.collect()}
    first = rows(spark.table(f"{lake.gold}.customer_ltv"))
    jobs.run_pipeline(spark, lake)
    assert rows(spark.table(f"{lake.gold}.customer_ltv")) == first


def test_a_failed_gate_stops_the_report(spark, lake):
    """Prices below zero make revenue negative."""
    log = Tables(spark, FOLDER).bronze()
    worse = F.when(F.col("table_name") == "order_items",
                   F.regexp_replace("after", '"unit_price":', '"unit_price":-')
                   ).otherwise(F.col("after"))
    bronze(spark, lake, log.withColumn("after", worse))
    with pytest.raises(QualityError, match="daily_revenue: revenue < 0"):
        jobs.run_pipeline(spark, lake)


def test_lineage_that_cannot_be_written_does_not_stop_the_job(spark, lake):
    bronze(spark, lake, Tables(spark, FOLDER).bronze())
    broken = replace(lake, lineage=f"{lake.silver}.customers")
    assert jobs.run_pipeline(spark, broken).count() == 6


def test_etl(spark, lake):
    customer = tpch_customer(spark, FOLDER)
    count, best = jobs.run_etl(spark, lake, customer)
    assert count == customer.where("c_acctbal > 5000").count()
    assert best[0]["acctbal"] == customer.agg(F.max("c_acctbal")).head()[0] and len(best) == 5
    with pytest.raises(QualityError):
        jobs.run_etl(spark, lake, customer.where("c_acctbal < 0"))


def test_demo(spark, lake):
    for _ in range(2):
        count, amount, content = jobs.demo_events(spark, lake)
        assert (count, amount) == (4, 925.75)
        assert [r["name"] for r in content.collect()] == ["alpha", "bravo", "charlie", "delta"]


def test_command_line(spark, lake, tmp_path, capsys):
    """Generated files, read back by contract."""
    main(["generate", "--path", f"{tmp_path}/csv", "--scale", "0.01"], spark)
    made = generate_ecommerce(spark, 0.01)
    for name, contract in CONTRACTS.items():
        assert rows(read_csv_table(spark, f"{tmp_path}/csv/{name}", contract)) == rows(made[name])
    main(["etl", "--path", FOLDER, "--etl", lake.etl, "--warehouse", lake.warehouse], spark)
    main(["demo", "--demo", lake.demo, "--warehouse", lake.warehouse], spark)
    assert "4 rows, amount 925.75" in capsys.readouterr().out
