import json
from dataclasses import replace

import pytest
from conftest import rows

from cdclake.contracts import BRONZE_DDL, ORDERS
from cdclake.plans.jobs import build_silver_layer
from cdclake.plans.silver import ASIDE, checked_silver, split_silver


def event(image, ts, op="u"):
    after = json.dumps(image) if isinstance(image, dict) else image
    return "orders", op, ts, after, None


EVENTS = [
    event({"order_id": "1", "order_ts": "2024-01-01 00:00:00", "status": "a"}, 1),
    event({"order_id": "1", "order_ts": "soon", "status": "b"}, 2),
    event({"order_id": "2", "order_ts": "never", "status": "a"}, 1),
    event({"order_id": "2", "order_ts": "2024-01-02 00:00:00", "status": "b"}, 2),
    event({"order_id": "x", "status": "a"}, 1), event({"status": "lost"}, 1),
    event({"status": "lost"}, 5), event("no json", 3), event("", 3),
    event({"order_id": "3", "status": None}, 1), event({"order_id": "4"}, 1),
    event({"order_id": "4"}, 2, "d"), event({"order_id": "3", "status": "old"}, 0)]


@pytest.mark.parametrize("deletes", ["ignore", "apply"])
def test_one_read_gives_what_two_give(spark, deletes):
    log = spark.createDataFrame(EVENTS, BRONZE_DDL)
    both = checked_silver(log, ORDERS, deletes)
    good, bad = split_silver(log, ORDERS, deletes)
    assert rows(both.where(f"{ASIDE} IS NULL").drop(ASIDE)) == rows(good)
    assert rows(both.where(f"{ASIDE} IS NOT NULL").select(f"{ASIDE}.*")) == rows(bad.distinct())
    assert both._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_a_bad_cell_no_longer_stops_the_layer(spark, lake):
    lake = replace(lake, aside=lake.silver.replace("silver", "aside"))
    spark.sql(f"CREATE DATABASE {lake.bronze.split('.')[0]}")
    spark.createDataFrame(EVENTS, BRONZE_DDL).write.saveAsTable(lake.bronze)
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        build_silver_layer(spark, replace(lake, aside=""))
    counts = build_silver_layer(spark, lake)
    assert counts["orders"] == (3, 5) and counts["products"] == (0, 0)
    assert rows(spark.table(f"{lake.silver}.orders").select("order_id", "status")) == [
        (2, "b"), (3, None), (4, None)]
    assert rows(spark.table(f"{lake.aside}.orders").select("order_id", "order_ts", "image")) == \
        sorted([("1", "soon", None), ("x", None, None), (None, None, '{"status": "lost"}'),
                (None, None, "no json"), (None, None, "")], key=repr)
