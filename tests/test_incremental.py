"""Marts kept up to date by change against the full refresh, after every batch."""

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.checks import incremental as checks
from cdclake.checks.tables import SCHEMAS, Tables
from cdclake.operators.state import APPLY, IGNORE
from cdclake.plans import gold, silver
from cdclake.plans.incremental import LiveMarts
from cdclake.session import settings

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DDL = "table_name STRING, op STRING, ts_ms BIGINT, after STRING, seq BIGINT"


@pytest.fixture(autouse=True)
def narrow(spark):
    """Few partitions, as the tables here have a few rows and many steps."""
    with settings(spark, {"spark.sql.shuffle.partitions": "2"}):
        yield


def drawn(count, seed):
    """Changes of a small shop with every kind of gap: NULLs, keys without partners, moves of
    lines and orders from one owner to another, deletes and rows that come back."""
    draw = random.Random(seed)

    def one_of(*values):
        return draw.choice(values)

    def image(table):
        if table == "customers":
            return {"customer_id": draw.randrange(5), "segment": one_of("a", "b", None),
                    "country": one_of("x", None)}
        if table == "products":
            return {"product_id": draw.randrange(5), "name": one_of("p", "q"), "category": "c",
                    "unit_price": 1.0, "unit_cost": one_of(0.5, 0.25, None)}
        if table == "orders":
            return {"order_id": draw.randrange(8), "customer_id": one_of(*range(6), None),
                    "order_ts": one_of("2024-01-01 10:00:00", "2024-01-02 00:00:00", None),
                    "channel": one_of("web", "shop", None),
                    "status": one_of("placed", "cancelled", "returned", None)}
        return {"item_id": draw.randrange(15), "order_id": one_of(*range(9), None),
                "product_id": one_of(*range(6), None), "quantity": one_of(1, 2, 3, None),
                "unit_price": one_of(1.25, 2.5, 0.0001, None)}

    data = []
    for at in range(count):
        table = one_of("customers", "products", "orders", "orders", "order_items", "order_items")
        data.append((table, one_of("c", "u", "u", "d"), draw.randrange(50),
                     json.dumps(image(table)), at))
    return data


def full(log, deletes):
    orders, items = silver.silver_orders(log, deletes), silver.silver_order_items(log, deletes)
    return {
        "daily_revenue": gold.gold_daily_revenue(orders, items),
        "top_products": gold.gold_top_products(items, silver.silver_products(log, deletes)),
        "customer_ltv": gold.gold_customer_ltv(silver.silver_customers(log, deletes), orders,
                                               items)}


def log_of(spark, data):
    return spark.createDataFrame(data, DDL).withColumn("ingest_ts", F.timestamp_seconds(F.lit(5)))


def same(live, log, deletes):
    for name, wanted in full(log, deletes).items():
        got = live.mart(name)
        assert rows(got.select(wanted.columns)) == rows(wanted), name


@pytest.mark.parametrize("deletes, seed", [(APPLY, 1), (IGNORE, 2)])
def test_as_the_full_refresh_after_every_batch(spark, tmp_path, deletes, seed):
    data, at = drawn(180, seed), 0
    live = LiveMarts(spark, str(tmp_path), deletes, buckets=2)
    for batch, end in enumerate((90, 130, 180) if deletes == APPLY else (90, 180)):
        live.apply(log_of(spark, data[at:end]), batch)
        same(live, log_of(spark, data[:end]), deletes)
        at = end
    assert rows(live.silver("orders")) == rows(silver.silver_orders(log_of(spark, data), deletes))


def test_a_batch_that_stops_anywhere_is_taken_up_again(spark, tmp_path, monkeypatch):
    data = drawn(120, 3)
    live = LiveMarts(spark, str(tmp_path), APPLY, buckets=2)
    live.apply(log_of(spark, data[:70]), 0)

    def fails(table, feeds, reached):
        raise RuntimeError("lost")

    for step in ("_order_facts", "_customer_ltv"):
        with monkeypatch.context() as m:
            m.setattr(live, step, fails)
            with pytest.raises(RuntimeError, match="lost"):
                live.apply(log_of(spark, data[70:]), 1)
    live.apply(log_of(spark, data[70:]), 1)
    same(live, log_of(spark, data), APPLY)
    versions = {n: t.commit().version for n, t in live.tables.items()}
    live.apply(log_of(spark, data[70:]), 1)
    assert versions == {n: t.commit().version for n, t in live.tables.items()}
    live.vacuum()
    same(live, log_of(spark, data), APPLY)


def test_one_change_rewrites_few_buckets(spark, tmp_path):
    orders = [("orders", "c", 1, json.dumps({
        "order_id": i, "customer_id": i % 40, "order_ts": "2024-01-01 10:00:00",
        "channel": f"ch{i % 7}", "status": "placed"}), i) for i in range(80)]
    items = [("order_items", "c", 1, json.dumps({
        "item_id": i, "order_id": i, "product_id": i % 30, "quantity": 1, "unit_price": 2.0}), i)
        for i in range(80)]
    live = LiveMarts(spark, str(tmp_path), APPLY, buckets=16, marts=("daily_revenue",))
    live.apply(log_of(spark, orders + items), 0)
    before = {n: t.commit().buckets for n, t in live.tables.items()}
    change = json.dumps({"item_id": 3, "order_id": 3, "product_id": 3, "quantity": 5,
                         "unit_price": 2.0})
    live.apply(log_of(spark, [("order_items", "u", 2, change, 99)]), 1)
    for name, table in live.tables.items():
        now = table.commit().buckets
        assert sum(now[b] != v for b, v in before[name].items()) == (name != "orders"), name
    assert rows(live.mart("daily_revenue").where("channel = 'ch3'").select("orders", "revenue")) \
        == [(11, 30.0)]


def test_versions_nobody_reads_go_batch_by_batch(spark, monkeypatch):
    left, taken, shop = [], LiveMarts.apply, Tables(spark, "not read")

    def apply(self, *batch):
        left.append(self)
        taken(self, *batch)

    shop.opened = {
        "customer": spark.createDataFrame([(1, "n", 0, 1.0, "s")], SCHEMAS["customer"]),
        "nation": spark.createDataFrame([(0, "x", 0)], SCHEMAS["nation"]),
        "part": spark.createDataFrame([(1, "p", "b", "t", 1, 2.5)], SCHEMAS["part"]),
        "orders": spark.range(30).selectExpr(
            "id AS o_orderkey", "1L AS o_custkey", "'F' AS o_orderstatus",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS o_orderdate", "'web' AS o_orderpriority"),
        "lineitem": spark.range(60).selectExpr(
            "id DIV 2 AS l_orderkey", "1L AS l_partkey", "1L AS l_suppkey",
            "CAST(id % 2 AS INT) AS l_linenumber", "2D AS l_quantity", "'N' AS l_returnflag",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS l_shipdate")}
    monkeypatch.setattr(LiveMarts, "apply", apply)
    # Of 30 orders 5 are deleted, and 5 more become cancelled.
    assert [r["orders"] for r in checks.ltv_by_change(shop).collect()] == [20]
    for name, table in left[-1].tables.items():
        used = set(table.commit().buckets.values())
        assert {int(n.split("=")[1]) for n in table.folder.names("rows")} == used, name
        assert table.folder.names("feed") == [], name
    assert len(left) == 4


def test_shuffle_files_go_with_their_query(spark, tmp_path, monkeypatch):
    seen, follow = [], LiveMarts._follow

    def followed(self, name):
        seen.append(spark.conf.get(CLEANUP))
        return follow(self, name)

    monkeypatch.setattr(LiveMarts, "_follow", followed)
    live = LiveMarts(spark, str(tmp_path), APPLY, buckets=2, marts=("daily_revenue",))
    live.apply(log_of(spark, drawn(20, 5)), 0)
    assert set(seen) == {"true"} and spark.conf.get(CLEANUP) == "false"
