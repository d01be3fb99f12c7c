"""Silver and gold rules on hand-made tables."""

import json
from collections import defaultdict
from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import FOLDER, rows
from pyspark.sql import functions as F

from cdclake import contracts as C
from cdclake.checks.tables import Tables
from cdclake.operators.changes import snapshot_to_changes
from cdclake.functions.money import minor_units
from cdclake.plans import dashboards, gold, silver
from cdclake.plans.jobs import build_gold_layer, build_silver_layer
from cdclake.sources.generator import generate_ecommerce

BRONZE = "table_name STRING, op STRING, ts_ms BIGINT, after STRING, ingest_ts TIMESTAMP"


def order(i, status="placed", customer=1, day="2024-05-01", channel="web"):
    return (i, customer, f"{day} 10:00:00", channel, status)


def orders(spark, *rows_):
    df = spark.createDataFrame(list(rows_), "order_id BIGINT, customer_id BIGINT, ts STRING, "
                               "channel STRING, status STRING")
    return df.withColumn("order_ts", F.col("ts").cast("timestamp_ntz")).drop("ts")


def items(spark, *rows_):
    return spark.createDataFrame(
        [(n, *r) for n, r in enumerate(rows_, 1)],
        "item_id BIGINT, order_id BIGINT, product_id BIGINT, quantity BIGINT, unit_price DOUBLE")


def test_round_trip_through_bronze(spark):
    shop = generate_ecommerce(spark, 0.05)
    for name, contract in C.CONTRACTS.items():
        log = snapshot_to_changes(shop[name], name, F.lit(1).cast("bigint"))
        built = silver.build_silver(log.unionByName(log), contract)
        assert rows(built) == rows(shop[name])
        assert [f.dataType for f in built.schema] == [f.type for f in contract.fields]


def bronze(spark, *events):
    return spark.createDataFrame([("orders", *e, None) for e in events], BRONZE)


def test_newest_event_wins_whatever_the_delete(spark):
    log = bronze(spark, ("r", 1, '{"order_id":1,"status":"placed"}'),
                 ("u", 2, '{"order_id":1,"status":"shipped","unknown":5}'),
                 ("d", 3, None), (None, None, None))
    assert rows(silver.silver_orders(log)) == [(1, None, None, None, "shipped")]
    keyed = log.withColumn("after", F.coalesce("after", F.when(
        F.col("op") == "d", F.lit('{"order_id":1}'))))
    assert rows(silver.silver_orders(keyed)) == [(1, None, None, None, "shipped")]
    assert rows(silver.silver_orders(keyed, "apply")) == []


def test_source_order_settles_equal_times(spark):
    log = bronze(spark, ("u", 1, '{"order_id":1,"status":"a"}'),
                 ("u", 1, '{"order_id":1,"status":"b"}'))
    assert rows(silver.silver_orders(log)) == [(1, None, None, None, "b")]
    seq = log.withColumn("seq", F.when(F.col("after").contains('"a"'), 2).otherwise(1))
    assert rows(silver.silver_orders(seq)) == [(1, None, None, None, "a")]


def test_a_bad_value_fails_or_is_set_aside(spark):
    log = bronze(spark, ("c", 1, '{"order_id":1,"customer_id":"x"}'),
                 ("c", 1, '{"order_id":"two","customer_id":2}'),
                 ("c", 1, '{"order_id":3,"customer_id":3}'))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        silver.silver_orders(log).collect()
    good, bad = silver.split_silver(log, C.ORDERS)
    assert rows(good.select("order_id", "customer_id")) == [(3, 3)]
    assert rows(bad.select("order_id", "customer_id")) == [("1", "x"), ("two", "2")]


def test_images_without_a_key_are_all_set_aside(spark):
    log = bronze(spark, ("c", 1, '{"order_id":1,"customer_id":7,"status":"pla'),
                 ("c", 2, "no json"), ("c", 1, '{"order_id":null}'),
                 ("c", 1, '{"order_id":2,"customer_id":8}'), ("d", 3, None))
    good, bad = silver.split_silver(log, C.ORDERS)
    assert [r["order_id"] for r in good.collect()] == [2]
    assert sorted(r["image"] for r in bad.collect()) == [
        "no json", '{"order_id":1,"customer_id":7,"status":"pla', '{"order_id":null}']


def test_events_have_no_silver_table_by_default():
    assert [c.table for c in C.SILVER] == [
        "customers", "products", "orders", "order_items", "payments"]


def test_state_as_of(spark):
    log = bronze(spark, ("r", 1, '{"order_id":1,"status":"placed"}'),
                 ("u", 5, '{"order_id":1,"status":"shipped"}'))
    assert [r["status"] for r in silver.state_as_of(log, C.ORDERS, 4).collect()] == ["placed"]


def test_daily_revenue_rules(spark):
    o = orders(spark, order(1), order(2, "cancelled"), order(3, "returned"), order(4, None),
               order(5), order(6, channel="store"))
    i = items(spark, (1, 1, 2, 1.5), (1, 2, 1, 0.1), (2, 1, 9, 9.0), (3, 1, 1, 2.0),
              (4, 1, 1, 50.0), (6, 1, 3, 0.335))
    got = [(str(r["order_date"]), r["channel"], r["orders"], r["revenue"])
           for r in gold.gold_daily_revenue(o, i).collect()]
    assert sorted(got) == [("2024-05-01", "store", 1, 1.01), ("2024-05-01", "web", 2, 5.1)]


def test_customers_stay_and_orders_without_items_count(spark):
    c = spark.createDataFrame([(1, "smb", "US"), (2, "smb", "DE"), (3, "smb", "FR")],
                              "customer_id BIGINT, segment STRING, country STRING")
    o = orders(spark, order(1), order(2, "cancelled", 2), order(3), order(4, None, 3))
    i = items(spark, (1, 1, 2, 1.25), (2, 1, 1, 9.0))
    got = rows(gold.gold_customer_ltv(c, o, i).select("customer_id", "orders", "lifetime_value"))
    assert got == [(1, 2, 2.5), (2, 0, 0.0), (3, 0, 0.0)]


def test_top_products_count_cancelled_orders_and_skip_unsold(spark):
    p = spark.createDataFrame([(1, "a", "x", 2.0, 1.0), (2, "b", "x", 5.0, 1.0),
                               (3, "c", "x", 5.0, None)],
                              "product_id BIGINT, name STRING, category STRING, "
                              "unit_price DOUBLE, unit_cost DOUBLE")
    i = items(spark, (2, 1, 3, 2.0), (2, 1, 1, None), (9, 3, 1, 5.0), (9, 7, 1, 5.0))
    got = rows(gold.gold_top_products(i, p).drop("name", "category"))
    assert got == [(1, 4, 6.0, 3.0), (3, 1, 5.0, None)]


def cents(amount):
    return float(amount.quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_marts_against_a_loop_over_the_rows(spark):
    """One order and one product hold a third of all items."""
    shop = generate_ecommerce(spark, 0.1)
    hot = (F.col("item_id") % 3) == 0
    shop["order_items"] = (
        shop["order_items"]
        .withColumn("order_id", F.when(hot, F.lit(2)).otherwise(F.col("order_id")))
        .withColumn("product_id", F.when(hot, F.lit(5)).otherwise(F.col("product_id"))))
    data = {name: [r.asDict() for r in df.collect()] for name, df in shop.items()}
    lines, sold = defaultdict(list), defaultdict(list)
    for line in data["order_items"]:
        line["price"] = Decimal(str(line["unit_price"]))
        lines[line["order_id"]].append(line)
        sold[line["product_id"]].append(line)
    spent = {i: sum(x["quantity"] * x["price"] for x in own) for i, own in lines.items()}

    days, owners = defaultdict(list), defaultdict(list)
    for o in data["orders"]:
        if o["status"] != "cancelled":
            owners[o["customer_id"]].append(o["order_id"])
            if o["order_id"] in lines:
                days[o["order_ts"].date(), o["channel"]].append(o["order_id"])
    daily = [(*group, len(own), cents(sum(spent[i] for i in own))) for group, own in days.items()]
    products = []
    for p in data["products"]:
        own, cost = sold[p["product_id"]], Decimal(str(p["unit_cost"]))
        if own:
            products.append((p["product_id"], p["name"], p["category"],
                             sum(x["quantity"] for x in own),
                             cents(sum(x["quantity"] * x["price"] for x in own)),
                             cents(sum(x["quantity"] * (x["price"] - cost) for x in own))))
    ltv = [(c["customer_id"], c["segment"], c["country"], len(owners[c["customer_id"]]),
            cents(sum((spent.get(i, Decimal(0)) for i in owners[c["customer_id"]]), Decimal(0))))
           for c in data["customers"]]

    o, i = shop["orders"], shop["order_items"]
    assert rows(gold.gold_daily_revenue(o, i)) == sorted(daily, key=repr)
    assert rows(gold.gold_top_products(i, shop["products"])) == sorted(products, key=repr)
    assert rows(gold.gold_customer_ltv(shop["customers"], o, i)) == sorted(ltv, key=repr)


def test_cards_sum_rounded_groups(spark):
    daily = spark.createDataFrame(
        [("2024-01-01", "web", 2, 10.25), ("2024-01-01", "store", 1, 0.25),
         ("2024-01-02", "web", 1, 3.0)],
        "order_date STRING, channel STRING, orders BIGINT, revenue DOUBLE")
    assert dashboards.kpi_total_revenue(daily).head()[0] == 14.0
    assert dashboards.kpi_total_orders(daily).head()[0] == 4
    assert dashboards.kpi_avg_order_value(daily).head()[0] == 3.38
    assert [tuple(r) for r in dashboards.daily_trend(daily).collect()] == [
        ("2024-01-01", 11.0), ("2024-01-02", 3.0)]
    assert [r["channel"] for r in dashboards.revenue_by_channel(daily).collect()] == [
        "web", "store"]


def test_status_filter_and_columns_reach_the_scan(spark, tmp_path):
    shop = generate_ecommerce(spark, 0.02)
    for name, df in shop.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in shop}
    plan = gold.gold_customer_ltv(read["customers"], read["orders"], read["order_items"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(status,cancelled))" in text
    assert "ReadSchema: struct<order_id:bigint,quantity:bigint,unit_price:double>" in text


def test_silver_reads_its_own_part_of_bronze(spark, tmp_path):
    Tables(spark, FOLDER).bronze().write.partitionBy("table_name").parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    text = silver.silver_orders(log)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_name" in text and "= orders)" in text


def test_counts_of_orders_need_no_further_shuffle(spark):
    """Joined on the order, the distinct count of orders happens within each partition."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o, i = orders(spark, order(1)), items(spark, (1, 1, 1, 1.0))
        text = (gold.gold_daily_revenue(o, i)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 3  # orders, totals per order, groups of the mart


def test_prices_keep_all_their_digits_or_fail(spark):
    items = spark.createDataFrame([(1, 1, 1_000_000, 0.00004)],
                                  "order_id LONG, product_id LONG, quantity LONG, unit_price DOUBLE")
    orders = spark.createDataFrame([(1, 1, None, "web", "placed")], C.ORDERS.schema)
    with pytest.raises(Exception, match="decimal places"):
        gold.gold_daily_revenue(orders, items).collect()
    for digits in (5, 8):
        assert gold.gold_daily_revenue(orders, items, digits).head()["revenue"] == 40.0


@pytest.mark.parametrize("price, digits", [
    (1_000_000.00005, 4), (60_000_000.00005, 4), (60_000_000.005, 2), (12_345_678.912345, 5),
    (1e9 + 0.00005, 4), (1e-9, 4)])
def test_digits_beyond_the_marts_fail_however_large_the_price(spark, price, digits):
    df = spark.createDataFrame([(price,)], "p DOUBLE")
    with pytest.raises(Exception, match="decimal places"):
        df.select(minor_units(F.col("p"), digits)).collect()


@pytest.mark.parametrize("price, digits, units", [
    (60_000_000.0001, 4, 600_000_000_001), (1e12, 4, 10 ** 16), (0.1 + 0.2, 4, 3000),
    (123_456_789.0123, 4, 1_234_567_890_123), (99_999_999.99, 2, 9_999_999_999),
    (12_345.67891, 5, 1_234_567_891), (-60_000_000.0001, 4, -600_000_000_001), (0.0, 4, 0)])
def test_prices_that_fit_become_whole_units(spark, price, digits, units):
    df = spark.createDataFrame([(price,)], "p DOUBLE")
    assert df.select(minor_units(F.col("p"), digits)).head()[0] == units


def test_a_shop_with_five_digit_prices_is_refreshed(spark, lake):
    """The marts keep the digits of the configuration."""
    images = {
        "customers": {"customer_id": 1, "segment": "a"},
        "products": {"product_id": 1, "name": "p", "category": "c", "unit_price": 0.00125,
                     "unit_cost": 0.00025},
        "orders": {"order_id": 1, "customer_id": 1, "order_ts": "2024-01-01 10:00:00",
                   "channel": "web", "status": "placed"},
        "order_items": {"item_id": 1, "order_id": 1, "product_id": 1, "quantity": 100_000,
                        "unit_price": 0.00125}}
    log = spark.createDataFrame(
        [(t, "c", 1, json.dumps(i)) for t, i in images.items()],
        "table_name STRING, op STRING, ts_ms BIGINT, after STRING").withColumn(
            "ingest_ts", F.current_timestamp())
    lake.namespace(spark, lake.bronze.split(".")[0])
    log.write.saveAsTable(lake.bronze)
    build_silver_layer(spark, lake)
    with pytest.raises(Exception, match="decimal places"):
        build_gold_layer(spark, lake)
    build_gold_layer(spark, replace(lake, digits=5))
    assert spark.table(f"{lake.gold}.top_products").select("revenue", "margin").head() == (
        125.0, 100.0)
    assert spark.table(f"{lake.gold}.customer_ltv").head()["lifetime_value"] == 125.0
