import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.operators.integrity import orphan_keys
from cdclake.sources import generator as S


@pytest.fixture(scope="module")
def shop(spark):
    return {name: df.cache() for name, df in S.generate_ecommerce(spark, 1.0).items()}


def test_sizes(shop):
    counts = {name: df.count() for name, df in shop.items()}
    assert [counts[n] for n in ("customers", "products", "orders", "events")] == [
        2000, 500, 8000, 10_000]
    assert 19_400 < counts["order_items"] < 20_600
    assert 6_900 < counts["payments"] < 7_200


@pytest.mark.parametrize("table,key", [
    ("customers", "customer_id"), ("products", "product_id"), ("orders", "order_id"),
    ("order_items", "item_id"), ("events", "event_id")])
def test_ids_run_from_one(shop, table, key):
    low, high, distinct, n = shop[table].agg(
        F.min(key), F.max(key), F.countDistinct(key), F.count("*")).head()
    assert (low, high, distinct) == (1, n, n)


@pytest.mark.parametrize("child,parent,key", [
    ("orders", "customers", "customer_id"), ("order_items", "orders", "order_id"),
    ("order_items", "products", "product_id"), ("payments", "orders", "order_id"),
    ("events", "customers", "customer_id")])
def test_children_have_parents(shop, child, parent, key):
    assert orphan_keys(shop[child], shop[parent], key).isEmpty()


def shares(df, column):
    total = df.count()
    return {r[0]: r[1] / total for r in df.groupBy(column).count().collect()}


def test_domains_and_weights(shop):
    assert set(shares(shop["customers"], "country")) == set(S.COUNTRIES)
    assert set(shares(shop["products"], "category")) == set(S.CATEGORIES)
    assert set(shares(shop["orders"], "channel")) == set(S.CHANNELS)
    status = shares(shop["orders"], "status")
    for name, weight in zip(S.ORDER_STATUS, S.ORDER_STATUS_WEIGHTS):
        assert abs(status[name] - weight / 100) < 0.02
    low, high, fewest, most = shop["order_items"].join(
        shop["order_items"].groupBy("order_id").count(), "order_id").agg(
        F.min("quantity"), F.max("quantity"), F.min("count"), F.max("count")).head()
    assert (low, high, fewest, most) == (1, 5, 1, 4)
    lowest, highest = shop["orders"].agg(F.min("order_ts"), F.max("order_ts")).head()
    assert str(lowest) >= "2024-03-02" and str(highest) <= "2024-06-01 00:00:00"


def test_prices(shop):
    ratio = F.col("unit_price") / F.col("unit_cost")
    low, high, cheap, dear = shop["products"].agg(
        F.min(ratio), F.max(ratio), F.min("unit_cost"), F.max("unit_cost")).head()
    assert low > 1.14 and high < 2.51 and cheap >= 2 and dear <= 400
    wrong = shop["order_items"].alias("i").join(shop["products"].alias("p"), "product_id").where(
        F.col("i.unit_price") != F.col("p.unit_price"))
    assert wrong.isEmpty()


def test_payments_are_the_total_of_their_order(shop):
    totals = shop["order_items"].groupBy("order_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price").cast("decimal(12,2)")).alias("total"))
    paid = shop["payments"].join(totals, "order_id").join(
        shop["orders"].withColumnRenamed("status", "order_status"), "order_id")
    assert paid.count() == shop["payments"].count()
    assert paid.where(F.col("amount").cast("decimal(20,2)") != F.col("total")).isEmpty()
    assert paid.where("order_status = 'cancelled'").isEmpty()
    assert paid.where("order_status = 'returned' AND status <> 'refunded'").isEmpty()
    late = F.timestamp_diff("MINUTE", "order_ts", "paid_ts")
    assert tuple(paid.agg(F.min(late), F.max(late)).head()) == (0, 120)


def test_payload_keys_depend_on_the_event(shop):
    for r in shop["events"].limit(500).collect():
        keys = {"session", "device"}
        keys |= {"query"} if r["event_type"] == "search" else set()
        keys |= {"product_id"} if r["event_type"] in ("add_to_cart", "purchase") else set()
        assert set(json.loads(r["payload"])) == keys


def test_same_at_any_parallelism_and_item_chunk(spark, monkeypatch):
    wide = S.generate_ecommerce(spark, 0.05)
    monkeypatch.setattr(S, "ID_CHUNK", 37)
    narrow = S.generate_ecommerce(spark, 0.05)
    for name in wide:
        assert rows(wide[name].repartition(8)) == rows(narrow[name].coalesce(1))
    other = S.generate_ecommerce(spark, 0.05, seed=7)
    assert rows(other["orders"]) != rows(wide["orders"])


def test_scale_ten(spark):
    shop = S.generate_ecommerce(spark, 10)
    low, high, n = shop["order_items"].agg(
        F.min("item_id"), F.max("item_id"), F.countDistinct("item_id")).head()
    assert low == 1 and high == n and abs(n / 80_000 - 2.5) < 0.02


def test_new_orders(spark):
    base = spark.createDataFrame([(41,), (7,)], "order_id BIGINT")
    delta = S.generate_orders_delta(spark, base, 4000, at="2024-06-02 01:02:03").cache()
    assert tuple(delta.agg(F.min("order_id"), F.max("order_id"), F.count("*")).head()) == (
        42, 4041, 4000)
    assert set(shares(delta, "status")) == {"placed"}
    channels = shares(delta, "channel")
    assert abs(channels["mobile"] - 0.5) < 0.03 and set(channels) == {"web", "mobile", "store"}
    assert delta.where("customer_id NOT BETWEEN 1 AND 2000").isEmpty()
    empty = S.generate_orders_delta(spark, base.where("false"), 3)
    assert sorted(r["order_id"] for r in empty.collect()) == [1, 2, 3]
