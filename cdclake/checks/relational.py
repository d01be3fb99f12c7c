"""Projections, filters, joins, aggregates, ranks, sorts, state and quality."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdclake.checks.registry import query
from cdclake.contracts import ORDERS, Contract, Field
from cdclake.functions.images import epoch_millis
from cdclake.functions.money import from_minor_units, minor_units
from cdclake.operators import quality as Q
from cdclake.operators.changes import diff_by_digests, diff_to_changes, snapshot_to_changes
from cdclake.operators.integrity import orphan_keys, orphans
from cdclake.operators.state import (
    APPLY, align, as_of, latest_by_key, live, rank_changes, upsert)
from cdclake.plans import gold
from cdclake.plans.jobs import gold_checks, top_customer_checks
from cdclake.plans.silver import state_as_of
from cdclake.session import materialised

CUT = "1998-07-01"


def cut_ms():
    return epoch_millis(F.lit(CUT).cast("timestamp_ntz"))


# --- projections and filters

@query("p1_projection", """
    SELECT order_id, order_ts AS placed_at, channel AS sales_channel FROM s_orders""")
def projection(t):
    return t.orders().select("order_id", F.col("order_ts").alias("placed_at"),
                             F.col("channel").alias("sales_channel"))


@query("p3_log_part", """
    SELECT 'orders' AS table_name, 'r' AS op, epoch_us(order_ts) // 1000 AS ts_ms, order_id
    FROM s_orders""")
def log_part(t):
    return t.bronze().where(F.col("table_name") == "orders").select(
        "table_name", "op", "ts_ms",
        F.get_json_object("after", "$.order_id").cast("bigint").alias("order_id"))


@query("p4_not_equal", "SELECT order_id, status FROM s_orders WHERE status <> 'cancelled'")
def not_equal(t):
    return gold.billed(t.orders()).select("order_id", "status")


@query("p5_range_filter", """
    SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000""")
def range_filter(t):
    return t.read("customer").where(F.col("c_acctbal") > 5000).select("c_custkey", "c_acctbal")


@query("p6_is_null", """
    SELECT customer_id, email FROM s_customers
    LEFT JOIN (SELECT customer_id, status FROM s_orders WHERE channel = '1-URGENT')
      USING (customer_id)
    WHERE status IS NULL""")
def is_null(t):
    """Customers without an urgent order: the outer join leaves their status NULL."""
    urgent = t.orders().where(F.col("channel") == "1-URGENT").select("customer_id", "status")
    return (t.customers().join(urgent, "customer_id", "left")
            .where(F.col("status").isNull()).select("customer_id", "email"))


@query("p7_conjunction", """
    SELECT order_id FROM s_orders WHERE channel = '1-URGENT' AND status <> 'cancelled'""")
def conjunction(t):
    return t.orders().where((F.col("channel") == "1-URGENT")
                            & (F.col("status") != "cancelled")).select("order_id")


@query("p8_derived_table", """
    SELECT customer_id, n FROM (
      SELECT customer_id, count(*) AS n FROM s_orders GROUP BY customer_id) WHERE n > 10""")
def derived_table(t):
    return t.orders().groupBy("customer_id").agg(F.count("*").alias("n")).where(F.col("n") > 10)


@query("p9_not_empty", "SELECT event_id, event_type FROM events WHERE event_type <> ''")
def not_empty(t):
    return t.read("events").where(F.col("event_type") != "").select("event_id", "event_type")


# --- joins

@query("j1_orders_items", """
    SELECT o.order_id, order_ts, item_id, quantity
    FROM s_orders o JOIN s_items i ON o.order_id = i.order_id""")
def orders_items(t):
    return t.orders().join(t.items(), "order_id").select(
        "order_id", "order_ts", "item_id", "quantity")


@query("j2_items_products", """
    SELECT item_id, i.product_id, name, category
    FROM s_items i JOIN s_products p ON i.product_id = p.product_id""")
def items_products(t):
    return t.items().drop("unit_price").join(t.products(), "product_id").select(
        "item_id", "product_id", "name", "category")


@query("j3_customers_billed_orders", """
    SELECT c.customer_id, order_id FROM s_customers c
    LEFT JOIN s_orders o ON c.customer_id = o.customer_id AND status <> 'cancelled'""")
def customers_billed_orders(t):
    billed = gold.billed(t.orders()).select("customer_id", "order_id")
    return t.customers().select("customer_id").join(billed, "customer_id", "left")


@query("j4_customers_orders_items", """
    SELECT c.customer_id, o.order_id, item_id FROM s_customers c
    LEFT JOIN s_orders o ON c.customer_id = o.customer_id AND status <> 'cancelled'
    LEFT JOIN s_items i ON o.order_id = i.order_id""")
def customers_orders_items(t):
    items = t.items().select("order_id", "item_id")
    return customers_billed_orders(t).join(items, "order_id", "left").select(
        "customer_id", "order_id", "item_id")


@query("j5_count_difference", """
    SELECT (SELECT count(*) FROM s_orders) - (SELECT count(*) FROM s_payments) AS difference""")
def counts_apart(t):
    return Q.count_difference(t.orders(), t.payments())


@query("j7_orphans", """
    SELECT order_id, channel, status FROM s_orders
    WHERE order_id NOT IN (SELECT order_id FROM s_items)""")
def orders_without_items(t):
    return orphans(t.orders(), t.items(), "order_id").select("order_id", "channel", "status")


@query("j7_orphan_keys", """
    SELECT customer_id, count(*) AS rows FROM s_orders WHERE customer_id NOT IN (
      SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY customer_id""")
def orders_of_others(t):
    """Orders per customer outside the top-customers table."""
    return orphan_keys(t.orders(), gold.etl_top_customers(t.read("customer")),
                       "customer_id", "custkey")


# --- aggregates

@query("a1_count", "SELECT count(*) AS n FROM lineitem")
def count_all(t):
    return t.read("lineitem").agg(F.count("*").alias("n"))


@query("a2_count_distinct", """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1""")
def count_distinct(t):
    return t.read("lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("orders"))


@query("a3_sum", """
    SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units FROM s_items GROUP BY 1""")
def units(t):
    return t.items().groupBy("product_id").agg(F.sum("quantity").alias("units"))


@query("a4_sum_of_product", """
    SELECT order_id, CAST(round(sum(quantity * CAST(unit_price AS DECIMAL(18,4))), 2) AS DOUBLE)
             AS amount
    FROM s_items GROUP BY 1""")
def amounts(t):
    line = F.col("quantity") * minor_units(F.col("unit_price"))
    return t.items().groupBy("order_id").agg(from_minor_units(F.sum(line)).alias("amount"))


@query("a5_average", """
    SELECT l_returnflag, round(avg(CAST(l_quantity AS BIGINT)), 6) AS quantity
    FROM lineitem GROUP BY 1""")
def average(t):
    return t.read("lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg(F.col("l_quantity").cast("bigint")), 6).alias("quantity"))


@query("a6_minimum", """
    SELECT c_mktsegment, min(c_acctbal) AS lowest FROM customer GROUP BY 1""")
def minimum(t):
    return t.read("customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lowest"))


@query("a7_missing_count", """
    SELECT count(*) FILTER (name IS NULL) AS names,
           count(*) FILTER (signup_date IS NULL) AS signups FROM s_customers""")
def missing(t):
    return t.customers().agg(Q.missing_count("name").alias("names"),
                             Q.missing_count("signup_date").alias("signups"))


@query("a8_sum_or_zero", """
    SELECT o.order_id, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units
    FROM s_orders o LEFT JOIN s_items i ON o.order_id = i.order_id GROUP BY 1""")
def sum_or_zero(t):
    units = t.items().groupBy("order_id").agg(F.sum("quantity").alias("units"))
    return t.orders().join(units, "order_id", "left").select(
        "order_id", F.coalesce("units", F.lit(0)).alias("units"))


@query("a9_ratio_of_sums", """
    SELECT CAST(sum(orders) AS BIGINT) AS orders,
           round(CAST(sum(CAST(revenue AS DECIMAL(20,2))) AS DOUBLE) / sum(orders), 4) AS ratio
    FROM g_daily_revenue""")
def ratio(t):
    revenue = F.sum(F.col("revenue").cast("decimal(20,2)")).cast("double")
    return gold.gold_daily_revenue(t.orders(), t.items()).agg(
        F.sum("orders").alias("orders"), F.round(revenue / F.sum("orders"), 4).alias("ratio"))


@query("a10_group_by_ordinals", """
    SELECT channel, status, CAST(order_ts AS DATE) AS day, count(*) AS n
    FROM s_orders GROUP BY 1, 2, 3""")
def by_ordinals(t):
    return t.spark.sql("""
        SELECT channel, status, CAST(order_ts AS DATE) AS day, count(*) AS n
        FROM {orders} GROUP BY 1, 2, 3""", orders=t.orders())


@query("a11_mart_rollup", """
    SELECT order_date, CAST(sum(CAST(revenue AS DECIMAL(20,2))) AS DOUBLE) AS revenue,
           CAST(sum(orders) AS BIGINT) AS orders
    FROM g_daily_revenue GROUP BY 1""")
def mart_rollup(t):
    return gold.gold_daily_revenue(t.orders(), t.items()).groupBy("order_date").agg(
        F.sum(F.col("revenue").cast("decimal(20,2)")).cast("double").alias("revenue"),
        F.sum("orders").alias("orders"))


# --- ranks and state

RANKS = """
    SELECT user_id, event_id, ts_ms,
           row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS rn
    FROM s_event_log"""


@query("w1_rank_changes", RANKS)
def ranked(t):
    log = t.event_log().select("user_id", "event_id", "ts_ms")
    return rank_changes(log, "user_id", ["ts_ms", "event_id"])


@query("w1_rank_changes_by_day", RANKS)
def ranked_by_day(t):
    log = t.event_log().select("user_id", "event_id", "ts_ms")
    day = F.floor(F.col("ts_ms") / F.lit(86_400_000))
    return rank_changes(log, "user_id", ["ts_ms", "event_id"], day)


@query("w2_latest_by_key", """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
      FROM lineitem) WHERE rn = 1""")
def newest_lines(t):
    return t.lines().select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


_LAST_EVENT = """
    SELECT user_id, op, ts_ms, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) AS rn
      FROM s_event_log {where}) WHERE rn = 1 {having}"""


@query("w2_latest_ignoring_deletes", _LAST_EVENT.format(where="WHERE op <> 'd'", having=""))
def ignoring_deletes(t):
    return latest_by_key(t.event_log(), "user_id", ["ts_ms", "event_id"])


@query("w2_latest_applying_deletes", _LAST_EVENT.format(where="", having="AND op <> 'd'"))
def applying_deletes(t):
    return latest_by_key(t.event_log(), "user_id", ["ts_ms", "event_id"], APPLY)


@query("v1_state_as_of", f"""
    SELECT item_id, order_id, product_id, quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id
                ORDER BY l_shipdate DESC, product_id DESC, l_suppkey DESC) AS rn
      FROM s_item_log WHERE l_shipdate <= TIMESTAMP '{CUT}') WHERE rn = 1""")
def as_of_cut(t):
    log = t.read("lineitem").withColumn("ts_ms", epoch_millis(F.col("l_shipdate")))
    log = as_of(log, cut_ms()).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    newest = latest_by_key(log, ["l_orderkey", "l_linenumber"],
                           ["l_shipdate", "l_partkey", "l_suppkey"], None)
    return newest.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"),
                         F.col("l_orderkey").alias("order_id"),
                         F.col("l_partkey").alias("product_id"),
                         F.col("l_quantity").cast("bigint").alias("quantity"))


@query("v1_silver_as_of", f"""
    SELECT * FROM s_orders WHERE order_ts <= TIMESTAMP '{CUT}'""")
def silver_as_of(t):
    return state_as_of(t.bronze(), ORDERS, cut_ms())


@query("v2_upsert", _LAST_EVENT.format(where="", having="AND op <> 'd'"))
def upserted(t):
    """Two of three events as state, with its deletes, then the others as one batch: changes
    of all times, many older than the delete of their user."""
    log, order = t.event_log(), ["ts_ms", "event_id"]
    third = F.xxhash64("event_id") % 3 == 0
    current = latest_by_key(log.where(~third), "user_id", order, None)
    return live(upsert(current, log.where(third), "user_id", order)).select(
        "user_id", "op", "ts_ms", "event_id", "event_type", "value")


@query("v3_align", """
    SELECT order_id, customer_id, order_ts, channel, status, CAST(NULL AS VARCHAR) AS coupon
    FROM s_orders""")
def aligned(t):
    wider = Contract("orders", "order_id", ORDERS.fields + (Field("coupon", T.StringType()),))
    return align(t.orders().withColumn("legacy", F.lit(1)), wider)


@query("s7_snapshot_to_changes", """
    SELECT 'orders' AS table_name, 'r' AS op, epoch_us(order_ts) // 1000 AS ts_ms,
           CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
           strftime(order_ts, '%Y-%m-%d %H:%M:%S') AS order_ts, channel, status
    FROM s_orders""")
def snapshot(t):
    log = snapshot_to_changes(t.orders(), "orders", epoch_millis(F.col("order_ts")))
    return log.select("table_name", "op", "ts_ms", *[
        F.get_json_object("after", f"$.{c}").alias(c) for c in ORDERS.columns])


DIFFERENCES = """
    SELECT coalesce(n.item_id, o.item_id) AS item_id,
           CASE WHEN o.item_id IS NULL THEN 'c' WHEN n.item_id IS NULL THEN 'd' ELSE 'u' END AS op,
           o.product_id AS old_product, n.product_id AS new_product, n.quantity AS new_quantity
    FROM d_old o FULL JOIN d_new n ON o.item_id = n.item_id
    WHERE (o.product_id, o.quantity) IS DISTINCT FROM (n.product_id, n.quantity)"""
SNAPSHOTS = {"d_old": f"""
    SELECT item_id, product_id, quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id
                ORDER BY l_shipdate DESC, product_id DESC, l_suppkey DESC) AS rn
      FROM s_item_log WHERE l_shipdate <= TIMESTAMP '{CUT}') WHERE rn = 1""", "d_new": """
    SELECT item_id, product_id, quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id
                ORDER BY l_shipdate DESC, product_id DESC, l_suppkey DESC) AS rn
      FROM s_item_log) WHERE rn = 1 AND l_returnflag <> 'R'"""}


def item_snapshots(t):
    """The items as of a day, and the items now, less those returned."""
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id")
    kept = t.lines().where(F.col("l_returnflag") != "R").select(
        key, F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"))
    return as_of_cut(t).drop("order_id"), kept


def item_changes(changes):
    def image(side, name):
        return F.get_json_object(side, f"$.{name}").cast("bigint")
    return changes.select("item_id", "op", image("before", "product_id").alias("old_product"),
                          image("after", "product_id").alias("new_product"),
                          image("after", "quantity").alias("new_quantity"))


@query("s8_diff_to_changes", DIFFERENCES, **SNAPSHOTS)
def differences(t):
    return item_changes(diff_to_changes(*item_snapshots(t), "item_id"))


@query("s8_diff_by_digests", DIFFERENCES, **SNAPSHOTS)
def differences_by_digests(t):
    """Both snapshots are kept as tables, as snapshots are; then their digests are compared."""
    old, new = map(materialised, item_snapshots(t))
    return item_changes(diff_by_digests(old, new, "item_id"))


# --- sorts

@query("l1_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
def sorted_rows(t):
    return t.read("customer").select("c_custkey", "c_name").orderBy(
        F.col("c_custkey").asc_nulls_last())


@query("l2_top_k", """
    SELECT custkey, name, acctbal FROM (
      SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer)
    ORDER BY acctbal DESC, custkey LIMIT 5""")
def top_k(t):
    return (gold.etl_top_customers(t.read("customer"))
            .orderBy(F.col("acctbal").desc_nulls_last(), "custkey").limit(5)
            .select("custkey", "name", "acctbal"))


@query("l3_sort_by_ordinal", """
    SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1""")
def sorted_by_ordinal(t):
    return t.spark.sql("""
        SELECT c_mktsegment AS segment, count(*) AS n FROM {customer}
        GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST""", customer=t.read("customer"))


# --- quality

def _result(name, observed, passed):
    return f"""SELECT '{name}' AS "check", CAST({observed} AS DOUBLE) AS observed,
                      {passed} AS passed"""


@query("q1_row_count", _result("row count", "count(*)", "count(*) >= 1") + " FROM orders")
def row_count(t):
    return Q.run_suite(t.orders(), [Q.row_count_between(1)])


@query("q2_not_null", " UNION ALL ".join(
    _result(f"{c} is not null", f"count(*) FILTER ({c} IS NULL)",
            f"count(*) FILTER ({c} IS NULL) = 0") + " FROM s_customers"
    for c in ("customer_id", "country", "signup_date")))
def never_null(t):
    return Q.run_suite(t.customers(),
                       [Q.not_null(c) for c in ("customer_id", "country", "signup_date")])


@query("q3_values_between",
       _result("open", "count(*) FILTER (l_quantity < 1 OR l_quantity > 50)",
               "count(*) FILTER (l_quantity < 1 OR l_quantity > 50) = 0") + " FROM lineitem"
       + " UNION ALL " +
       _result("strict", "count(*) FILTER (l_quantity <= 1 OR l_quantity >= 50)",
               "count(*) FILTER (l_quantity <= 1 OR l_quantity >= 50) = 0") + " FROM lineitem")
def between(t):
    return Q.run_suite(t.read("lineitem"), [
        Q.values_between("l_quantity", 1, 50, name="open"),
        Q.values_between("l_quantity", 1, 50, strict=True, name="strict")])


@query("q4_metric_threshold",
       _result("min(acctbal) > 5000", "min(c_acctbal)", "min(c_acctbal) > 5000")
       + " FROM customer WHERE c_acctbal > 5000")
def threshold(t):
    return Q.run_suite(gold.etl_top_customers(t.read("customer")), [
        Q.metric_threshold(F.min("acctbal"), ">", 5000, "min(acctbal) > 5000")])


@query("q5_no_rows_where",
       _result("no discount above 5%", "count(*) FILTER (l_discount > 0.05)",
               "count(*) FILTER (l_discount > 0.05) = 0") + " FROM lineitem")
def no_rows(t):
    return Q.run_suite(t.read("lineitem"), [
        Q.no_rows_where(F.col("l_discount") > 0.05, "no discount above 5%")])


@query("q6_same_count", """
    SELECT 'orders are paid' AS "check", CAST(d AS DOUBLE) AS observed, d = 0 AS passed
    FROM (SELECT (SELECT count(*) FROM s_orders) - (SELECT count(*) FROM s_payments) AS d)""")
def as_many(t):
    return Q.same_count(t.orders(), t.payments(), "orders are paid")


@query("q7_run_suite", " UNION ALL ".join(
    _result(name, seen, f"{seen} {test}") + " FROM customer WHERE c_acctbal > 5000"
    for name, seen, test in [
        ("row count", "count(*)", ">= 1"),
        ("custkey is not null", "count(*) FILTER (c_custkey IS NULL)", "= 0"),
        ("name is not null", "count(*) FILTER (c_name IS NULL)", "= 0"),
        ("acctbal in range", "count(*) FILTER (c_acctbal < 5000)", "= 0"),
        ("row_count > 0", "count(*)", "> 0"),
        ("missing_count(custkey) = 0", "count(*) FILTER (c_custkey IS NULL)", "= 0"),
        ("min(acctbal) > 5000", "min(c_acctbal)", "> 5000")]))
def suite(t):
    return Q.run_suite(gold.etl_top_customers(t.read("customer")), top_customer_checks())


@query("q7_gold_suite", """
    SELECT 'daily_revenue: row count' AS "check", CAST(count(*) AS DOUBLE) AS observed,
           count(*) >= 1 AS passed FROM g_daily_revenue
    UNION ALL SELECT 'daily_revenue: revenue < 0', CAST(count(*) AS DOUBLE), count(*) = 0
              FROM g_daily_revenue WHERE revenue < 0
    UNION ALL SELECT 'top_products: product_id is not null', CAST(count(*) AS DOUBLE), count(*) = 0
              FROM g_top_products WHERE product_id IS NULL
    UNION ALL SELECT 'customer_ltv: as many rows as customers', CAST(d AS DOUBLE), d = 0
              FROM (SELECT (SELECT count(*) FROM g_customer_ltv)
                           - (SELECT count(*) FROM s_customers) AS d)""")
def gold_suite(t):
    orders, items, customers = t.orders(), materialised(t.items()), t.customers()
    return gold_checks(gold.gold_daily_revenue(orders, items),
                       gold.gold_top_products(items, t.products()),
                       gold.gold_customer_ltv(customers, orders, items), customers)


@query("q8_gate", """
    SELECT 'row count' AS "check", CAST(count(*) AS DOUBLE) AS observed, true AS passed
    FROM lineitem
    UNION ALL SELECT 'l_quantity in range', 0, true""")
def gated(t):
    results = Q.run_suite(t.read("lineitem"), [
        Q.row_count_between(1), Q.values_between("l_quantity", 1, 50)])
    Q.gate(results)
    return results


@query("q10_references", """
    SELECT name AS "check", CAST(n AS DOUBLE) AS observed, n = 0 AS passed FROM (
      SELECT 'items have an order' AS name, count(*) AS n FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL
      SELECT 'orders have items', count(*) FROM orders
      WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""")
def referenced(t):
    orders, lines = t.read("orders"), t.read("lineitem")
    return (Q.references(lines, orders, "l_orderkey", "items have an order", "o_orderkey")
            .unionByName(Q.references(orders, lines, "o_orderkey", "orders have items",
                                      "l_orderkey")))
