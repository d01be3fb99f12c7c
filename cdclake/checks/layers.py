"""Silver through the bronze log, marts, cards and reports."""

from cdclake.checks.registry import query
from cdclake.plans import dashboards as D
from cdclake.plans import gold, silver
from cdclake.session import materialised


def daily(t):
    return gold.gold_daily_revenue(t.orders(), t.items())


def products(t):
    return gold.gold_top_products(t.items(), t.products())


def ltv(t):
    return gold.gold_customer_ltv(t.customers(), t.orders(), t.items())


query("b1_silver_customers", "SELECT * FROM s_customers")(
    lambda t: silver.silver_customers(t.bronze()))
query("b2_silver_products", "SELECT * FROM s_products")(
    lambda t: silver.silver_products(t.bronze()))
query("b3_silver_orders", "SELECT * FROM s_orders")(
    lambda t: silver.silver_orders(t.bronze()))
query("b4_silver_order_items", "SELECT * FROM s_silver_items")(
    lambda t: silver.silver_order_items(t.bronze()))
query("b5_silver_payments", "SELECT * FROM s_payments")(
    lambda t: silver.silver_payments(t.bronze()))
query("b5_silver_events", """
    SELECT event_id, user_id AS customer_id, event_type, ts AS event_ts, props AS payload
    FROM events""")(lambda t: silver.silver_events(t.bronze()))

query("b6_gold_daily_revenue", "SELECT * FROM g_daily_revenue")(daily)
query("b7_gold_top_products", "SELECT * FROM g_top_products")(products)
query("b8_gold_customer_ltv", "SELECT * FROM g_customer_ltv")(ltv)
query("b9_etl_top_customers", """
    SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal, c_nationkey AS nationkey
    FROM customer WHERE c_acctbal > 5000""")(
    lambda t: gold.etl_top_customers(t.read("customer")))


@query("b6_daily_revenue_from_bronze", """
    SELECT CAST(order_ts AS DATE) AS order_date, channel, count(DISTINCT o.order_id) AS orders,
           CAST(round(sum(quantity * CAST(unit_price AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue
    FROM s_orders o JOIN s_silver_items i ON o.order_id = i.order_id
    WHERE status <> 'cancelled' GROUP BY ALL""")
def daily_from_bronze(t):
    """Change log to mart in one plan."""
    bronze = t.bronze()
    return gold.gold_daily_revenue(silver.silver_orders(bronze),
                                   silver.silver_order_items(bronze))


query("d1_kpi_total_revenue", """
    SELECT CAST(round(sum(CAST(revenue AS DECIMAL(20,2))), 0) AS DOUBLE) AS total_revenue
    FROM g_daily_revenue""")(lambda t: D.kpi_total_revenue(daily(t)))
query("d2_kpi_total_orders", """
    SELECT CAST(sum(orders) AS BIGINT) AS total_orders FROM g_daily_revenue""")(
    lambda t: D.kpi_total_orders(daily(t)))
query("d3_kpi_customers", "SELECT count(*) AS customers FROM g_customer_ltv")(
    lambda t: D.kpi_customers(ltv(t)))
query("d4_kpi_avg_order_value", """
    SELECT round(CAST(sum(CAST(revenue AS DECIMAL(20,2))) AS DOUBLE) / sum(orders), 2)
             AS avg_order_value
    FROM g_daily_revenue""")(lambda t: D.kpi_avg_order_value(daily(t)))
query("d5_daily_trend", """
    SELECT order_date, CAST(round(sum(CAST(revenue AS DECIMAL(20,2))), 0) AS DOUBLE) AS revenue
    FROM g_daily_revenue GROUP BY 1 ORDER BY 1""")(lambda t: D.daily_trend(daily(t)))
query("d6_revenue_by_channel", """
    SELECT channel, CAST(round(sum(CAST(revenue AS DECIMAL(20,2))), 0) AS DOUBLE) AS revenue
    FROM g_daily_revenue GROUP BY 1 ORDER BY 2 DESC, 1""")(
    lambda t: D.revenue_by_channel(daily(t)))
query("d7_top10_products", """
    SELECT name, revenue FROM g_top_products ORDER BY revenue DESC, product_id LIMIT 10""")(
    lambda t: D.top_products(products(t), 10))
query("d8_avg_ltv_by_segment", """
    SELECT segment, round(CAST(sum(CAST(lifetime_value AS DECIMAL(20,2))) AS DOUBLE)
                          / count(lifetime_value), 0) AS avg_ltv
    FROM g_customer_ltv GROUP BY 1""")(lambda t: D.avg_ltv_by_segment(ltv(t)))

REPORT = """
    SELECT 'rows' AS item, 'daily_revenue' AS name, CAST(count(*) AS DOUBLE) AS value
    FROM g_daily_revenue
    UNION ALL SELECT 'rows', 'top_products', CAST(count(*) AS DOUBLE) FROM g_top_products
    UNION ALL SELECT 'rows', 'customer_ltv', CAST(count(*) AS DOUBLE) FROM g_customer_ltv
    UNION ALL SELECT 'top product', name, revenue FROM (
      SELECT name, revenue FROM g_top_products ORDER BY revenue DESC, product_id LIMIT 3)"""


@query("d9_mart_report", REPORT)
def report(t):
    items, orders = materialised(t.items()), t.orders()
    totals = gold.order_totals(items)
    marts = {"daily_revenue": gold.daily_revenue(orders, totals),
             "top_products": gold.gold_top_products(items, t.products()),
             "customer_ltv": gold.customer_ltv(t.customers(), orders, totals)}
    return D.mart_report(marts, marts["top_products"])
