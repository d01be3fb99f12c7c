"""Dashboard cards over the gold marts.

Amounts in the marts are rounded per group already, and the cards sum those. Sums run on
decimals, so that they do not depend on the order of the rows.
"""

from functools import reduce

from pyspark.sql import functions as F

from cdclake.functions.money import rounded


def _revenue(places=None):
    total = F.sum(rounded(F.col("revenue")))
    return (total if places is None else F.round(total, places)).cast("double")


def kpi_total_revenue(daily):
    return daily.agg(_revenue(0).alias("total_revenue"))


def kpi_total_orders(daily):
    """Sum of orders per day and channel; adds up as an order has one day and one channel."""
    return daily.agg(F.sum("orders").alias("total_orders"))


def kpi_customers(ltv):
    return ltv.agg(F.count("*").alias("customers"))


def kpi_avg_order_value(daily):
    return daily.agg(F.round(_revenue() / F.sum("orders"), 2).alias("avg_order_value"))


def daily_trend(daily):
    return (daily.groupBy("order_date").agg(_revenue(0).alias("revenue"))
            .orderBy(F.col("order_date").asc_nulls_last()))


def revenue_by_channel(daily):
    return (daily.groupBy("channel").agg(_revenue(0).alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_last(), F.col("channel").asc_nulls_last()))


def top_products(products, k=10):
    return (products.orderBy(F.col("revenue").desc_nulls_last(), "product_id")
            .limit(k).select("name", "revenue"))


def avg_ltv_by_segment(ltv):
    mean = F.sum(rounded(F.col("lifetime_value"))).cast("double") / F.count("lifetime_value")
    return ltv.groupBy("segment").agg(F.round(mean, 0).alias("avg_ltv"))


def mart_report(marts, products, k=3):
    """Rows per mart and the k best products, as (item, name, value)."""
    counts = [mart.agg(F.count("*").cast("double").alias("value"))
              .select(F.lit("rows").alias("item"), F.lit(name).alias("name"), "value")
              for name, mart in marts.items()]
    best = top_products(products, k).select(
        F.lit("top product").alias("item"), "name", F.col("revenue").alias("value"))
    return reduce(lambda a, b: a.unionByName(b), counts + [best])
