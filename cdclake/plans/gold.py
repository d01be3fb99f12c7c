"""Gold marts over silver state tables, whose keys are unique.

Line items are the largest table, and one order or product may hold much of it. So they
are summed per order or product first, which combines within each task before the
shuffle, and the joins then meet one row per key.
"""

from pyspark.sql import functions as F

from cdclake.functions.money import PLACES, from_minor_units, minor_units

# Fixed values of the marts' rules.
CANCELLED = "cancelled"
TOP_CUSTOMER_BALANCE = 5000


def billed(orders):
    """Orders that count; a NULL status does not, under SQL rules."""
    return orders.where(F.col("status") != CANCELLED)


def order_totals(items, digits=PLACES):
    """Amount of each order in minor units of so many digits. Shared by two marts."""
    line = F.col("quantity") * minor_units(F.col("unit_price"), digits)
    return items.groupBy("order_id").agg(F.sum(line).alias("amount"))


def daily_revenue(orders, totals, digits=PLACES):
    """Orders with items and their revenue, per day and channel; `totals` from order_totals."""
    return (billed(orders).join(totals, "order_id")
            .groupBy(F.col("order_ts").cast("date").alias("order_date"), "channel")
            .agg(F.countDistinct("order_id").alias("orders"),
                 from_minor_units(F.sum("amount"), digits=digits).alias("revenue")))


def customer_ltv(customers, orders, totals, digits=PLACES):
    """Orders and lifetime value per customer.

    Customers without a billed order stay, with zeros; orders without items count.
    """
    spent = (billed(orders).join(totals, "order_id", "left")
             .groupBy("customer_id")
             .agg(F.countDistinct("order_id").alias("orders"), F.sum("amount").alias("amount")))
    return customers.join(spent, "customer_id", "left").select(
        "customer_id", "segment", "country",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        from_minor_units(F.coalesce("amount", F.lit(0)), digits=digits).alias("lifetime_value"))


def gold_daily_revenue(orders, items, digits=PLACES):
    return daily_revenue(orders, order_totals(items, digits), digits)


def gold_customer_ltv(customers, orders, items, digits=PLACES):
    return customer_ltv(customers, orders, order_totals(items, digits), digits)


def gold_top_products(items, products, digits=PLACES):
    """Units, revenue and margin per product sold, cancelled orders included.

    margin = sum(quantity * (price - cost)); the cost is one value per product, so it is
    revenue less cost times the units that have a price.
    """
    price, quantity = F.col("price"), F.col("quantity")
    priced = items.select("product_id", "quantity",
                          minor_units(F.col("unit_price"), digits).alias("price"))
    sold = priced.groupBy("product_id").agg(
        F.sum("quantity").alias("units"),
        F.sum(quantity * price).alias("amount"),
        F.sum(F.when(price.isNotNull(), quantity)).alias("priced"))
    margin = F.col("amount") - minor_units(F.col("unit_cost"), digits) * F.col("priced")
    return sold.join(products, "product_id").select(
        "product_id", "name", "category", "units",
        from_minor_units(F.col("amount"), digits=digits).alias("revenue"),
        from_minor_units(margin, digits=digits).alias("margin"))


def etl_top_customers(customer):
    """Customers with a balance above the bound, from the benchmark's customer table."""
    return customer.where(F.col("c_acctbal") > TOP_CUSTOMER_BALANCE).select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"))
