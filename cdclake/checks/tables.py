"""The shop's tables as derived from the test tables, in Spark and in SQL."""

import re
from decimal import Decimal

from pyspark.sql import functions as F

from cdclake import contracts as C
from cdclake.functions.images import epoch_millis
from cdclake.operators.changes import snapshot_to_changes
from cdclake.operators.state import latest_by_key
from cdclake.session import prepare, spread

ITEM_VERSION = ["l_shipdate", "l_partkey", "l_suppkey"]
START = "1970-01-01 00:00:00"


# Declared, so that opening a table needs no job that looks at its files.
SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}


class Tables:
    """Lazy shop tables over one folder of test tables."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.opened = prepare(spark), folder, {}

    def read(self, name):
        if name not in self.opened:
            reader = self.spark.read.schema(SCHEMAS[name])
            self.opened[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self.opened[name]

    def customers(self):
        nation = self.read("nation").select("n_nationkey", F.col("n_name").alias("country"))
        key = F.col("c_custkey")
        return (self.read("customer")
                .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                .select(key.alias("customer_id"), F.col("c_name").alias("name"),
                        F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com"))
                        .alias("email"),
                        "country", F.col("c_mktsegment").alias("segment"),
                        F.lit(None).cast("timestamp_ntz").alias("signup_date")))

    def products(self):
        price = F.col("p_retailprice").cast("decimal(12,2)")
        return self.read("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"), price.cast("double").alias("unit_price"),
            (price * F.lit(Decimal("0.6"))).cast("double").alias("unit_cost"))

    def orders(self):
        code = F.col("o_orderstatus")
        status = (F.when(code == "F", "delivered").when(code == "O", "placed")
                  .when(code == "P", "cancelled"))
        return self.read("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_ts"), F.col("o_orderpriority").alias("channel"),
            status.alias("status"))

    def _as_items(self, lines, *extra):
        price = self.products().select(F.col("product_id").alias("_part"), "unit_price")
        return lines.join(price, F.col("l_partkey") == F.col("_part"), "left").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"),
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"), "unit_price", *extra)

    def item_log(self):
        """Every version of every line item."""
        return self._as_items(spread(self.read("lineitem")), "l_shipdate")

    def lines(self):
        """Newest version of every line item, as the source has it."""
        log = self.read("lineitem").select(
            "l_orderkey", "l_linenumber", *ITEM_VERSION, "l_quantity", "l_returnflag")
        return latest_by_key(log, ["l_orderkey", "l_linenumber"], ITEM_VERSION, None)

    def items(self):
        return self._as_items(self.lines())

    def payments(self):
        orders = self.read("orders").where(F.col("o_orderstatus") != "P")
        return orders.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("method"),
            F.col("o_totalprice").alias("amount"), F.lit("captured").alias("status"),
            F.col("o_orderdate").alias("paid_ts"))

    def events(self):
        return self.read("events").select(
            "event_id", F.col("user_id").alias("customer_id"), "event_type",
            F.col("ts").alias("event_ts"), F.col("props").alias("payload"))

    def event_log(self):
        """Events as changes of their user; an error deletes the user."""
        op = F.when(F.col("event_type") == "error", "d").otherwise("u")
        return self.read("events").select(
            "user_id", op.alias("op"), epoch_millis(F.col("ts")).alias("ts_ms"),
            "event_id", "event_type", "value")

    def bronze(self):
        """Change log of all six tables."""
        start = epoch_millis(F.lit(START).cast("timestamp_ntz"))
        logs = [
            snapshot_to_changes(self.customers(), "customers", start),
            snapshot_to_changes(self.products(), "products", start),
            snapshot_to_changes(self.orders(), "orders", epoch_millis(F.col("order_ts"))),
            snapshot_to_changes(self.item_log(), "order_items", epoch_millis(F.col("l_shipdate")),
                                columns=C.ORDER_ITEMS.columns),
            snapshot_to_changes(self.payments(), "payments", epoch_millis(F.col("paid_ts"))),
            snapshot_to_changes(self.events(), "events", epoch_millis(F.col("event_ts")), "c"),
        ]
        log = logs[0]
        for more in logs[1:]:
            log = log.unionByName(more)
        return log

    def samples(self):
        """Events as metric samples: one series per user and type."""
        return self.read("events").select(
            F.col("ts").cast("timestamp").alias("ts"), F.lit("event_value").alias("metric"),
            F.create_map(F.lit("user"), F.col("user_id").cast("string"),
                         F.lit("name"), F.col("event_type")).alias("labels"), "value")

    def lineage(self):
        """Run events: lines make orders from parts and suppliers, orders belong to
        customers, customers to nations, nations to regions."""
        def dataset(kind, key):
            return F.struct(F.lit(kind).alias("namespace"),
                            F.col(key).cast("string").alias("name"))

        def runs(table, job, inputs, output):
            return spread(self.read(table)).select(
                F.lit("COMPLETE").alias("eventType"),
                F.struct(F.lit("shop").alias("namespace"), F.lit(job).alias("name")).alias("job"),
                F.array(*[dataset(*i) for i in inputs]).alias("inputs"),
                F.array(dataset(*output)).alias("outputs"))

        steps = [
            ("lineitem", "ship", [("part", "l_partkey"), ("supplier", "l_suppkey")],
             ("order", "l_orderkey")),
            ("orders", "sell", [("order", "o_orderkey")], ("customer", "o_custkey")),
            ("customer", "settle", [("customer", "c_custkey")], ("nation", "c_nationkey")),
            ("nation", "belong", [("nation", "n_nationkey")], ("region", "n_regionkey")),
        ]
        events = runs(*steps[0])
        for step in steps[1:]:
            events = events.unionByName(runs(*step))
        return events


# The same tables for the SQL side.
CTES = {
    "s_customers": """
        SELECT c_custkey AS customer_id, c_name AS name,
               'user' || c_custkey || '@example.com' AS email, n_name AS country,
               c_mktsegment AS segment, CAST(NULL AS TIMESTAMP) AS signup_date
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "s_products": """
        SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS unit_price,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 0.6 AS DOUBLE) AS unit_cost
        FROM part""",
    "s_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_ts,
               o_orderpriority AS channel,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'placed'
                                  WHEN 'P' THEN 'cancelled' END AS status
        FROM orders""",
    "s_item_log": """
        SELECT l_orderkey * 8 + l_linenumber AS item_id, l_orderkey AS order_id,
               l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, unit_price,
               l_shipdate, l_suppkey, l_returnflag
        FROM lineitem LEFT JOIN s_products ON l_partkey = product_id""",
    "s_items": """
        SELECT item_id, order_id, product_id, quantity, unit_price FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id
                    ORDER BY l_shipdate DESC, product_id DESC, l_suppkey DESC) AS rn
          FROM s_item_log) WHERE rn = 1""",
    # Ties on the day of a version are settled by the text of the row image.
    "s_silver_items": """
        SELECT item_id, order_id, product_id, quantity, unit_price FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY l_shipdate DESC,
                    to_json({'item_id': item_id, 'order_id': order_id,
                             'product_id': product_id, 'quantity': quantity,
                             'unit_price': unit_price})::VARCHAR DESC) AS rn
          FROM s_item_log) WHERE rn = 1""",
    "s_payments": """
        SELECT o_orderkey AS order_id, o_orderpriority AS method, o_totalprice AS amount,
               'captured' AS status, o_orderdate AS paid_ts
        FROM orders WHERE o_orderstatus <> 'P'""",
    "s_event_log": """
        SELECT user_id, CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op,
               epoch_us(ts) // 1000 AS ts_ms, event_id, event_type, value
        FROM events""",
    "g_daily_revenue": """
        SELECT CAST(order_ts AS DATE) AS order_date, channel,
               count(DISTINCT o.order_id) AS orders,
               CAST(round(sum(quantity * CAST(unit_price AS DECIMAL(18,4))), 2) AS DOUBLE)
                 AS revenue
        FROM s_orders o JOIN s_items i ON o.order_id = i.order_id
        WHERE status <> 'cancelled' GROUP BY ALL""",
    "g_top_products": """
        SELECT p.product_id, name, category, CAST(sum(quantity) AS BIGINT) AS units,
               CAST(round(sum(quantity * CAST(i.unit_price AS DECIMAL(18,4))), 2) AS DOUBLE)
                 AS revenue,
               CAST(round(sum(quantity * (CAST(i.unit_price AS DECIMAL(18,4))
                                          - CAST(unit_cost AS DECIMAL(18,4)))), 2) AS DOUBLE)
                 AS margin
        FROM s_items i JOIN s_products p ON i.product_id = p.product_id GROUP BY ALL""",
    "g_customer_ltv": """
        SELECT c.customer_id, segment, country, count(DISTINCT o.order_id) AS orders,
               CAST(round(coalesce(sum(quantity * CAST(unit_price AS DECIMAL(18,4))), 0), 2)
                 AS DOUBLE) AS lifetime_value
        FROM s_customers c
        LEFT JOIN s_orders o ON c.customer_id = o.customer_id AND status <> 'cancelled'
        LEFT JOIN s_items i ON o.order_id = i.order_id GROUP BY ALL""",
    "s_samples": """
        SELECT ts, user_id, event_type, value FROM events""",
    "s_versions": """
        SELECT *, md5('{"job":"' || job || '","ins":["' || array_to_string(ins, '","')
                      || '"],"outs":["' || array_to_string(outs, '","') || '"]}') AS version
        FROM (
          SELECT DISTINCT 'shop.ship' AS job,
                 list_sort(['part.' || l_partkey, 'supplier.' || l_suppkey]) AS ins,
                 ['order.' || l_orderkey] AS outs FROM lineitem
          UNION SELECT 'shop.sell', ['order.' || o_orderkey], ['customer.' || o_custkey]
                FROM orders
          UNION SELECT 'shop.settle', ['customer.' || c_custkey], ['nation.' || c_nationkey]
                FROM customer
          UNION SELECT 'shop.belong', ['nation.' || n_nationkey], ['region.' || n_regionkey]
                FROM nation)""",
    "s_edges": """
        SELECT 'shop.ship' AS job, 'part.' || l_partkey AS input, 'order.' || l_orderkey AS output
        FROM lineitem
        UNION SELECT 'shop.ship', 'supplier.' || l_suppkey, 'order.' || l_orderkey FROM lineitem
        UNION SELECT 'shop.sell', 'order.' || o_orderkey, 'customer.' || o_custkey FROM orders
        UNION SELECT 'shop.settle', 'customer.' || c_custkey, 'nation.' || c_nationkey
              FROM customer
        UNION SELECT 'shop.belong', 'nation.' || n_nationkey, 'region.' || n_regionkey
              FROM nation""",
}


def _used(text):
    return [name for name in CTES if re.search(rf"\b{name}\b", text)]


def with_tables(body, extra=None):
    """SQL text with the shop tables it names, and further common tables, put in front."""
    extra = extra or {}
    needed, queue = set(), _used(" ".join([body, *extra.values()]))
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += _used(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
