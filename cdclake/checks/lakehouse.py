"""Sources, sinks, streams and whole jobs, in a folder of their own for every run."""

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdclake.checks.layers import REPORT
from cdclake.checks.registry import query
from cdclake.contracts import CONTRACTS, ORDERS, SILVER
from cdclake.functions.images import epoch_millis
from cdclake.operators.changes import TOPIC_PREFIX
from cdclake.operators.state import APPLY
from cdclake.plans import gold
from cdclake.plans.jobs import (
    LakeConfig, bronze_log, run_etl, run_ingest, run_pipeline, start_ingest)
from cdclake.plans.silver import silver_events, silver_orders
from cdclake.session import materialised, shared_dir
from cdclake.sinks import tables as K
from cdclake.sinks.state_table import Folder
from cdclake.sources import files
from cdclake.sources.generator import generate_orders_delta

ETL = """
    SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal, c_nationkey AS nationkey
    FROM customer WHERE c_acctbal > 5000"""


class Lake:
    """A fresh folder, and namespaces that belong to it."""

    def __init__(self, spark):
        self.spark, self.run = spark, uuid.uuid4().hex[:12]
        self.folder = f"{shared_dir(spark)}/run-{self.run}"

    def namespace(self, layer):
        return f"cdclake_{layer}_{self.run}"

    def table(self, name):
        space = self.namespace("check")
        K.ensure_namespace(self.spark, space, f"{self.folder}/check")
        return f"{space}.{name}"

    def config(self, **more):
        return LakeConfig(
            warehouse=self.folder, bronze=f"{self.namespace('bronze')}.cdc_events",
            lineage=f"{self.namespace('lineage')}.events",
            **{layer: self.namespace(layer)
               for layer in ("silver", "gold", "staging", "etl", "demo")},
            **more)


@query("s1_csv_round_trip", "SELECT * FROM s_orders")
def csv_round_trip(t):
    path = f"{Lake(t.spark).folder}/orders"
    K.write_csv_table(t.orders(), path)
    return files.read_csv_table(t.spark, path, ORDERS)


@query("s3_read_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def read_files(t):
    return files.read_table(t.spark, f"{t.folder}/supplier.parquet", "parquet")


@query("s4_tpch_customer", "SELECT * FROM customer")
def customer(t):
    return files.tpch_customer(t.spark, t.folder)


@query("s10_orders_delta", """
    SELECT count(*) AS rows, max(o_orderkey) + 1 AS first_id, max(o_orderkey) + count(*) AS last_id,
           count(*) AS placed, count(*) AS known_customers, 3 AS channels
    FROM orders""")
def new_orders(t):
    """As many new orders as there are, with ids after the last one."""
    orders = t.orders()
    delta = generate_orders_delta(t.spark, orders, orders.count(), customers=2000)
    return delta.agg(
        F.count("*").alias("rows"), F.min("order_id").alias("first_id"),
        F.max("order_id").alias("last_id"), F.count_if(F.col("status") == "placed").alias("placed"),
        F.count_if(F.col("customer_id").between(1, 2000)).alias("known_customers"),
        F.countDistinct("channel").cast("int").alias("channels"))


@query("k4_ctas", ETL)
def ctas(t):
    name = Lake(t.spark).table("top_customers")
    K.ctas(gold.etl_top_customers(t.read("customer")), name)
    return t.spark.table(name)


@query("k5_replace_table", ETL)
def replaced(t):
    """All customers first; then the table is replaced from a query over itself."""
    name = Lake(t.spark).table("customers")
    every = t.read("customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"))
    K.replace_table(every, name)
    K.replace_table(t.spark.table(name).where(F.col("acctbal") > 5000), name)
    return t.spark.table(name)


@query("k6_append", """
    SELECT order_id, status FROM s_orders UNION ALL SELECT order_id, status FROM s_payments""")
def appended(t):
    name = Lake(t.spark).table("states")
    K.recreate_table(t.spark, name, "order_id BIGINT, status STRING")
    K.append(t.orders().select("status", "order_id"), name)
    K.insert_select(t.payments().select("order_id", "status"), name)
    return t.spark.table(name)


@query("j6_cross_source_join", """
    SELECT c.customer_id, segment, order_id FROM s_customers c JOIN s_orders o
    ON c.customer_id = o.customer_id""")
def across_sources(t):
    """A lakehouse table joined with text files from another source."""
    lake = Lake(t.spark)
    name, path = lake.table("customers"), f"{lake.folder}/orders"
    K.ctas(t.customers(), name)
    K.write_csv_table(t.orders(), path)
    orders = files.read_csv_table(t.spark, path, ORDERS)
    return t.spark.table(name).join(orders, "customer_id").select(
        "customer_id", "segment", "order_id")


def topic_records(df, table, ts_ms, wrapped=False, op="c"):
    """Rows as broker records of one topic; a delete has its row before. An image has its
    fields as text."""
    after = F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])
    change = F.struct(F.lit(op).alias("op"), ts_ms.alias("ts_ms"),
                      after.alias("before" if op == "d" else "after"))
    value = F.to_json(F.struct(change.alias("payload")) if wrapped else change,
                      {"ignoreNullFields": "false"})
    return df.select(F.lit(TOPIC_PREFIX + table).alias("topic"), value.alias("value"))


def publish(folder, *records):
    """Records of several topics for the file source, written by one job, so that a small
    table or the last tasks of a large one do not hold up the others."""
    reduce(DataFrame.unionByName, records).write.mode("append").parquet(folder)


def ingested(t, lake):
    """Orders and events through the stream, in both forms of the envelope."""
    topics = f"{lake.folder}/topics"
    publish(topics,
            topic_records(t.orders(), "orders", epoch_millis(F.col("order_ts"))),
            topic_records(t.events(), "events", epoch_millis(F.col("event_ts")), wrapped=True))
    cfg = lake.config(source_format="parquet", brokers=topics,
                      checkpoint=f"{lake.folder}/checkpoint")
    run_ingest(t.spark, cfg, once=True)
    return t.spark.table(cfg.bronze)


@query("x1_stream_ingest", """
    SELECT 'orders' AS table_name, 'c' AS op, epoch_us(order_ts) // 1000 AS ts_ms, order_id AS id
    FROM s_orders
    UNION ALL SELECT 'events', 'c', epoch_us(ts) // 1000, event_id FROM events""")
def stream_ingest(t):
    key = F.coalesce(F.get_json_object("after", "$.event_id"),
                     F.get_json_object("after", "$.order_id"))
    return ingested(t, Lake(t.spark)).select("table_name", "op", "ts_ms",
                                             key.cast("bigint").alias("id"))


@query("x5_silver_from_stream", "SELECT * FROM s_orders")
def silver_from_stream(t):
    return silver_orders(ingested(t, Lake(t.spark)))


def all_six(t):
    """Name, rows and contract key of every table of the shop."""
    shop = {"customers": t.customers(), "products": t.products(), "orders": t.orders(),
            "order_items": t.items(), "payments": t.payments(), "events": t.events()}
    return [(name, df, CONTRACTS[name].key) for name, df in shop.items()]


def _six(columns):
    sources = {"events": ("events", "event_id")} | {
        name: (f"s_{name.removeprefix('order_')}", key) for name, key in (
            ("customers", "customer_id"), ("products", "product_id"), ("orders", "order_id"),
            ("order_items", "item_id"), ("payments", "order_id"))}
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, {columns.format(key=key)} FROM "
                              f"{source}" for name, (source, key) in sources.items())


def _keys_of(log):
    key = F.coalesce(*[F.when(F.col("table_name") == c.table, F.get_json_object(
        "after", f"$.{c.key_image}")) for c in CONTRACTS.values()])
    return log.select("table_name", "op", "ts_ms", key.cast("bigint").alias("id"))


def into_log(t, lake, **more):
    """Config of a log of all six tables, published; not ingested yet."""
    topics = f"{lake.folder}/topics"
    publish(topics, *[topic_records(df, name, F.lit(1000), at % 2 == 1)
                      for at, (name, df, _) in enumerate(all_six(t))])
    return lake.config(source_format="parquet", brokers=topics, fan=3,
                       checkpoint=f"{lake.folder}/checkpoint", **more)


@query("x2_compacted_log", _six("'c' AS op, CAST(1000 AS BIGINT) AS ts_ms, {key} AS id"))
def compacted_log(t):
    """All six tables through the stream in many batches, merged while they come."""
    lake = Lake(t.spark)
    files = sum(1 for n in Folder(t.spark, into_log(t, lake).brokers).names("")
                if n.endswith(".parquet"))
    cfg = lake.config(source_format="parquet", brokers=f"{lake.folder}/topics", fan=3,
                      checkpoint=f"{lake.folder}/checkpoint",
                      max_per_trigger=str(-(-files // 9)))
    run_ingest(t.spark, cfg, once=True)
    return _keys_of(bronze_log(t.spark, cfg).read())


@query("x5_pinned_reads", _six("{key} AS id, 1 AS then, CASE WHEN {key} % 5 = 0 THEN 2 ELSE 1 "
                               "END AS now"))
def pinned_reads(t):
    """Change events per key of all six tables, at a version that was pinned and counted while
    a stream of further changes ran and the log was merged, and after that stream."""
    lake = Lake(t.spark)
    cfg = into_log(t, lake)
    run_ingest(t.spark, cfg, once=True)
    log = bronze_log(t.spark, cfg)
    pinned = log.commit()["version"]
    publish(cfg.brokers, *[topic_records(df.where(F.col(key) % 5 == 0), name, F.lit(2000), op="u")
                           for name, df, key in all_six(t)])
    stream = start_ingest(t.spark, replace(cfg, max_per_trigger="4"), once=True)
    keys = ["table_name", "id"]
    then = materialised(_keys_of(log.read(pinned)).groupBy(*keys).agg(F.count("*").alias("then")))
    stream.awaitTermination()
    now = _keys_of(log.read()).groupBy(*keys).agg(F.count("*").alias("now"))
    return now.join(then, keys, "full").select(*keys, F.col("then").cast("int").alias("then"),
                                               F.col("now").cast("int").alias("now"))


def _kept(table, key, source):
    return (f"SELECT '{table}' AS name, count(*) AS rows, CAST(sum({key}) AS BIGINT) AS keys "
            f"FROM {source} WHERE {key} % 7 <> 0")


@query("x6_refresh_with_deletes", " UNION ALL ".join([
    _kept("customers", "customer_id", "s_customers"),
    _kept("products", "product_id", "s_products"), _kept("orders", "order_id", "s_orders"),
    _kept("order_items", "item_id", "s_items"), _kept("payments", "order_id", "s_payments"),
    _kept("events", "event_id", "events"),
    "SELECT 'returned', count(*), CAST(sum(order_id) AS BIGINT) FROM s_orders "
    "WHERE order_id % 7 <> 0 AND order_id % 5 = 0"]))
def refreshed_from_stream(t):
    """All six tables through the stream, with updates and deletes in both forms of the
    envelope, then a whole refresh that applies the deletes."""
    lake = Lake(t.spark)
    topics = f"{lake.folder}/topics"
    shop = {"customers": t.customers(), "products": t.products(), "orders": t.orders(),
            "order_items": t.items(), "payments": t.payments(), "events": t.events()}
    records = []
    for at, (name, df) in enumerate(shop.items()):
        key, wrapped = F.col(CONTRACTS[name].key), at % 2 == 1
        changed = df.where(key % 5 == 0)
        if name == "orders":
            changed = changed.withColumn("status", F.lit("returned"))
        records += [topic_records(df, name, F.lit(1000), wrapped),
                    topic_records(changed, name, F.lit(2000), not wrapped, "u"),
                    topic_records(df.where(key % 7 == 0), name, F.lit(3000), wrapped, "d")]
    publish(topics, *records)
    cfg = lake.config(source_format="parquet", brokers=topics, deletes=APPLY,
                      checkpoint=f"{lake.folder}/checkpoint")
    run_ingest(t.spark, cfg, once=True)
    run_pipeline(t.spark, cfg)
    made = {c.table: t.spark.table(f"{cfg.silver}.{c.table}") for c in SILVER}
    made["events"] = silver_events(t.spark.table(cfg.bronze), APPLY)

    def totals(name, df, key):
        return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"),
                      F.sum(key).alias("keys"))

    parts = [totals(name, df, CONTRACTS[name].key) for name, df in made.items()]
    parts.append(totals("returned", made["orders"].where("status = 'returned'"), "order_id"))
    return reduce(DataFrame.unionByName, parts)


def _full_report():
    return REPORT.replace("g_daily_revenue", "r_daily").replace(
        "g_top_products", "r_products").replace("g_customer_ltv", "r_ltv")


_AMOUNT = "CAST(round(sum(quantity * CAST(i.unit_price AS DECIMAL(18,4))), 2) AS DOUBLE)"


@query("r1_full_refresh", _full_report(),
       r_daily="""
    SELECT DISTINCT CAST(order_ts AS DATE) AS order_date, channel
    FROM s_orders o JOIN s_silver_items i ON o.order_id = i.order_id
    WHERE status <> 'cancelled'""",
       r_products=f"""
    SELECT p.product_id, name, {_AMOUNT} AS revenue
    FROM s_silver_items i JOIN s_products p ON i.product_id = p.product_id GROUP BY ALL""",
       r_ltv="SELECT customer_id FROM s_customers")
def full_refresh(t):
    """Bronze, silver and gold as tables, the gate, lineage and the report."""
    lake = Lake(t.spark)
    cfg = lake.config()
    cfg.namespace(t.spark, cfg.bronze.split(".")[0])
    t.bronze().write.partitionBy("table_name").saveAsTable(cfg.bronze)
    return run_pipeline(t.spark, cfg)


@query("r1_refresh_with_bad_rows", """
    SELECT 'orders' AS table_name, count(*) FILTER (order_id % 11 <> 0) AS rows,
           count(*) FILTER (order_id % 11 = 0) AS aside,
           CAST(sum(order_id) FILTER (order_id % 11 <> 0) AS BIGINT) AS keys FROM s_orders
    UNION ALL SELECT 'customers', count(*) FILTER (customer_id % 13 <> 0),
           count(*) FILTER (customer_id % 13 = 0),
           CAST(sum(customer_id) FILTER (customer_id % 13 <> 0) AS BIGINT) FROM s_customers
    UNION ALL SELECT 'products', count(*), 0, CAST(sum(product_id) AS BIGINT) FROM s_products
    UNION ALL SELECT 'order_items', count(*), 0, CAST(sum(item_id) AS BIGINT) FROM s_silver_items
    UNION ALL SELECT 'payments', count(*), 0, CAST(sum(order_id) AS BIGINT) FROM s_payments""")
def refresh_with_bad_rows(t):
    """A whole refresh where some orders have a time that is none, and the images of some
    customers have lost their key."""
    lake = Lake(t.spark)
    cfg = lake.config(aside=lake.namespace("aside"))
    cfg.namespace(t.spark, cfg.bronze.split(".")[0])

    def whole(table, key, divisor):
        number = F.get_json_object("after", f"$.{key}").cast("bigint")
        return (F.col("table_name") == table) & (number % divisor == 0)

    spoilt = (F.when(whole("orders", "order_id", 11),
                     F.regexp_replace("after", r'"order_ts":"[^"]*"', '"order_ts":"soon"'))
              .when(whole("customers", "customer_id", 13),
                    F.replace("after", F.lit('"customer_id"'), F.lit('"id"')))
              .otherwise(F.col("after")))
    t.bronze().withColumn("after", spoilt).write.partitionBy("table_name").saveAsTable(cfg.bronze)
    run_pipeline(t.spark, cfg)
    parts = []
    for c in SILVER:
        good, bad = (t.spark.table(f"{space}.{c.table}") for space in (cfg.silver, cfg.aside))
        parts.append(good.agg(F.lit(c.table).alias("table_name"), F.count("*").alias("rows"),
                              F.sum(c.key).alias("keys")).select(
            "*", bad.agg(F.count("*")).scalar().alias("aside")))
    return reduce(DataFrame.unionByName, parts).select("table_name", "rows", "aside", "keys")


@query("r2_top_customers_job", """
    SELECT count(*) AS rows, max(c_acctbal) AS best FROM customer WHERE c_acctbal > 5000""")
def etl_job(t):
    cfg = Lake(t.spark).config()
    count, best = run_etl(t.spark, cfg, t.read("customer"))
    return t.spark.table(f"{cfg.etl}.top_customers").agg(
        F.count("*").alias("rows"), F.max("acctbal").alias("best"))
