"""State, marts and time travel by change, over a log of creations, updates and deletes of the
shop that comes in three batches, in no order."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdclake.checks.lakehouse import Lake
from cdclake.checks.registry import query
from cdclake.checks.relational import CUT, cut_ms
from cdclake.checks.tables import CTES
from cdclake.contracts import CONTRACTS, ORDERS
from cdclake.operators import quality as Q
from cdclake.operators.changes import snapshot_to_changes
from cdclake.operators.state import APPLY
from cdclake.plans.incremental import LiveMarts
from cdclake.plans.partition_checks import PartitionChecks
from cdclake.plans.snapshots import StateIndex
from cdclake.session import CODEC, materialised, shuffles_dropped

BATCHES = 3
# Keys that 5 divides change one column, those that 7 divides are deleted.
CHANGES = {"customers": ("segment", "'moved'"), "products": ("unit_cost", "CAST(1.5 AS DOUBLE)"),
           "orders": ("status", "'cancelled'"), "order_items": ("quantity", "quantity + 1")}
NOW = {"customers": "s_customers", "products": "s_products", "orders": "s_orders",
       "order_items": "s_items"}


def _now(table):
    key, (column, value) = CONTRACTS[table].key, CHANGES[table]
    columns = ", ".join(
        f"CASE WHEN {key} % 5 = 0 THEN {value} ELSE {c} END AS {c}" if c == column else c
        for c in CONTRACTS[table].columns)
    return f"SELECT {columns} FROM {NOW[table]} WHERE {key} % 7 <> 0"


SHOP = {f"n_{name[2:]}": _now(table) for table, name in NOW.items()}


def mart_sql(name):
    return CTES[name].replace(" s_", " n_")


def change_log(t):
    shop = {"customers": t.customers(), "products": t.products(), "orders": t.orders(),
            "order_items": t.items()}
    logs = []
    for table, df in shop.items():
        key, (column, value) = F.col(CONTRACTS[table].key), CHANGES[table]

        def event(ts, op):
            return F.struct(F.lit(ts).cast("bigint").alias("_ts"), F.lit(op).alias("_op"))

        # Each row is made once and gives its creation, its update and its delete.
        rows = df.select("*", F.inline(F.array_compact(F.array(
            event(1000, "c"), F.when(key % 5 == 0, event(2000, "u")),
            F.when(key % 7 == 0, event(3000, "d"))))))
        moved = F.when(F.col("_op") == "u", F.expr(value)).otherwise(F.col(column))
        logs.append(snapshot_to_changes(rows.withColumn(column, moved), table, F.col("_ts"),
                                        F.col("_op"), CONTRACTS[table].columns))
    return reduce(DataFrame.unionByName, logs)


def kept_up(t, **chosen):
    """The batches taken in one after the other, the last one twice; versions that nobody reads
    any more go after each."""
    batch = F.pmod(F.xxhash64("table_name", "op", "after"), F.lit(BATCHES))
    with shuffles_dropped(t.spark):
        log = materialised(change_log(t).withColumn("batch", batch), compression=CODEC)
    live = LiveMarts(t.spark, f"{Lake(t.spark).folder}/live", APPLY, buckets=16, **chosen)
    for number in [*range(BATCHES), BATCHES - 1]:
        live.apply(log.where(F.col("batch") == number).drop("batch"), number)
        live.vacuum(keep=1)
    return live


@query("v2_state_by_batches", "SELECT * FROM n_items", **SHOP)
def state_by_batches(t):
    return kept_up(t, marts=(), tables=("order_items",)).silver("order_items")


@query("b6_daily_revenue_by_change", mart_sql("g_daily_revenue"), **SHOP)
def daily_by_change(t):
    return kept_up(t, marts=("daily_revenue",)).mart("daily_revenue")


@query("b7_top_products_by_change", mart_sql("g_top_products"), **SHOP)
def products_by_change(t):
    return kept_up(t, marts=("top_products",)).mart("top_products")


@query("b8_customer_ltv_by_change", mart_sql("g_customer_ltv"), **SHOP)
def ltv_by_change(t):
    return kept_up(t, marts=("customer_ltv",)).mart("customer_ltv")


@query("v1_silver_from_snapshots", f"""
    SELECT * FROM s_orders WHERE order_ts <= TIMESTAMP '{CUT}'""")
def from_snapshots(t):
    """Two states of orders, of a year and of a day before the time asked for."""
    log = materialised(t.bronze().where(F.col("table_name") == ORDERS.table))
    index = StateIndex(t.spark, f"{Lake(t.spark).folder}/states", ORDERS)
    cut = t.spark.range(1).select(cut_ms()).head()[0]
    for days in (365, 1):
        index.take(log, cut - days * 86_400_000)
    return index.state_as_of(log, cut)


# name: (SQL of the metric, SQL of its test)
EVENT_CHECKS = {
    "row count": ("count(*)", ">= 1"),
    "user_id is not null": ("count(*) FILTER (user_id IS NULL)", "= 0"),
    "value in range": ("count(*) FILTER (value < 0 OR value > 100)", "= 0"),
    "error events": ("count(*) FILTER (event_type = 'error')", "= 0"),
    "min(event_id) >= 0": ("min(event_id)", ">= 0"),
    "max(event_id) > 1": ("max(event_id)", "> 1"),
    "sum(event_id) > 0": ("sum(event_id)", "> 0"),
    "avg(event_id) > 1": ("sum(event_id) / count(event_id)", "> 1"),
}


@query("q7_suite_by_partition", " UNION ALL ".join(
    f"""SELECT '{name}' AS "check", CAST({seen} AS DOUBLE) AS observed, {seen} {test} AS passed
    FROM events""" for name, (seen, test) in EVENT_CHECKS.items()))
def suite_by_partition(t):
    """Checks of the events day by day: the first days' states, then those of the days after
    and of the last known day once more, and the merged results of all."""
    day = F.to_date("ts")
    events = t.read("events").withColumn("day", day)
    names = list(EVENT_CHECKS)
    suite = PartitionChecks(events, f"{Lake(t.spark).folder}/checks", [
        Q.row_count_between(1), Q.not_null("user_id"), Q.values_between("value", 0, 100),
        Q.no_rows_where(F.col("event_type") == "error", names[3]),
        Q.metric_threshold(Q.least("event_id"), ">=", 0, names[4]),
        Q.metric_threshold(Q.greatest("event_id"), ">", 1, names[5]),
        Q.metric_threshold(Q.summed("event_id"), ">", 0, names[6]),
        Q.metric_threshold(Q.average("event_id"), ">", 1, names[7])], "day")
    middle = events.agg(F.percentile_approx(F.unix_date("day"), 0.5)).head()[0]
    cut = F.date_from_unix_date(F.lit(middle))
    suite.take(events.where(F.col("day") <= cut), {"run": 1})
    suite.take(events.where((F.col("day") >= cut) | F.col("day").isNull()), {"run": 2})
    return suite.results()
