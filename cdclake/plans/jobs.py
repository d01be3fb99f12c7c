"""Jobs: ingest, full refresh of silver and gold behind a quality gate, and a small ETL."""

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from cdclake.contracts import BRONZE_DDL, SILVER
from cdclake.functions.money import PLACES
from cdclake.operators import quality as Q
from cdclake.operators.changes import TOPIC_PREFIX, decode_envelope
from cdclake.operators.lineage import emit_lineage
from cdclake.operators.state import APPLY, IGNORE
from cdclake.plans import dashboards, gold
from cdclake.plans.incremental import LiveMarts
from cdclake.plans.silver import ASIDE, build_silver, checked_silver
from cdclake.session import prepare, settings, shared_dir
from cdclake.sinks.state_table import Folder
from cdclake.sinks.tables import append, ensure_namespace, recreate_table, replace_table
from cdclake.sources.files import inline_rows
from cdclake.streaming.change_log import ChangeLog, follow
from cdclake.streaming.ingest import TRIGGER, ensure_bronze, ingest, read_change_stream

GOLD_INPUTS = {
    "daily_revenue": ["orders", "order_items"],
    "top_products": ["order_items", "products"],
    "customer_ltv": ["customers", "orders", "order_items"],
}


@dataclass(frozen=True)
class LakeConfig:
    """Where the layers live. Namespaces get folders below `warehouse`, if given."""
    warehouse: str = ""
    bronze: str = "bronze.cdc_events"
    silver: str = "silver"
    gold: str = "gold"
    staging: str = "staging"
    etl: str = "etl"
    demo: str = "demo"
    lineage: str = "lineage.events"
    fmt: str = "parquet"
    deletes: str = IGNORE
    brokers: str = ""
    source_format: str = "kafka"
    topic_prefix: str = TOPIC_PREFIX
    sequence: str = ""          # column of the records that settles equal times
    max_per_trigger: str = ""   # records or files per batch
    trigger: str = TRIGGER      # longer ones give bronze fewer and larger files
    checkpoint: str = ""        # by default in the shared folder
    sink_options: tuple = ()    # (name, value) pairs for the stream's writer
    shuffle_partitions: int = 0  # width of a refresh's shuffles; 0 for the session's
    digits: int = PLACES        # decimal places of a price that the marts keep
    buckets: int = 64           # of every table that is kept up to date by change
    aside: str = ""             # namespace for rows that do not fit; without it they fail a refresh
    fan: int = 0                # bronze as a log of which `fan` batches at a time are merged

    def namespace(self, spark, name):
        ensure_namespace(spark, name, f"{self.warehouse}/{name}" if self.warehouse else None)
        return name


def bronze_log(spark, cfg):
    """Bronze as a log that is compacted while it grows, for a config with `fan`."""
    ddl = f"{BRONZE_DDL}, seq BIGINT" if cfg.sequence else BRONZE_DDL
    root = f"{cfg.warehouse or shared_dir(spark)}/logs/{cfg.bronze}"
    return ChangeLog(spark, root, ddl, fan=int(cfg.fan))


def bronze_rows(spark, cfg):
    """The bronze rows: of a log, those of its newest version, whatever is appended later."""
    return bronze_log(spark, cfg).read() if int(cfg.fan) else spark.table(cfg.bronze)


def replace_all(tables, fmt):
    """Replace independent tables at the same time, so that the tail of one does not idle
    the cluster; the first failure is raised."""
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(lambda name: replace_table(tables[name], name, fmt), tables))


def build_silver_layer(spark, cfg):
    """Replace every silver table from the bronze log. With `aside`, rows that do not fit go to
    a table of that namespace; returns {table: (rows, rows set aside)} then."""
    cfg.namespace(spark, cfg.silver)
    bronze = bronze_rows(spark, cfg)
    if cfg.aside:
        return build_checked_silver(spark, cfg, bronze)
    replace_all({f"{cfg.silver}.{c.table}": build_silver(bronze, c, cfg.deletes) for c in SILVER},
                cfg.fmt)


def build_checked_silver(spark, cfg, bronze):
    """One read of the log per table, counted as it is written to a staging table, and from
    there the good rows to silver and the others to the tables of `aside`."""
    cfg.namespace(spark, cfg.aside)
    staging = cfg.namespace(spark, cfg.staging)
    seen = {c.table: Observation() for c in SILVER}
    replace_all({f"{staging}.{c.table}_checked": checked_silver(bronze, c, cfg.deletes).observe(
        seen[c.table], F.count_if(F.col(ASIDE).isNull()).alias("good"),
        F.count(ASIDE).alias("bad")) for c in SILVER}, cfg.fmt)
    checked = {c.table: spark.table(f"{staging}.{c.table}_checked") for c in SILVER}
    bad = F.col(ASIDE).isNotNull()
    replace_all({f"{cfg.silver}.{n}": df.where(~bad).drop(ASIDE) for n, df in checked.items()}
                | {f"{cfg.aside}.{n}": df.where(bad).select(f"{ASIDE}.*")
                   for n, df in checked.items()}, cfg.fmt)
    return {name: (o.get["good"], o.get["bad"]) for name, o in seen.items()}


def build_gold_layer(spark, cfg):
    """Replace every mart from silver. Order totals, which two marts need, are made once and
    kept in a staging table until the next refresh replaces them."""
    cfg.namespace(spark, cfg.gold)
    staged = f"{cfg.namespace(spark, cfg.staging)}.order_totals"
    silver = {c.table: spark.table(f"{cfg.silver}.{c.table}") for c in SILVER}
    orders, items = silver["orders"], silver["order_items"]
    digits = int(cfg.digits)
    replace_table(gold.order_totals(items, digits), staged, cfg.fmt)
    totals = spark.table(staged)
    marts = {
        "daily_revenue": gold.daily_revenue(orders, totals, digits),
        "top_products": gold.gold_top_products(items, silver["products"], digits),
        "customer_ltv": gold.customer_ltv(silver["customers"], orders, totals, digits),
    }
    replace_all({f"{cfg.gold}.{name}": mart for name, mart in marts.items()}, cfg.fmt)


def gold_checks(daily, products, ltv, customers):
    """Results of all checks of the gold layer."""
    return (
        Q.run_suite(daily, [
            Q.row_count_between(1, name="daily_revenue: row count"),
            Q.no_rows_where(F.col("revenue") < 0, "daily_revenue: revenue < 0")])
        .unionByName(Q.run_suite(products, [
            Q.not_null("product_id", "top_products: product_id is not null")]))
        .unionByName(Q.same_count(ltv, customers, "customer_ltv: as many rows as customers")))


def lineage_of(cfg):
    """(job, inputs, outputs) of a full refresh; every mart names the tables it reads."""
    runs = [("silver_transform", [cfg.bronze], [f"{cfg.silver}.{c.table}" for c in SILVER])]
    return runs + [(f"gold_{mart}", [f"{cfg.silver}.{t}" for t in inputs], [f"{cfg.gold}.{mart}"])
                   for mart, inputs in GOLD_INPUTS.items()]


def run_pipeline(spark, cfg):
    """Silver, gold, quality gate, report. A failed gate raises and there is no report."""
    prepare(spark)
    width = cfg.shuffle_partitions
    with settings(spark, {"spark.sql.shuffle.partitions": str(width)} if width else {}):
        build_silver_layer(spark, cfg)
        build_gold_layer(spark, cfg)
    cfg.namespace(spark, cfg.lineage.rsplit(".", 1)[0])
    emit_lineage(spark, cfg.lineage, lineage_of(cfg), cfg.fmt)
    marts = {name: spark.table(f"{cfg.gold}.{name}") for name in GOLD_INPUTS}
    Q.gate(gold_checks(*marts.values(), spark.table(f"{cfg.silver}.customers")))
    return dashboards.mart_report(marts, marts["top_products"])


def run_etl(spark, cfg, customer):
    """Build the top-customers table, verify it has rows and check its values."""
    prepare(spark)
    cfg.namespace(spark, cfg.etl)
    table = f"{cfg.etl}.top_customers"
    replace_table(gold.etl_top_customers(customer), table, cfg.fmt)
    built = spark.table(table)
    count, best = Q.verify_non_empty(built, "acctbal")
    Q.gate(Q.run_suite(built, top_customer_checks()))
    return count, best


def top_customer_checks():
    bound = gold.TOP_CUSTOMER_BALANCE
    return [
        Q.row_count_between(1),
        Q.not_null("custkey"),
        Q.not_null("name"),
        Q.values_between("acctbal", minimum=bound),
        Q.metric_threshold(F.count("*"), ">", 0, "row_count > 0"),
        Q.metric_threshold(Q.missing_count("custkey"), "=", 0, "missing_count(custkey) = 0"),
        Q.metric_threshold(F.min("acctbal"), ">", bound, f"min(acctbal) > {bound}"),
    ]


def run_ingest(spark, cfg, once=False):
    """Change events into bronze, until stopped; with `once`, what is there now."""
    prepare(spark)
    query = start_ingest(spark, cfg, once)
    query.awaitTermination()
    return query


def start_ingest(spark, cfg, once=False):
    """The running stream of change events into the bronze table, or into the log."""
    raw = read_change_stream(spark, cfg.brokers, cfg.source_format, cfg.topic_prefix,
                             cfg.max_per_trigger)
    checkpoint = cfg.checkpoint or f"{shared_dir(spark)}/streams/{cfg.bronze}"
    if int(cfg.fan):
        rows = decode_envelope(raw, cfg.topic_prefix, cfg.deletes == APPLY, cfg.sequence)
        return follow(rows, bronze_log(spark, cfg), checkpoint, cfg.trigger, once)
    location = f"{cfg.warehouse}/{cfg.bronze.replace('.', '/')}" if cfg.warehouse else None
    cfg.namespace(spark, cfg.bronze.rsplit(".", 1)[0])
    ensure_bronze(spark, cfg.bronze, cfg.fmt, location, cfg.sequence)
    return ingest(raw, cfg.bronze, checkpoint, cfg.topic_prefix, cfg.sequence,
                  cfg.deletes == APPLY, trigger=cfg.trigger, once=once, fmt=cfg.fmt,
                  **dict(cfg.sink_options))


def live_marts(spark, cfg):
    """The tables kept up to date by change, in a folder of the warehouse or the shared one."""
    return LiveMarts(spark, f"{cfg.warehouse or shared_dir(spark)}/live", cfg.deletes,
                     int(cfg.digits), int(cfg.buckets))


def run_maintain(spark, cfg, once=False):
    """Silver state and marts kept up to date from the bronze table as it grows, each batch
    rewriting only what it touches; until stopped, or with `once` what is there now. From a
    log (`fan`) each run takes what came after the last one, so these run with `once`."""
    prepare(spark)
    marts = live_marts(spark, cfg)
    if int(cfg.fan):
        if not once:
            raise ValueError("a bronze log is followed run by run: use once")
        log = bronze_log(spark, cfg)
        until = log.commit()["version"]
        # Images that a run which failed had taken in for some tables are taken in again,
        # which changes nothing.
        since = min(marts.tables[c.table].commit().markers.get("log", 0)
                    for c in marts.contracts)
        marts.apply(log.changes(since, until), until, "log")
        return marts
    checkpoint = f"{cfg.checkpoint or shared_dir(spark) + '/streams/' + cfg.bronze}-live"
    folder = Folder(spark, checkpoint)

    def apply(rows, batch):
        # Batches are numbered per query, so a new checkpoint counts from 0 under a new id.
        stream = json.loads(folder.read("metadata"))["id"]
        marts.apply(rows, batch, f"stream {stream}")

    writer = (spark.readStream.table(cfg.bronze).writeStream.foreachBatch(apply)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(
        processingTime=cfg.trigger)
    query = writer.start()
    query.awaitTermination()
    return marts


# Fixed values of the demo table.
DEMO_DDL = "id BIGINT, name STRING, amount DOUBLE, ts TIMESTAMP"
DEMO_ROWS = [(1, "alpha", 100.0), (2, "bravo", 250.5), (3, "charlie", 75.25), (4, "delta", 500.0)]


def demo_events(spark, cfg):
    """Write four rows to a new table; returns their count, sum and sorted content."""
    cfg.namespace(spark, cfg.demo)
    table, now = f"{cfg.demo}.events", datetime.now()
    recreate_table(spark, table, DEMO_DDL, cfg.fmt)
    append(inline_rows(spark, [(*row, now) for row in DEMO_ROWS], DEMO_DDL), table)
    written = spark.table(table)
    totals = written.agg(F.count("*").alias("rows"), F.sum("amount").alias("amount")).head()
    return totals["rows"], totals["amount"], written.orderBy(F.col("id").asc_nulls_last())
