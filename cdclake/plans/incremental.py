"""Silver state and gold marts kept up to date batch by batch.

A batch of the log changes some keys of the captured tables. Their feeds of (before, after)
are taken back from and added to order totals and sums per product; orders that changed, in
themselves or in their total, give a fact each, whose feed moves the sums per day and per
customer; and only products and customers met on the way get a new mart row. Every step
rewrites the buckets it touches and remembers how far it has read the feeds before it, so a
batch that stopped anywhere is run again and counts once.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from cdclake import contracts as C
from cdclake.functions.money import PLACES, from_minor_units, minor_units
from cdclake.operators.state import IGNORE, live
from cdclake.plans.gold import billed
from cdclake.plans.silver import change_key, typed
from cdclake.session import shuffles_dropped
from cdclake.sinks.state_table import StateTable, dealing

ORDER = ("ts_ms", "seq", "ingest_ts", "after")
SUMS = {  # table: (key, its numbers); `rows` says whether the key is still there
    "order_totals": ("order_id BIGINT", ("rows", "amount", "amounts")),
    "product_sales": ("product_id BIGINT", ("rows", "units", "unit_rows", "amount", "priced",
                                            "amounts")),
    "daily_sums": ("order_date DATE, channel STRING", ("rows", "amount", "amounts")),
    "customer_spend": ("customer_id BIGINT", ("rows", "orders", "amount")),
}
FACTS = ("order_id BIGINT, customer_id BIGINT, order_date DATE, channel STRING, lines BIGINT, "
         "amount BIGINT, amounts BIGINT")
LTV = "customer_id BIGINT, segment STRING, country STRING, orders BIGINT, lifetime_value DOUBLE"
TOP = ("product_id BIGINT, name STRING, category STRING, units BIGINT, revenue DOUBLE, "
       "margin DOUBLE")
# What each mart needs of the tables made from the log, and in which order.
MARTS = {
    "daily_revenue": ["order_totals", "order_facts", "daily_sums"],
    "top_products": ["product_sales", "top_products"],
    "customer_ltv": ["order_totals", "order_facts", "customer_spend", "customer_ltv"],
}
SOURCES = {"order_totals": ["order_items"], "product_sales": ["order_items"],
           "order_facts": ["orders", "order_totals"], "daily_sums": ["order_facts"],
           "customer_spend": ["order_facts"], "customer_ltv": ["customers", "customer_spend"],
           "top_products": ["products", "product_sales"]}
STEPS = [["order_totals", "product_sales"], ["order_facts", "top_products"],
         ["daily_sums", "customer_spend"], ["customer_ltv"]]


def changes_of(bronze, contract, deletes=IGNORE):
    """The log rows of a table with their key in its type; see `newest_images` for deletes."""
    log = bronze.where(F.col("table_name") == contract.table)
    if deletes == IGNORE:
        log = log.where(F.col("op") != "d")
    seq = F.col("seq") if "seq" in bronze.columns else F.lit(None)
    kind = contract.schema[contract.key].dataType
    return log.select(change_key(contract, deletes).cast(kind).alias(contract.key), "op", "ts_ms",
                      seq.cast("bigint").alias("seq"), "ingest_ts", "after")


def state_of(spark, root, contract, buckets):
    """The newest image per key of one captured table, deletes included as rows."""
    kind = contract.schema[contract.key].dataType.simpleString()
    return StateTable(spark, f"{root}/{contract.table}",
                      f"{contract.key} {kind}, op STRING, ts_ms BIGINT, seq BIGINT, "
                      "ingest_ts TIMESTAMP, after STRING", contract.key, buckets)


def rows_of(images, contract):
    """Silver rows of a state's images."""
    row = F.from_json("after", contract.text_schema)
    return live(images).select(row.alias("row")).select(*typed(F.col("row"), contract))


def signed(feed, contract=None):
    """One row per side of each change, `sign` -1 for what was and 1 for what is; typed, where
    a contract says that the sides are images."""
    sides = [F.struct(F.lit(sign).cast("bigint").alias("sign"), F.col(side).alias("row"))
             for sign, side in ((-1, "before"), (1, "after"))]
    rows = feed.select(F.inline(F.array(*sides))).where(F.col("row").isNotNull())
    if contract is None:
        return rows.select("sign", "row.*")
    there = rows.where(F.col("row.op") != "d").select(
        "sign", F.from_json("row.after", contract.text_schema).alias("row"))
    return there.select("sign", *typed(F.col("row"), contract))


class LiveMarts:
    """The captured tables' state and the marts, below one folder; `marts` chooses some."""

    def __init__(self, spark, root, deletes=IGNORE, digits=PLACES, buckets=64, marts=tuple(MARTS),
                 tables=()):
        self.spark, self.deletes, self.digits = spark, deletes, int(digits)
        self.buckets = buckets
        made = {t for mart in marts for t in MARTS[mart]}
        self.steps = [[t for t in step if t in made] for step in STEPS]
        logs = {s for t in made for s in SOURCES[t] if s in C.CONTRACTS} | set(tables)
        self.contracts = [c for c in C.CONTRACTS.values() if c.table in logs]
        self.tables = {c.table: state_of(spark, root, c, buckets) for c in self.contracts}
        for name in made:
            if name in SUMS:
                key, numbers = SUMS[name]
                ddl = f"{key}, {', '.join(f'{n} BIGINT' for n in numbers)}"
                keys = [k.split()[0] for k in key.split(", ")]
            else:
                ddl, keys = {"order_facts": (FACTS, "order_id"), "customer_ltv": (LTV, "customer_id"),
                             "top_products": (TOP, "product_id")}[name]
            self.tables[name] = StateTable(spark, f"{root}/{name}", ddl, keys, buckets)

    def apply(self, bronze, batch, stream="batch"):
        """Take in a batch of log rows. The batches of a stream have growing numbers; one that
        has been taken in is not looked at again, and one that failed is taken in from where it
        stopped."""
        def log(contract):
            self.tables[contract.table].upsert(
                changes_of(bronze, contract, self.deletes), ORDER, {stream: batch})

        # Set here once, as what a table sets for its own writes is not for threads.
        with (shuffles_dropped(self.spark), dealing(self.spark, self.buckets),
              ThreadPoolExecutor(8) as pool):
            list(pool.map(log, self.contracts))
            for step in self.steps:
                list(pool.map(self._follow, step))

    def _follow(self, name):
        """Bring a table up to the feeds of its sources."""
        table = self.tables[name]
        seen = table.commit().markers
        reached = {s: self.tables[s].commit().version for s in SOURCES[name]}
        if all(seen.get(s, 0) >= v for s, v in reached.items()):
            return
        feeds = {s: self.tables[s].feed(seen.get(s, 0), v) for s, v in reached.items()}
        getattr(self, f"_{name}")(table, feeds, reached)

    def _order_totals(self, table, feeds, reached):
        sign = F.col("sign")
        line = sign * F.col("quantity") * F.col("price")
        table.add(self._priced(feeds["order_items"]).select(
            "order_id", sign.alias("rows"), line.alias("amount"),
            F.when(line.isNotNull(), sign).alias("amounts")), reached)

    def _product_sales(self, table, feeds, reached):
        sign, units = F.col("sign"), F.col("sign") * F.col("quantity")
        line = units * F.col("price")
        table.add(self._priced(feeds["order_items"]).select(
            "product_id", sign.alias("rows"), units.alias("units"),
            F.when(F.col("quantity").isNotNull(), sign).alias("unit_rows"), line.alias("amount"),
            F.when(F.col("price").isNotNull(), units).alias("priced"),
            F.when(line.isNotNull(), sign).alias("amounts")), reached)

    def _priced(self, feed):
        return signed(feed, C.ORDER_ITEMS).withColumn(
            "price", minor_units(F.col("unit_price"), self.digits))

    def _keys(self, table, feeds, key):
        """The keys that any of the feeds has changed, one row per change, and the buckets they
        fall into in every table that has this key."""
        found = [f.select(F.when(F.col("after").isNotNull(), F.col("after")[key])
                          .otherwise(F.col("before")[key]).alias(key)) for f in feeds.values()]
        every = found[0].unionByName(found[1])
        return every, table.touched(every)

    def _order_facts(self, table, feeds, reached):
        """Orders that count. One that does not, or has gone, has no fact."""
        keys, only = self._keys(table, feeds, "order_id")
        orders = billed(rows_of(self.tables["orders"].read(only=only), C.ORDERS)).select(
            "order_id", "customer_id", F.col("order_ts").cast("date").alias("order_date"),
            "channel")
        # A line without an order number has no order.
        totals = self.tables["order_totals"].read(only=only).where(
            F.col("order_id").isNotNull()).select(
                "order_id", F.col("rows").alias("lines"), "amount", "amounts")
        table.rebuild(
            keys, {"orders": orders, "totals": totals},
            {c: F.col(f"orders.{c}") for c in ("customer_id", "order_date", "channel")}
            | {c: F.coalesce(F.col(f"totals.{c}"), F.lit(0))
               for c in ("lines", "amount", "amounts")},
            reached, gone=F.col("orders").isNull(), only=only)

    def _daily_sums(self, table, feeds, reached):
        sign = F.col("sign")
        facts = signed(feeds["order_facts"]).where(F.col("lines") > 0)
        table.add(facts.select(
            "order_date", "channel", sign.alias("rows"), (sign * F.col("amount")).alias("amount"),
            F.when(F.col("amounts") > 0, sign).alias("amounts")), reached)

    def _customer_spend(self, table, feeds, reached):
        sign = F.col("sign")
        table.add(signed(feeds["order_facts"]).select(
            "customer_id", sign.alias("rows"),
            F.when(F.col("order_id").isNotNull(), sign).alias("orders"),
            (sign * F.col("amount")).alias("amount")), reached)

    def _customer_ltv(self, table, feeds, reached):
        keys, only = self._keys(table, feeds, "customer_id")
        there = rows_of(self.tables["customers"].read(only=only), C.CUSTOMERS).select(
            "customer_id", "segment", "country")
        # An order without a customer is nobody's.
        spend = self.tables["customer_spend"].read(only=only).where(
            F.col("customer_id").isNotNull()).select("customer_id", "orders", "amount")
        zero = {c: F.coalesce(F.col(f"spend.{c}"), F.lit(0)) for c in ("orders", "amount")}
        table.rebuild(
            keys, {"there": there, "spend": spend},
            {"segment": F.col("there.segment"), "country": F.col("there.country"),
             "orders": zero["orders"],
             "lifetime_value": from_minor_units(zero["amount"], digits=self.digits)},
            reached, gone=F.col("there").isNull(), only=only)

    def _top_products(self, table, feeds, reached):
        keys, only = self._keys(table, feeds, "product_id")
        there = rows_of(self.tables["products"].read(only=only), C.PRODUCTS).select(
            "product_id", "name", "category",
            minor_units(F.col("unit_cost"), self.digits).alias("cost"))
        sold = self.tables["product_sales"].read(only=only).where(F.col("product_id").isNotNull())
        amount = F.when(F.col("sold.amounts") > 0, F.col("sold.amount"))
        table.rebuild(
            keys, {"there": there, "sold": sold},
            {"name": F.col("there.name"), "category": F.col("there.category"),
             "units": F.when(F.col("sold.unit_rows") > 0, F.col("sold.units")),
             "revenue": from_minor_units(amount, digits=self.digits),
             "margin": from_minor_units(amount - F.col("there.cost") * F.col("sold.priced"),
                                        digits=self.digits)},
            reached, gone=F.col("there").isNull() | F.col("sold").isNull(), only=only)

    def silver(self, table):
        """The captured table as it is now."""
        return rows_of(self.tables[table].read(), C.CONTRACTS[table])

    def mart(self, name):
        """The mart as it is now: the rows of the full refresh over all batches."""
        if name != "daily_revenue":
            return self.tables[name].read()
        return self.tables["daily_sums"].read().select(
            "order_date", "channel", F.col("rows").alias("orders"), from_minor_units(
                F.when(F.col("amounts") > 0, F.col("amount")), digits=self.digits)
            .alias("revenue"))

    def vacuum(self, keep=2):
        """Drop old versions of all tables, and feeds that every follower has read."""
        for name, table in self.tables.items():
            followers = [self.tables[t].commit().markers.get(name, 0)
                         for step in self.steps for t in step if name in SOURCES[t]]
            table.vacuum(keep, min(followers) if followers else table.commit().version)
