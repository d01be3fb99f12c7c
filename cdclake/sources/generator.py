"""Synthetic shop: six tables that fit each other, the same for the same scale and seed.

Every value is a hash of seed, column and row id, so a row can be made anywhere without
looking at other rows: a line item works out its product's price, and a payment its
order's total, from the ids alone.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cdclake.functions.draws import choice, integer, uniform, weighted
from cdclake.functions.money import from_minor_units, minor_units

# Domains, weights and ranges of the shop.
COUNTRIES = ["US", "UK", "DE", "IN", "BR", "CA", "AU", "FR", "JP", "SG"]
SEGMENTS = ["consumer", "smb", "enterprise"]
CATEGORIES = ["Electronics", "Home", "Apparel", "Books", "Sports", "Beauty", "Toys", "Grocery"]
CHANNELS = ["web", "mobile", "store", "partner"]
NEW_ORDER_CHANNELS = ["web", "mobile", "store"]
ORDER_STATUS = ["placed", "shipped", "delivered", "cancelled", "returned"]
ORDER_STATUS_WEIGHTS = [10, 20, 50, 12, 8]
PAY_METHODS = ["card", "paypal", "bank_transfer", "wallet", "cod"]
PAY_STATUS = ["captured", "pending", "failed", "refunded"]
PAY_STATUS_WEIGHTS = [80, 8, 7, 5]
EVENT_TYPES = ["page_view", "search", "add_to_cart", "checkout", "purchase", "support_ticket"]
DEVICES = ["ios", "android", "desktop"]
SEARCHES = ["shoes", "phone", "laptop", "gift", "sale"]
NOW = "2024-06-01 00:00:00"
WINDOW_DAYS, SIGNUP_DAYS = 90, 365
COST_RANGE, MARKUP_RANGE = (2.0, 400.0), (1.15, 2.5)
MAX_LINES, MAX_QUANTITY, MAX_PAY_MINUTES, SESSIONS = 4, 5, 120, 50_000
ROWS = {"customers": 2000, "products": 500, "orders": 8000, "events": 10_000}

ID_CHUNK = 1_000_000


class _Shop:
    def __init__(self, spark, scale, seed):
        self.spark, self.seed = spark, seed
        self.rows = {table: int(n * scale) for table, n in ROWS.items()}

    def ids(self, table):
        return self.spark.range(1, self.rows[table] + 1)

    def draw(self, entity, slot, *ids):
        return uniform(self.seed, entity, slot, *(ids or (F.col("id"),)))

    def moment(self, entity, days):
        back = F.make_dt_interval(days=integer(self.draw(entity, "days"), 0, days).cast("int"),
                                  secs=integer(self.draw(entity, "secs"), 0, 86_399))
        return F.lit(NOW).cast("timestamp_ntz") - back

    def cost(self, product):
        low, high = COST_RANGE
        return F.round(low + self.draw("products", "cost", product) * (high - low), 2)

    def price(self, product):
        low, high = MARKUP_RANGE
        markup = low + self.draw("products", "markup", product) * (high - low)
        return F.round(self.cost(product) * markup, 2)

    def customers(self):
        key = F.col("id").cast("string")
        return self.ids("customers").select(
            F.col("id").alias("customer_id"),
            F.concat(F.lit("Customer "), key).alias("name"),
            F.concat(F.lit("user"), key, F.lit("@example.com")).alias("email"),
            choice(self.draw("customers", "country"), COUNTRIES).alias("country"),
            choice(self.draw("customers", "segment"), SEGMENTS).alias("segment"),
            self.moment("customers", SIGNUP_DAYS).alias("signup_date"))

    def products(self):
        product = F.col("id")
        return self.ids("products").select(
            product.alias("product_id"),
            F.concat(F.lit("Product "), product.cast("string")).alias("name"),
            choice(self.draw("products", "category"), CATEGORIES).alias("category"),
            self.price(product).alias("unit_price"), self.cost(product).alias("unit_cost"))

    def status(self):
        return weighted(self.draw("orders", "status"), ORDER_STATUS, ORDER_STATUS_WEIGHTS)

    def order_ts(self):
        return self.moment("orders", WINDOW_DAYS)

    def orders(self):
        return self.ids("orders").select(
            F.col("id").alias("order_id"),
            integer(self.draw("orders", "customer"), 1, self.rows["customers"])
            .alias("customer_id"),
            self.order_ts().alias("order_ts"),
            choice(self.draw("orders", "channel"), CHANNELS).alias("channel"),
            self.status().alias("status"))

    def lines(self):
        return integer(self.draw("orders", "lines"), 1, MAX_LINES)

    def product(self, order, slot):
        return integer(self.draw("items", "product", order, slot), 1, self.rows["products"])

    def quantity(self, order, slot):
        return integer(self.draw("items", "quantity", order, slot), 1, MAX_QUANTITY)

    def items(self):
        """Item ids run 1..n in order of the orders: a running count within chunks of
        orders, added to the number of items in the chunks before."""
        counted = self.ids("orders").select(
            "id", F.floor(F.col("id") / F.lit(ID_CHUNK)).alias("chunk"), self.lines().alias("n"))
        # One row per million orders, so this window's single task stays small.
        before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        chunks = counted.groupBy("chunk").agg(F.sum("n").alias("total")).select(
            "chunk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
        earlier = (Window.partitionBy("chunk").orderBy("id")
                   .rowsBetween(Window.unboundedPreceding, -1))
        slot = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("slot")
        placed = (counted.withColumn("running", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                  .join(chunks, "chunk")
                  .select("id", (F.col("base") + F.col("running")).alias("first"), slot)
                  .withColumn("product_id", self.product(F.col("id"), F.col("slot"))))
        return placed.select(
            (F.col("first") + F.col("slot")).alias("item_id"), F.col("id").alias("order_id"),
            "product_id", self.quantity(F.col("id"), F.col("slot")).alias("quantity"),
            self.price(F.col("product_id")).alias("unit_price"))

    def payments(self):
        order = F.col("id")
        total = F.lit(0).cast("bigint")
        for slot in range(1, MAX_LINES + 1):
            at = F.lit(slot).cast("bigint")
            line = self.quantity(order, at) * minor_units(self.price(self.product(order, at)))
            total = total + F.when(self.lines() >= slot, line).otherwise(F.lit(0))
        drawn = weighted(self.draw("payments", "status"), PAY_STATUS, PAY_STATUS_WEIGHTS)
        wait = integer(self.draw("payments", "wait"), 0, MAX_PAY_MINUTES).cast("int")
        return self.ids("orders").where(self.status() != "cancelled").select(
            order.alias("order_id"),
            choice(self.draw("payments", "method"), PAY_METHODS).alias("method"),
            from_minor_units(total).alias("amount"),
            F.when(self.status() == "returned", "refunded").otherwise(drawn).alias("status"),
            (self.order_ts() + F.make_dt_interval(mins=wait)).alias("paid_ts"))

    def events(self):
        kind = choice(self.draw("events", "type"), EVENT_TYPES)
        session = F.concat(F.lit("s"), integer(self.draw("events", "session"), 1, SESSIONS)
                           .cast("string"))
        payload = F.to_json(F.struct(
            session.alias("session"),
            choice(self.draw("events", "device"), DEVICES).alias("device"),
            F.when(kind == "search", choice(self.draw("events", "query"), SEARCHES))
            .alias("query"),
            F.when(kind.isin("add_to_cart", "purchase"),
                   integer(self.draw("events", "product"), 1, self.rows["products"]))
            .alias("product_id")))
        return self.ids("events").select(
            F.col("id").alias("event_id"),
            integer(self.draw("events", "customer"), 1, self.rows["customers"])
            .alias("customer_id"),
            kind.alias("event_type"),
            self.moment("events", WINDOW_DAYS).alias("event_ts"), payload.alias("payload"))


def generate_ecommerce(spark, scale=1.0, seed=42):
    """Tables by name; at scale 1 there are 2,000 customers and 8,000 orders."""
    shop = _Shop(spark, scale, seed)
    return {"customers": shop.customers(), "products": shop.products(),
            "orders": shop.orders(), "order_items": shop.items(),
            "payments": shop.payments(), "events": shop.events()}


def generate_orders_delta(spark, base, n=500, seed=42, customers=2000, at=None):
    """n new placed orders with ids after the largest in `base`; orders only, no items.

    Customers and channels are drawn by rounding, so the ends of each range come up half
    as often as the values between. `n` is a number or a one-row column.
    """
    def rounded_draw(slot, top):
        draw = uniform(seed, "new orders", slot, F.col("order_id"))
        return F.round(draw * F.lit(top)).cast("bigint")

    last = base.agg(F.coalesce(F.max("order_id"), F.lit(0))).scalar()
    channels = F.array(*[F.lit(c) for c in NEW_ORDER_CHANNELS])
    index = rounded_draw("channel", len(NEW_ORDER_CHANNELS) - 1) + 1
    now = F.lit(at).cast("timestamp_ntz") if at else F.date_trunc(
        "second", F.current_timestamp()).cast("timestamp_ntz")
    return spark.range(1, n + 1).select((last + F.col("id")).alias("order_id")).select(
        "order_id", (rounded_draw("customer", customers - 1) + 1).alias("customer_id"),
        now.alias("order_ts"), F.element_at(channels, index.cast("int")).alias("channel"),
        F.lit("placed").alias("status"))
