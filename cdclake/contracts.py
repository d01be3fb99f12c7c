"""Entity contracts: the columns, types and key of every captured table."""

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    source: str = ""  # field of the row image, where it differs from the column

    @property
    def image(self):
        return self.source or self.name


@dataclass(frozen=True)
class Contract:
    table: str
    key: str
    fields: tuple

    @property
    def columns(self):
        return [f.name for f in self.fields]

    @property
    def key_image(self):
        return next(f.image for f in self.fields if f.name == self.key)

    @property
    def schema(self):
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])

    @property
    def text_schema(self):
        """Row image with every field as text, so that casts can fail loudly later."""
        return T.StructType([T.StructField(f.image, T.StringType()) for f in self.fields])


def _contract(table, key, **fields):
    return Contract(table, key, tuple(Field(n, t) for n, t in fields.items()))


_LONG, _DOUBLE, _TEXT, _TIME = (
    T.LongType(), T.DoubleType(), T.StringType(), T.TimestampNTZType())

# Tables, columns and types of the captured source.
CUSTOMERS = _contract(
    "customers", "customer_id",
    customer_id=_LONG, name=_TEXT, email=_TEXT, country=_TEXT, segment=_TEXT,
    signup_date=_TIME)
PRODUCTS = _contract(
    "products", "product_id",
    product_id=_LONG, name=_TEXT, category=_TEXT, unit_price=_DOUBLE, unit_cost=_DOUBLE)
ORDERS = _contract(
    "orders", "order_id",
    order_id=_LONG, customer_id=_LONG, order_ts=_TIME, channel=_TEXT, status=_TEXT)
ORDER_ITEMS = _contract(
    "order_items", "item_id",
    item_id=_LONG, order_id=_LONG, product_id=_LONG, quantity=_LONG, unit_price=_DOUBLE)
PAYMENTS = _contract(
    "payments", "order_id",
    order_id=_LONG, method=_TEXT, amount=_DOUBLE, status=_TEXT, paid_ts=_TIME)
EVENTS = _contract(
    "events", "event_id",
    event_id=_LONG, customer_id=_LONG, event_type=_TEXT, event_ts=_TIME, payload=_TEXT)

CONTRACTS = {c.table: c for c in (CUSTOMERS, PRODUCTS, ORDERS, ORDER_ITEMS, PAYMENTS, EVENTS)}

# The events table is captured but has no place in the default silver layer.
SILVER = (CUSTOMERS, PRODUCTS, ORDERS, ORDER_ITEMS, PAYMENTS)

BRONZE_DDL = "table_name STRING, op STRING, ts_ms BIGINT, after STRING, ingest_ts TIMESTAMP"
