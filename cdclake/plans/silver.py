"""Silver: typed current-state tables, built from the bronze log by contract."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from cdclake import contracts as C
from cdclake.operators.state import APPLY, IGNORE, as_of, latest_by_key

_KEY = "_key"


def _key_text(contract):
    return F.get_json_object("after", f"$.{contract.key_image}")


def change_key(contract, deletes=IGNORE):
    """The key of a log row, as text. Where deletes are applied, one without a key fails the
    build: it would leave its row."""
    key = _key_text(contract)
    if deletes != APPLY:
        return key
    return F.when((F.col("op") == "d") & key.isNull(), F.raise_error(F.lit(
        f"a delete of {contract.table} has no key; ingest with deletes = apply")).cast(
            "string")).otherwise(key)


def newest_images(bronze, contract, deletes=IGNORE):
    """Newest row image per key, its fields as text.

    Only the key is read from every image; the other fields are parsed once, for the one
    image per key that is left. `seq`, where the log has it, is the source's own order.
    """
    order = [c for c in ("ts_ms", "seq", "ingest_ts") if c in bronze.columns]
    key = change_key(contract, deletes)
    log = bronze.where(F.col("table_name") == contract.table).select(
        key.alias(_KEY), "op", *order, "after")
    newest = latest_by_key(log, _KEY, order + ["after"], deletes)
    return newest.select(F.from_json("after", contract.text_schema).alias("row")).select("row.*")


def typed(image, contract):
    """A parsed image's fields in the contract's types; a value that does not fit fails."""
    return [image[f.image].cast(f.type).alias(f.name) for f in contract.fields]


def build_silver(bronze, contract, deletes=IGNORE):
    """Current state in the contract's types; a value that cannot be cast fails the build."""
    images = newest_images(bronze, contract, deletes)
    return images.select(F.struct("*").alias("row")).select(*typed(F.col("row"), contract))


def state_as_of(bronze, contract, ts_ms, deletes=IGNORE):
    """Time travel: the silver table as it was at `ts_ms`."""
    return build_silver(as_of(bronze, ts_ms), contract, deletes)


def split_silver(bronze, contract, deletes=IGNORE):
    """(good, bad): typed rows, and what cannot become one, in text.

    Bad are the current rows with a value that does not fit its type, and every image
    without a key, such as text that is no JSON; the column `image` has the latter.
    Each of the two reads the log; `checked_silver` gives both from one read.
    """
    keyless = F.col("after").isNotNull() & _key_text(contract).isNull()
    text = newest_images(bronze.where(~keyless), contract, deletes)
    typed = {f.name: F.col(f.image).try_cast(f.type) for f in contract.fields}
    misfit = reduce(or_, [F.col(f.image).isNotNull() & typed[f.name].isNull()
                          for f in contract.fields])
    unread = bronze.where((F.col("table_name") == contract.table) & keyless).select(
        F.col("after").alias("image"))
    return (text.where(~misfit).select(*[c.alias(n) for n, c in typed.items()]),
            text.where(misfit).unionByName(unread, allowMissingColumns=True))


ASIDE = "_aside"


def checked_silver(bronze, contract, deletes=IGNORE):
    """Good and bad rows from one read of the log: the contract's columns and `_aside`, which
    is NULL for a good row. Else it has the fields in text, or under `image` an image without
    a key; of equal ones among those there is one. Good rows are those of `split_silver`.

    A keyless image is a key of its own, so it neither hides a row nor meets all others."""
    order = [c for c in ("ts_ms", "seq", "ingest_ts") if c in bronze.columns]
    key = change_key(contract, deletes)
    keyless = F.when(key.isNull(), F.col("after"))
    log = bronze.where(F.col("table_name") == contract.table).select(
        key.alias(_KEY), keyless.alias("_image"), "op", *order, "after")
    newest = latest_by_key(log, [_KEY, "_image"], order + ["after"], deletes)
    text = newest.select(F.from_json("after", contract.text_schema).alias("row"), "_image")
    fit = {f.name: F.col("row")[f.image].try_cast(f.type) for f in contract.fields}
    misfit = reduce(or_, [F.col("row")[f.image].isNotNull() & fit[f.name].isNull()
                          for f in contract.fields])
    unread = F.col("_image").isNotNull()
    known = [F.when(~unread, F.col("row")[f.image]).alias(f.image) for f in contract.fields]
    aside = F.when(misfit | unread, F.struct(*known, F.col("_image").alias("image")))
    return text.select(*[c.alias(n) for n, c in fit.items()], aside.alias(ASIDE))


def silver_customers(bronze, deletes=IGNORE):
    return build_silver(bronze, C.CUSTOMERS, deletes)


def silver_products(bronze, deletes=IGNORE):
    return build_silver(bronze, C.PRODUCTS, deletes)


def silver_orders(bronze, deletes=IGNORE):
    return build_silver(bronze, C.ORDERS, deletes)


def silver_order_items(bronze, deletes=IGNORE):
    return build_silver(bronze, C.ORDER_ITEMS, deletes)


def silver_payments(bronze, deletes=IGNORE):
    return build_silver(bronze, C.PAYMENTS, deletes)


def silver_events(bronze, deletes=IGNORE):
    return build_silver(bronze, C.EVENTS, deletes)
