"""Scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from cdclake.checks.registry import query
from cdclake.functions.draws import choice, uniform
from cdclake.functions.images import epoch_millis


@query("f1_json_scalar", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_scalar(t):
    image = F.from_json("props", "k STRING")
    return t.read("events").select("event_id", image["k"].cast("bigint").alias("k"))


@query("f2_json_text", """
    SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_text(t):
    return t.read("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f3_coalesce", """
    SELECT event_id, coalesce(json_extract_string(props, '$.missing'),
                              json_extract_string(props, '$.k')) AS k FROM events""")
def first_known(t):
    return t.read("events").select("event_id", F.coalesce(
        F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("k"))


@query("f4_regexp_extract", """
    SELECT c_custkey, regexp_extract(c_name, 'Customer#(.*)', 1) AS number FROM customer""")
def extracted(t):
    return t.read("customer").select(
        "c_custkey", F.regexp_extract("c_name", r"Customer#(.*)", 1).alias("number"))


@query("f5_typed_casts", """
    SELECT o_orderkey, o_totalprice, o_orderdate FROM orders""")
def typed_casts(t):
    """Numbers and times go to text and come back unchanged."""
    text = t.read("orders").select(*[F.col(c).cast("string").alias(c) for c in (
        "o_orderkey", "o_totalprice", "o_orderdate")])
    return text.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                       F.col("o_totalprice").cast("double").alias("o_totalprice"),
                       F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("f6_day_of", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def day_of(t):
    return t.read("events").select("event_id", F.col("ts").cast("date").alias("day"))


@query("f7_binary_and_long", """
    SELECT event_id, props, epoch_us(ts) // 1000 AS ts_ms FROM events""")
def binary_and_long(t):
    wire = t.read("events").select("event_id", F.col("props").cast("binary").alias("props"),
                                   epoch_millis(F.col("ts")).cast("string").alias("ts_ms"))
    return wire.select("event_id", F.col("props").cast("string").alias("props"),
                       F.col("ts_ms").cast("bigint").alias("ts_ms"))


@query("f8_current_timestamp", """
    SELECT count(*) AS rows, 1 AS instants, true AS after_all FROM events""")
def stamped(t):
    rows = t.read("events").select("ts", F.current_timestamp().alias("ingest_ts"))
    return rows.agg(F.count("*").alias("rows"),
                    F.countDistinct("ingest_ts").cast("int").alias("instants"),
                    F.bool_and(F.col("ingest_ts") > F.col("ts")).alias("after_all"))


@query("f9_round", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)), 0) AS DOUBLE) AS whole,
           CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.333, 2) AS DOUBLE) AS third
    FROM lineitem""")
def rounded(t):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    third = price * F.lit("0.333").cast("decimal(4,3)")
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(price, 0).cast("double").alias("whole"),
        F.round(third, 2).cast("double").alias("third"))


@query("f10_arithmetic", """
    SELECT item_id, quantity * 2 - 1 AS odd, CAST(quantity AS DOUBLE) / 4 AS quarter,
           quantity + product_id AS total FROM s_items""")
def arithmetic(t):
    q = F.col("quantity")
    return t.items().select("item_id", (q * 2 - 1).alias("odd"), (q / 4).alias("quarter"),
                            (q + F.col("product_id")).alias("total"))


@query("f11_array_element", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           (['web', 'mobile', 'store', 'web', 'mobile', 'store', 'web'])[l_linenumber] AS channel
    FROM lineitem""")
def array_element(t):
    names = F.array(*[F.lit(c) for c in ("web", "mobile", "store") * 2 + ("web",)])
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                     F.element_at(names, F.col("l_linenumber")).alias("channel"))


@query("f12_seeded_draws", """
    SELECT count(*) AS rows, true AS in_range, count(*) AS repeated, 3 AS choices,
           true AS even FROM events""")
def seeded_draws(t):
    """Draws lie in [0, 1), repeat for the same seed and id, and spread evenly."""
    def drawn(events):
        u = uniform(42, "check", "slot", F.col("event_id"))
        return events.select("event_id", u.alias("u"), choice(u, ["a", "b", "c"]).alias("pick"))

    events = t.read("events").select("event_id", "user_id")
    # The same ids, read in place and dealt out anew: one draw per id.
    rows = (drawn(events).unionByName(drawn(events.repartition("user_id"))).groupBy("event_id")
            .agg(F.min("u").alias("u"), F.max("u").alias("again"), F.min("pick").alias("pick")))
    return rows.agg(
        F.count("*").alias("rows"),
        F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_range"),
        F.count_if(F.col("again") == F.col("u")).alias("repeated"),
        F.countDistinct("pick").cast("int").alias("choices"),
        (F.abs(F.avg("u") - 0.5) < 0.05).alias("even"))


@query("f13_format_time", """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events""")
def format_time(t):
    return t.read("events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))


@query("f14_series", """
    SELECT user_id, n, count(*) AS rows FROM (
      SELECT user_id, unnest(generate_series(1, extract(day FROM ts)::INT)) AS n FROM events)
    GROUP BY 1, 2""")
def series(t):
    last = F.dayofmonth("ts").cast("bigint")
    numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("n")
    return t.read("events").select("user_id", numbers).groupBy("user_id", "n").agg(
        F.count("*").alias("rows"))


@query("f15_intervals", """
    SELECT event_id, ts - INTERVAL 3 DAY - to_seconds(user_id) AS before,
           ts + INTERVAL 45 MINUTE AS later FROM events""")
def intervals(t):
    back = F.make_dt_interval(days=F.lit(3), secs=F.col("user_id"))
    return t.read("events").select("event_id", (F.col("ts") - back).alias("before"),
                                   (F.col("ts") + F.expr("INTERVAL '45' MINUTE")).alias("later"))


@query("f16_build_json", """
    SELECT event_id, '{"session":"s' || user_id || '"'
           || CASE WHEN event_type = 'purchase' THEN ',"product_id":' || event_id ELSE '' END
           || '}' AS payload FROM events""")
def build_json(t):
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    product = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return t.read("events").select("event_id", F.to_json(F.struct(
        session.alias("session"), product.alias("product_id"))).alias("payload"))
