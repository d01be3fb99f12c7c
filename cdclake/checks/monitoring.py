"""Lineage graph and metric rollups."""

from pyspark.sql import functions as F

from cdclake.checks.registry import query
from cdclake.operators import lineage as G
from cdclake.operators import metrics as M

SERIES = ["user_id", "event_type"]
DAY = 86_400


def by_event(t):
    return t.read("events").select(
        *SERIES, F.col("ts").cast("timestamp").alias("ts"), "value")


@query("m1_counter_rate", """
    SELECT user_id, event_type, ts, value, round(sum(step) OVER (
             PARTITION BY user_id, event_type ORDER BY ts
             RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS increase,
           round(sum(step) OVER (
             PARTITION BY user_id, event_type ORDER BY ts
             RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) / 86400, 9) AS rate
    FROM steps""", steps="""
    SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value
                   ELSE value - prev END AS step
    FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS prev
          FROM s_samples)""")
def rate(t):
    """Event values read as counters: every drop is a reset."""
    rates = M.counter_rate(by_event(t), DAY, 2 * DAY, by=SERIES)
    return rates.select(*SERIES, F.col("ts").cast("timestamp_ntz").alias("ts"), "value",
                        F.round("increase", 6).alias("increase"), F.round("rate", 9).alias("rate"))


@query("m2_sum_by", """
    SELECT date_trunc('hour', ts) AS ts, event_type AS name, round(sum(value), 6) AS value
    FROM s_samples WHERE event_type <> '' GROUP BY 1, 2""")
def sum_by(t):
    hourly = t.samples().withColumn("ts", F.date_trunc("hour", "ts"))
    return M.sum_by(hourly, "name").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "name",
        F.round("value", 6).alias("value"))


@query("m3_series_count", """
    SELECT 'event_value' AS metric, count(DISTINCT (user_id, event_type)) AS series
    FROM s_samples WHERE event_type <> ''""")
def series_count(t):
    return M.series_count(t.samples(), "name")


@query("m4_last_not_null", """
    SELECT user_id, event_type, arg_max(value, ts) FILTER (value <= 50) AS value
    FROM s_samples GROUP BY 1, 2""")
def last_value(t):
    """Values above 50 count as missing."""
    known = by_event(t).withColumn("value", F.when(F.col("value") <= 50, F.col("value")))
    return M.last_not_null(known, SERIES)


@query("m5_timeseries", """
    SELECT user_id, event_type, time_bucket(INTERVAL 6 HOUR, ts) AS step,
           arg_max(value, ts) AS value
    FROM s_samples GROUP BY 1, 2, 3""")
def panel(t):
    steps = M.timeseries(by_event(t), "6 hours", SERIES)
    return steps.withColumn("step", F.col("step").cast("timestamp_ntz"))


@query("g2_lineage_edges", """
    SELECT job, version, 'input' AS role, unnest(ins) AS dataset FROM s_versions
    UNION ALL SELECT job, version, 'output', unnest(outs) FROM s_versions""")
def edges(t):
    return G.lineage_edges(t.lineage())


_GRAPH = """
    SELECT {to}, 1 FROM s_edges WHERE {at} = '{start}'
    UNION SELECT {to}, depth + 1 FROM graph JOIN s_edges ON {at} = dataset"""


def _walk(start, at, to):
    return {"graph(dataset, depth)": _GRAPH.format(start=start, at=at, to=to)}


@query("g3_upstream", "SELECT dataset, min(depth) AS depth FROM graph GROUP BY 1",
       **_walk("region.1", "output", "input"))
def upstream(t):
    return G.upstream(G.lineage_edges(t.lineage(), far=True), "region.1")


@query("g3_downstream", "SELECT dataset, min(depth) AS depth FROM graph GROUP BY 1",
       **_walk("supplier.3", "input", "output"))
def downstream(t):
    return G.downstream(G.lineage_edges(t.lineage(), far=True), "supplier.3")
