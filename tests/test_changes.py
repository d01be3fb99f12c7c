import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.functions.images import epoch_millis, row_image
from cdclake.operators.changes import (
    PART, decode_envelope, diff_by_digests, diff_to_changes, digests, snapshot_to_changes,
    unequal_parts, with_part)

UPDATE = '{"payload":{"op":"u","ts_ms":2,"before":null,"after":{"order_id":1,"status":"shipped"}}}'
RECORDS = [
    ("ecom.public.orders", '{"op":"r","ts_ms":1,"after":{"order_id":1,"status":"placed"}}'),
    ("ecom.public.orders", UPDATE),
    ("ecom.public.orders", UPDATE),
    ("ecom.public.orders", '{"op":"d","ts_ms":3,"before":{"order_id":1},"after":null}'),
    ("ecom.public.orders", None),
    ("other.x", '{"op":"c","ts_ms":1,"after":{"order_id":9}}'),
    ("ecom.public.orders", "no json"),
    ("ecom.public.orders", '{"op":"c","ts_ms":"soon","after":{"order_id":2}}'),
]


def raw(spark, records=RECORDS):
    return spark.createDataFrame(records, "topic STRING, value STRING")


def test_both_envelopes_tombstones_and_foreign_topics(spark):
    got = rows(decode_envelope(raw(spark)).drop("ingest_ts"))
    update = ("orders", "u", 2, '{"order_id":1,"status":"shipped"}')
    assert got == sorted([
        ("orders", "r", 1, '{"order_id":1,"status":"placed"}'), update, update,
        ("orders", "d", 3, None), ("orders", None, None, None), ("orders", None, None, None),
        ("orders", "c", None, '{"order_id":2}')], key=repr)


def test_same_as_one_path_lookup_per_field(spark):
    """One parse per record gives what six path lookups give."""
    odd = [("ecom.public.t", v) for v in (
        '{"op":"c","ts_ms":5,"after":{"p":1.50,"q":1e3,"big":12345678901234567890,"n":null,'
        '"s":"a\\"b\\u00e9\\n","o":{"x":[1,2.0]},"b":true}}',
        '{"payload":"oops","op":"c","ts_ms":"abc","after":{"id":2}}',
        '{"op":"c","ts_ms":1.0,"after":"text"}', '{"op":"c","ts_ms":3,"after":[1,2]}',
        '[{"op":"c"}]', '{"op":1,"after":{"p":0.00001,"z":-0.0}}', "", "{",
        '{"op":"c","payload":{"op":"d","after":{"id":9}},"after":null}')]
    df = raw(spark, RECORDS + odd)

    def path(name):
        return F.coalesce(F.get_json_object("value", f"$.{name}"),
                          F.get_json_object("value", f"$.payload.{name}"))
    wanted = df.select(
        F.regexp_extract("topic", r"ecom\.public\.(.*)", 1).alias("table_name"),
        path("op").alias("op"), path("ts_ms").try_cast("bigint").alias("ts_ms"),
        path("after").alias("after")).where(F.col("table_name") != "")
    assert rows(decode_envelope(df).drop("ingest_ts")) == rows(wanted)


def test_binary_values(spark):
    df = raw(spark).withColumn("value", F.col("value").cast("binary"))
    assert rows(decode_envelope(df).drop("ingest_ts")) == rows(
        decode_envelope(raw(spark)).drop("ingest_ts"))


def test_delete_image_on_request(spark):
    out = decode_envelope(raw(spark), keep_delete_image=True).where("op = 'd'")
    assert [r["after"] for r in out.collect()] == ['{"order_id":1}']


def test_row_image_keeps_nulls_and_microseconds(spark):
    ts = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    df = spark.createDataFrame([(1, None, ts)], "id BIGINT, name STRING, ts TIMESTAMP_NTZ")
    assert df.select(row_image(df).alias("j")).head()["j"] == (
        '{"id":1,"name":null,"ts":"2024-01-02 03:04:05.678901"}')


def test_snapshot_is_a_read_per_row(spark):
    df = spark.createDataFrame([(1, datetime.datetime(1970, 1, 2))], "id BIGINT, ts TIMESTAMP_NTZ")
    log = snapshot_to_changes(df, "t", epoch_millis(F.col("ts")))
    assert rows(log.drop("ingest_ts")) == [
        ("t", "r", 86_400_000, '{"id":1,"ts":"1970-01-02 00:00:00"}')]


def test_diff(spark):
    ddl = "id BIGINT, v STRING, w BIGINT"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 1), (4, None, None)], ddl)
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, None, None), (5, None, None)], ddl)
    changes = diff_to_changes(old, new, "id")
    assert rows(changes.select("id", "op")) == [(2, "u"), (3, "d"), (5, "c")]
    images = {r["id"]: (r["before"], r["after"]) for r in changes.collect()}
    assert images[2] == ('{"id":2,"v":"b","w":null}', '{"id":2,"v":"b","w":2}')
    assert images[3][1] is None and images[5][0] is None


def test_diff_of_a_snapshot_with_itself_is_empty(spark):
    df = spark.createDataFrame([(None, "a"), (1, None)], "id BIGINT, v STRING")
    assert diff_to_changes(df, df, "id").isEmpty()


def test_sequence_of_the_records(spark):
    df = raw(spark).withColumn("offset", F.monotonically_increasing_id())
    out = decode_envelope(df, sequence="offset")
    assert out.columns[-1] == "seq" and out.where("seq IS NULL").isEmpty()


PAIR = "id BIGINT, a STRING, b STRING, at DOUBLE, tags ARRAY<STRING>"


def snapshot(spark, *changed, n=400):
    kept = {i: (i, f"a{i}", None if i % 3 else "b", i / 7, ["x", None]) for i in range(n)}
    for row in changed:
        kept[row[0]] = row if len(row) > 1 else None
    return spark.createDataFrame([r for r in kept.values() if r], PAIR)


def test_only_parts_that_differ_are_joined(spark):
    old = snapshot(spark)
    assert unequal_parts(digests(old, "id"), digests(old.repartition(5), "id")) == []
    assert diff_by_digests(old, old.repartition(3), "id").isEmpty()
    one = snapshot(spark, (7, "other", None, 1.0, ["x", None]))
    assert len(unequal_parts(digests(old, "id", 64), digests(one, "id", 64))) == 1
    new = snapshot(spark, (7, "other", None, 1.0, ["x", None]), (9,), (11,),
                   (500, "new", "b", None, None), (12, "a12", None, 12 / 7, ["x", None]))
    wanted = rows(diff_to_changes(old, new, "id"))
    assert len(wanted) == 5
    assert rows(diff_by_digests(old, new, "id", 64)) == wanted
    assert rows(diff_by_digests(old, new, ["id"], 64, known=digests(old, "id", 64))) == wanted
    assert rows(diff_by_digests(old.limit(0), new, "id", 64)) == rows(
        diff_to_changes(old.limit(0), new, "id"))


@pytest.mark.parametrize("left, right", [
    ((1, None, "x", 0.0, None), (1, "x", None, 0.0, None)),
    ((1, "", "x", 0.0, None), (1, None, "x", 0.0, None)),
    ((1, "a", "b", None, ["x", None]), (1, "a", "b", None, [None, "x"])),
    ((1, "a", "b", None, []), (1, "a", "b", None, None)),
    ((1, "ab", "c", None, None), (1, "a", "bc", None, None))])
def test_rows_that_look_alike_have_other_digests(spark, left, right):
    one, other = (spark.createDataFrame([r], PAIR) for r in (left, right))
    assert rows(digests(one, "id")) != rows(digests(other, "id"))
    assert diff_by_digests(one, other, "id").count() == 1


def test_a_snapshot_stored_by_part_is_read_where_it_differs(spark, tmp_path):
    old, new = snapshot(spark), snapshot(spark, (7, "other", None, 1.0, None))
    for name, df in (("old", old), ("new", new)):
        with_part(df, "id", 16).write.partitionBy(PART).parquet(f"{tmp_path}/{name}")
    stored = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new")]
    got = diff_by_digests(*stored, "id", 16)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_part") == 2
    assert rows(got) == rows(diff_to_changes(old, new, "id"))
