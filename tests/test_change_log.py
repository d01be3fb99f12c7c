import json
import threading
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cdclake.operators.changes import decode_envelope
from cdclake.plans.jobs import (
    bronze_log, build_silver_layer, run_ingest, run_maintain, start_ingest)
from cdclake.plans.silver import silver_orders
from cdclake.streaming.change_log import ChangeLog

DDL = "table_name STRING, n BIGINT"


def batch(spark, number, size=3):
    """Rows of two tables, the same row in every batch among them."""
    return spark.createDataFrame([("hot", 0)] + [(f"t{i % 2}", number * 100 + i)
                                                 for i in range(size)], DDL)


def content(number, size=3):
    return [("hot", 0)] + [(f"t{i % 2}", number * 100 + i) for i in range(size)]


def files(log, version=None):
    return sum(n.endswith(".parquet") for u in log.commit(version)["units"]
               for t in log.folder.names(f"data/{u['name']}")
               for n in log.folder.names(f"data/{u['name']}/{t}"))


def test_few_files_and_every_version_reads_as_it_was(spark, tmp_path):
    log, wanted, at = ChangeLog(spark, str(tmp_path), DDL, fan=3, levels=3), [], {}
    for i in range(1, 28):
        version = log.append(batch(spark, i).coalesce(1), {"s": i})
        wanted = wanted + content(i)
        at[version] = wanted
        log.compact()
    assert [u["level"] for u in log.commit()["units"]] == [3] and files(log) <= 3
    for version in (1, 9, max(at)):
        assert rows(log.read(version)) == sorted(at.get(version, []) or at[
            max(v for v in at if v <= version)], key=repr)
    known = sorted(at)[10]
    assert rows(log.changes(known)) == sorted(
        [r for i in range(12, 28) for r in content(i)], key=repr)
    assert rows(log.changes(sorted(at)[3], known)) == sorted(
        [r for i in range(5, 12) for r in content(i)], key=repr)
    with pytest.raises(ValueError):
        log.read(10_000)


def test_a_batch_run_twice_counts_once_and_leftovers_are_no_rows(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), DDL, fan=2)
    assert rows(log.read()) == [] and log.compact() == 0
    first = log.append(batch(spark, 1), {"s": 0})
    assert log.append(batch(spark, 1), {"s": 0}) == first
    batch(spark, 9).write.partitionBy("table_name").parquet(f"{tmp_path}/data/_unit=batch-failed")
    log.append(batch(spark, 2).limit(0), {"s": 1})
    log.append(batch(spark, 3), {"s": 2})
    log.compact()
    assert rows(log.read()) == sorted(content(1) + content(3), key=repr)
    log.vacuum(keep=1)
    assert log.folder.names("data") == sorted(u["name"] for u in log.commit()["units"])
    assert rows(log.read()) == sorted(content(1) + content(3), key=repr)


def test_large_tables_fill_several_files(spark, tmp_path):
    """All rows are one row, so nothing in them tells the files apart."""
    log = ChangeLog(spark, str(tmp_path), DDL, fan=2, file_bytes=400)
    one = spark.range(4000).select(F.lit("hot").alias("table_name"), F.lit(7).alias("n"))
    for i in range(2):
        log.append(one.repartition(8))
    assert log.compact() == 1
    name = log.commit()["units"][0]["name"]
    assert len([n for n in log.folder.names(f"data/{name}/table_name=hot")
                if n.endswith(".parquet")]) > 1
    assert log.read().count() == 8000


def test_levels_that_fill_together_are_merged_in_one_write(spark, tmp_path):
    log, merges = ChangeLog(spark, str(tmp_path), DDL, fan=3, levels=3), []
    for i in range(1, 28):
        log.append(batch(spark, i).coalesce(1))
        merges.append(log.compact())
    assert max(merges) == 1 and sum(merges) == 9
    assert [u["level"] for u in log.commit()["units"]] == [3]
    assert rows(log.read()) == sorted([r for i in range(1, 28) for r in content(i)], key=repr)


def loads(spark, rows, files):
    """One large batch in so many files, whose rows do not compress."""
    return (spark.range(rows).select(F.lit("t0").alias("table_name"),
                                     F.xxhash64("id").alias("n")).repartition(files))


def test_a_large_load_is_not_written_again_for_each_level(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), DDL, fan=2, levels=4, file_bytes=40_000)
    log.append(batch(spark, 0).coalesce(1))
    first = log.append(loads(spark, 20_000, 4))
    large, wanted, at = log.commit()["units"][1]["name"], [], {}
    for i in range(1, 18):
        wanted = wanted + content(i)
        at[log.append(batch(spark, i).coalesce(1))] = wanted
        log.compact()
    units = log.commit()["units"]
    assert [u["level"] for u in units if u["name"] == large] == [4] and len(units) <= 5
    assert log.read(first).count() == 20_004 and log.read().count() == 20_004 + len(wanted)
    known = sorted(at)[8]
    assert rows(log.changes(first, known)) == sorted(at[known], key=repr)
    assert rows(log.changes(known)) == sorted(wanted[len(at[known]):], key=repr)
    assert rows(log.changes(first - 1, first)) == rows(loads(spark, 20_000, 1))


def test_a_large_load_in_small_files_is_merged_once(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), DDL, fan=2, levels=4, file_bytes=40_000)
    log.append(loads(spark, 20_000, 100))
    assert files(log) == 100
    log.append(batch(spark, 1).coalesce(1))
    assert log.compact() == 1 and files(log) <= 8
    merged = log.commit()["units"][0]["name"]
    for i in range(2, 10):
        log.append(batch(spark, i).coalesce(1))
        log.compact()
    assert log.commit()["units"][0]["name"] == merged
    assert log.read().count() == 20_000 + 9 * 4


def test_reads_and_merges_while_batches_come(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), DDL, fan=2, levels=4)
    stop, faults = threading.Event(), []

    def merge():
        while not stop.is_set():
            try:
                log.compact()
            except Exception as e:  # noqa: BLE001
                faults.append(e)

    thread = threading.Thread(target=merge)
    thread.start()
    try:
        for i in range(1, 17):
            log.append(batch(spark, i).coalesce(1))
            seen = log.read().groupBy("n").count().where("n > 0 AND count > 1").count()
            assert log.read().count() == 4 * i and seen == 0
    finally:
        stop.set()
        thread.join()
    assert not faults
    log.compact()
    assert len(log.commit()["units"]) <= 4
    assert rows(log.read()) == sorted([r for i in range(1, 17) for r in content(i)], key=repr)


def order(key, status, op="c", ts=1):
    image = json.dumps({"order_id": key, "status": status})
    return "ecom.public.orders", json.dumps({"op": op, "ts_ms": ts, "after": image})


def publish(spark, lake, *records):
    spark.createDataFrame(records, "topic STRING, value STRING").coalesce(1).write.mode(
        "append").json(lake.brokers)


def test_a_pinned_reader_during_a_live_stream(spark, lake):
    lake = replace(lake, fan=2, max_per_trigger="1", trigger="100 milliseconds")
    for i in range(4):
        publish(spark, lake, order(i, "placed"))
    log, query = bronze_log(spark, lake), None
    try:
        query = start_ingest(spark, lake)
        query.processAllAvailable()
        pinned = log.commit()["version"]
        before = rows(silver_orders(log.read(pinned)).select("order_id", "status"))
        for i in range(6):
            publish(spark, lake, order(i, "delivered", "u", 2))
            assert rows(silver_orders(log.read(pinned)).select("order_id", "status")) == before
        query.processAllAvailable()
        assert query.isActive
        after = rows(silver_orders(log.read()).select("order_id", "status"))
    finally:
        if query:
            query.stop()
    assert before == [(i, "placed") for i in range(4)]
    assert after == [(i, "delivered") for i in range(6)]
    assert len(log.commit()["units"]) <= 4
    assert rows(silver_orders(log.read(pinned)).select("order_id", "status")) == before


def test_jobs_over_a_log(spark, lake):
    lake = replace(lake, fan=2, max_per_trigger="1")
    records = [order(i % 5, f"s{i}", "u", i) for i in range(7)]
    for record in records:
        publish(spark, lake, record)
    run_ingest(spark, lake, once=True)
    run_ingest(spark, lake, once=True)
    raw = spark.createDataFrame(records, "topic STRING, value STRING")
    assert rows(bronze_log(spark, lake).read().drop("ingest_ts")) == rows(
        decode_envelope(raw).drop("ingest_ts"))
    build_silver_layer(spark, lake)
    wanted = [(0, "s5"), (1, "s6"), (2, "s2"), (3, "s3"), (4, "s4")]
    assert rows(spark.table(f"{lake.silver}.orders").select("order_id", "status")) == wanted
    with pytest.raises(ValueError):
        run_maintain(spark, lake)


def test_a_merge_shuffles_nothing(spark, tmp_path, monkeypatch):
    log, plans = ChangeLog(spark, str(tmp_path), DDL, fan=2), []
    for i in (1, 2):
        log.append(batch(spark, i, 40))
    kind = type(log.read())
    inner = kind.sortWithinPartitions

    def kept(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return inner(df, *by)

    monkeypatch.setattr(kind, "sortWithinPartitions", kept)
    assert log.compact() == 1 and len(plans) == 1 and "Exchange" not in plans[0]
    assert files(log) == 3
    assert rows(log.read()) == sorted(content(1, 40) + content(2, 40), key=repr)
