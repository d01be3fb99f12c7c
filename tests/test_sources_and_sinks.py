import datetime
import uuid

import pytest
from conftest import FOLDER, rows
from pyspark.sql import functions as F

from cdclake import session
from cdclake.contracts import CUSTOMERS, EVENTS
from cdclake.sinks import tables as K
from cdclake.sources import files, jdbc


@pytest.fixture
def space(spark, tmp_path):
    name = f"space_{uuid.uuid4().hex[:8]}"
    K.ensure_namespace(spark, name, str(tmp_path / name))
    K.ensure_namespace(spark, name)
    return name


def test_replace_swaps_between_two_folders(spark, space):
    name = f"{space}.t"
    seen = []
    for n in (3, 5, 7):
        K.replace_table(spark.range(n).withColumn("v", F.lit("x")), name)
        assert spark.table(name).count() == n
        seen.append(K._location(spark, name)[-1])
    assert seen == ["a", "b", "a"]


def test_replace_from_the_table_itself(spark, space):
    name = f"{space}.t"
    K.replace_table(spark.range(10), name)
    K.replace_table(spark.table(name).where("id >= 4"), name)
    K.replace_table(spark.table(name).where("id >= 8"), name)
    assert rows(spark.table(name)) == [(8,), (9,)]


def test_a_failed_replace_leaves_the_table(spark, space):
    name = f"{space}.t"
    K.replace_table(spark.range(3).select(F.col("id").cast("string").alias("v")), name)
    bad = spark.createDataFrame([("x",)], "v STRING").select(
        F.col("v").cast("bigint").cast("string").alias("v"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        K.replace_table(bad, name)
    assert rows(spark.table(name)) == [("0",), ("1",), ("2",)]


def test_replace_with_other_columns(spark, space):
    name = f"{space}.t"
    K.replace_table(spark.range(3), name)
    K.replace_table(spark.range(2).select(F.col("id").cast("string").alias("key")), name)
    assert rows(spark.table(name)) == [("0",), ("1",)]


def test_a_reader_of_the_old_rows_can_finish(spark, space):
    name = f"{space}.t"
    K.replace_table(spark.range(3), name)
    old = spark.table(name)
    K.replace_table(spark.range(100), name)
    assert old.count() == 3


def test_ctas_fails_on_an_existing_table(spark, space):
    K.ctas(spark.range(3), f"{space}.t")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        K.ctas(spark.range(4), f"{space}.t")
    assert files.read_table(spark, f"{space}.t").count() == 3


def test_append_matches_names_and_recreate_empties(spark, space):
    name = f"{space}.t"
    K.ensure_table(spark, name, "a BIGINT, b STRING")
    K.ensure_table(spark, name, "a BIGINT, b STRING")
    K.append(spark.createDataFrame([("x", 1)], "b STRING, a BIGINT"), name)
    K.insert_select(spark.createDataFrame([(2, "y")], "a BIGINT, b STRING"), name)
    assert rows(spark.table(name)) == [(1, "x"), (2, "y")]
    K.recreate_table(spark, name, "a BIGINT")
    assert spark.table(name).isEmpty()


def test_csv_round_trip_with_quotes_json_and_nulls(spark, tmp_path):
    ts = datetime.datetime(2024, 5, 1, 10, 20, 30)
    df = spark.createDataFrame([
        (1, 2, "search", ts, '{"session":"s1","query":"a, \\"b\\""}'),
        (2, None, None, None, 'say "hi", then \\ go')], EVENTS.schema)
    K.write_csv_table(df, f"{tmp_path}/e")
    assert rows(files.read_csv_table(spark, f"{tmp_path}/e", EVENTS)) == rows(df)
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_path}/e").collect())
    assert "2024-05-01 10:20:30" in text


def test_csv_with_a_bad_cell_or_header_fails(spark, tmp_path):
    head = ",".join(CUSTOMERS.columns)
    (tmp_path / "bad.csv").write_text(head + "\nx,n,e,c,s,2024-01-01 00:00:00\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        files.read_csv_table(spark, str(tmp_path / "bad.csv"), CUSTOMERS).collect()
    (tmp_path / "head.csv").write_text(head.replace("email", "mail") + "\n1,n,e,c,s,\n")
    with pytest.raises(Exception, match="header|FAILED_READ"):
        files.read_csv_table(spark, str(tmp_path / "head.csv"), CUSTOMERS).collect()


def test_inline_rows_and_benchmark_customer(spark):
    assert files.inline_rows(spark, [(1, "a")], "id BIGINT, name STRING").schema.simpleString() == (
        "struct<id:bigint,name:string>")
    assert "c_acctbal" in files.tpch_customer(spark, FOLDER).columns


class Recorder:
    """Stands for a reader or writer and keeps what it is told; no database is started."""

    def __init__(self):
        self.seen, self.saved = {}, None

    def __getattr__(self, name):
        def call(*args, **kwargs):
            if name in ("load", "save"):
                self.saved = name
            elif name == "option":
                self.seen[args[0]] = args[1]
            elif name == "options":
                self.seen.update(kwargs)
            else:
                self.seen[name] = args[0]
            return self
        return call


class Holder:
    def __init__(self, recorder):
        self.read = self.write = recorder


def test_jdbc_options():
    seen = Recorder()
    jdbc.read_jdbc_table(Holder(seen), "jdbc:x", "orders",
                         jdbc.Partitioning("order_id", 1, 1000, 8), {"user": "u"})
    assert seen.saved == "load" and seen.seen == {
        "format": "jdbc", "user": "u", "url": "jdbc:x", "dbtable": "orders",
        "partitionColumn": "order_id", "lowerBound": "1", "upperBound": "1000",
        "numPartitions": "8"}
    seen = Recorder()
    jdbc.truncate_load(Holder(seen), "jdbc:x", "orders")
    assert (seen.seen["mode"], seen.seen["truncate"], seen.saved) == ("overwrite", "true", "save")
    seen = Recorder()
    jdbc.insert_rows(Holder(seen), "jdbc:x", "orders")
    assert seen.seen["mode"] == "append" and "truncate" not in seen.seen


def test_settings_of_a_job_are_restored(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), session.settings(spark, {key: "3", "spark.x.y": "z"}):
        assert spark.conf.get(key) == "3"
        raise ValueError
    assert spark.conf.get(key) == before and spark.conf.get("spark.x.y", None) is None


def test_interim_tables_go_to_the_named_folder(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    made = session.materialised(spark.range(3))
    assert made.count() == 3 and session.shared_dir(spark) in made.inputFiles()[0]
