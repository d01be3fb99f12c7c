"""Table-level lineage: run events, their edges and the graph around a dataset."""

import logging
import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cdclake.session import shared_dir
from cdclake.sinks.state_table import Folder
from cdclake.sinks.tables import append, ensure_table

_DATASET = "STRUCT<namespace: STRING, name: STRING>"
EVENT_DDL = (f"eventType STRING, eventTime TIMESTAMP, run STRUCT<runId: STRING>, "
             f"job {_DATASET}, inputs ARRAY<{_DATASET}>, outputs ARRAY<{_DATASET}>")


def lineage_events(spark, job, inputs, outputs, job_namespace="cdclake", namespace="lake"):
    """START and COMPLETE event of one run of a job."""
    now, run = F.lit(datetime.now(timezone.utc)), str(uuid.uuid4())

    def dataset(space, name):
        return F.struct(F.lit(space).alias("namespace"), F.lit(name).alias("name"))

    def datasets(names):
        return F.array(*[dataset(namespace, name) for name in names])

    kinds = F.explode(F.array(F.lit("START"), F.lit("COMPLETE"))).alias("eventType")
    return spark.range(1).select(
        kinds, now.alias("eventTime"), F.struct(F.lit(run).alias("runId")).alias("run"),
        dataset(job_namespace, job).alias("job"),
        datasets(inputs).alias("inputs"), datasets(outputs).alias("outputs"))


def emit_lineage(spark, table, runs, fmt="parquet"):
    """Append the events of runs (job, inputs, outputs) to a table of this format.

    Best effort: a failure is logged and not raised.
    """
    try:
        ensure_table(spark, table, EVENT_DDL, fmt)
        append(reduce(DataFrame.unionByName, [lineage_events(spark, *run) for run in runs]), table)
        return True
    except Exception as error:  # lineage must never fail the job it describes
        logging.getLogger(__name__).warning("lineage not written to %s: %s", table, error)
        return False


def _names(side):
    name = lambda d: F.concat_ws(".", d["namespace"], d["name"])
    return F.array_sort(F.array_distinct(F.transform(side, name)))


def lineage_edges(events, far=False):
    """Completed runs -> edges (job, version, role, dataset), deduplicated.

    A role of `input` leads from the dataset into the job, `output` from the job to the
    dataset: an (input, job, output) path is a pair of edges with one version. That is
    one row per name listed, where pairing inputs with outputs would multiply them.
    A version is a job with one set of inputs and outputs; repeated runs are reduced to
    it before anything else, within each task first.

    `far` is for an `Adjacency`, which reduces what repeats as it stores it, so repeated runs
    are left. It adds `direct`, that a version has a single dataset on one side, and `far`,
    for such a version that dataset beside each of the other side: those are all its paths, no
    more than its names, so none has to lead through the version.
    """
    versions = events.where(F.col("eventType") == "COMPLETE").select(
        F.concat_ws(".", "job.namespace", "job.name").alias("job"),
        _names("inputs").alias("ins"), _names("outputs").alias("outs"))
    versions = versions if far else versions.distinct()

    def ends(side, role, other, alone):
        names = [F.lit(role).alias("role")]
        if far:
            names += [F.when(alone, F.get(other, F.lit(0))).alias("far"), direct.alias("direct")]
        return F.transform(side, lambda d: F.struct(*names, d.alias("dataset")))

    one_in, one_out = F.size("ins") == 1, F.size("outs") == 1
    direct = (one_in & (F.size("outs") > 0)) | (one_out & (F.size("ins") > 0))
    both = F.concat(ends("ins", "input", "outs", one_out),
                    ends("outs", "output", "ins", one_in & ~one_out))
    version = F.md5(F.to_json(F.struct("job", "ins", "outs")))
    return versions.select("job", (F.when(~direct, version) if far else version)
                           .alias("version"), F.inline(both))


ENTER, LEAVE, DIRECT = "enter", "leave", "direct"
# Which role leads into a job and which out of it, by direction.
ROLES = {"downstream": ("input", "output"), "upstream": ("output", "input")}


class Adjacency:
    """Edges stored by the end they are looked up by, in hash buckets, written once.

        root/<direction>/step=enter/_bucket=3   from a dataset to versions of jobs
        root/<direction>/step=leave/_bucket=5   from a version to datasets
        root/<direction>/step=direct/_bucket=3  from a dataset to datasets, where edges tell

    A step of a walk reads the buckets its frontier falls into and no others, and the frontier
    says which while it is written. A walk goes level by level; a level holds datasets not met
    before, so diamonds and cycles end.
    """

    def __init__(self, spark, root, buckets=8):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.folder = Folder(spark, self.root)

    def _bucket(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def write(self, edges, directions=tuple(ROLES)):
        """Store the edges for walks in some directions. What repeats is reduced within each
        task, then dealt by both ends, so that the edges of one crowded dataset are many tasks,
        and stored by the end it is looked up by."""
        direct = F.lit(False)
        if "far" in edges.columns:
            direct, edges = F.col("direct"), edges.where(~F.col("direct") | F.col("far").isNotNull())
            edges = edges.withColumn("other", F.when(direct, F.col("far")).otherwise(F.col("version")))
        else:
            edges = edges.withColumn("other", F.col("version"))
        for direction in directions:
            enters = F.col("role") == ROLES[direction][0]
            ends = [F.col("dataset"), F.col("other")]
            (edges.select(F.when(direct, DIRECT).when(enters, ENTER).otherwise(LEAVE).alias("step"),
                          F.when(enters, ends[0]).otherwise(ends[1]).alias("at"),
                          F.when(enters, ends[1]).otherwise(ends[0]).alias("to"))
             .distinct().withColumn("_bucket", self._bucket("at"))
             .sortWithinPartitions("step", "_bucket", "at")
             .write.mode("overwrite").partitionBy("step", "_bucket")
             .parquet(f"{self.root}/{direction}"))
        return self

    def _write(self, rows, folder):
        """Write a frontier; returns it and the buckets that it falls into."""
        seen = Observation()
        (rows.observe(seen, F.collect_set(self._bucket(rows.columns[0])).alias("buckets"))
         .write.parquet(f"{self.root}/{folder}"))
        return (self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}"),
                seen.get["buckets"])

    def _step(self, direction, step, level, only):
        """The other ends of the stored edges of a frontier, from its buckets alone."""
        folder = f"{direction}/step={step}"
        paths = [f"{self.root}/{folder}/{n}" for n in self.folder.names(folder)
                 if "=" in n and int(n.split("=")[1]) in only]
        if not paths:
            return None
        edges = self.spark.read.schema("at STRING, to STRING").parquet(*paths)
        if step != LEAVE:  # a level is written down, and files are sorted by this end
            least, most = (level.agg(f(level.columns[0])).scalar() for f in (F.min, F.max))
            edges = edges.where(F.col("at").between(least, most))
        return edges.join(level.toDF("at"), "at", "left_semi").select("to").distinct()

    def _through(self, direction, level, only, folder):
        """What is reached through versions of jobs; None if no edge can be."""
        versions = self._step(direction, ENTER, level, set(only))
        if versions is None:
            return None
        via, passed = versions, range(self.buckets)
        if len(only) * 2 < self.buckets:  # else its versions are about everywhere, too
            via, passed = self._write(versions, folder)
        return self._step(direction, LEAVE, via, set(passed))

    def walk(self, start, direction):
        """(dataset, depth) of all that is reached from `start`, by the least number of jobs."""
        run, first = f"walk-{uuid.uuid4().hex}", self.spark.createDataFrame(
            [(start,)], "dataset STRING")
        level, only = first, first.agg(F.collect_set(self._bucket("dataset"))).head()[0]
        levels = [first]
        while only:
            found = [self._step(direction, DIRECT, level, set(only)),
                     self._through(direction, level, only, f"{run}/versions-{len(levels)}")]
            found = [rows for rows in found if rows is not None]
            if not found:
                break
            found = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
            found = found.toDF("dataset").join(
                reduce(DataFrame.unionByName, levels), "dataset", "left_anti")
            level, only = self._write(found, f"{run}/level-{len(levels)}")
            levels.append(level)
        return reduce(DataFrame.unionByName, [
            df.withColumn("depth", F.lit(n)) for n, df in enumerate(levels)]).where("depth > 0")


def _stored(edges, direction):
    spark = edges.sparkSession
    root = f"{shared_dir(spark)}/adjacency-{uuid.uuid4().hex}"
    return Adjacency(spark, root).write(edges, [direction])


def upstream(edges, dataset):
    """All datasets that `dataset` is made from, with the least number of jobs between. Stores
    the edges for this direction first; keep an `Adjacency` to walk more than once."""
    return _stored(edges, "upstream").walk(dataset, "upstream")


def downstream(edges, dataset):
    """All datasets made from `dataset`; see `upstream`."""
    return _stored(edges, "downstream").walk(dataset, "downstream")
