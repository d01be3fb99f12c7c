"""Keyed state in hash buckets, of which a batch rewrites only those it touches.

    root/commits/7.json            which version of each bucket is current, and markers
    root/rows/version=7/_bucket=3  the rows of a bucket as of a version, with what they were before
    root/feed/version=7            the buckets in which version 7 changed rows

A version is its commit file, written last: readers see the old rows or the new rows, a batch
that failed half-way leaves nothing they see, and a reader keeps the version it opened. Each
commit carries markers, such as the last batch of a stream, so that a batch run twice is
applied once. The feed lets tables made from this one follow it change by change. One writer
per table at a time.
"""

import json
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdclake.session import CODEC, settings

BUCKET = "_bucket"
# Beside the columns of a stored row: the row it replaced, and whether the version set it or
# took it away; NULL where the version left it as it was.
WAS, STEP = "_was", "_step"
SET, GONE = "set", "gone"
# The hash that deals keys to buckets is the one that shuffles deal rows by, so that with
# `dealing` a shuffled partition is part of one bucket. Tables of earlier code keep theirs.
HASHES = {"murmur3": F.hash, "xxhash64": F.xxhash64}
WIDTH, SPLIT = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
SPLIT_BYTES = 32 << 20


def dealing(spark, buckets):
    """While this lasts, shuffles have a multiple of the buckets as partitions, so that rows
    dealt by key lie bucket by bucket and a task writes few files; and a task reads no more of
    the files than it can sort in memory where it combines rows by key before the shuffle."""
    width = int(spark.conf.get(WIDTH))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return settings(spark, {WIDTH: str(max(buckets, width // buckets * buckets)),
                            SPLIT: str(min(split, SPLIT_BYTES))})


class Folder:
    """Names, small texts and removal below a path of any file system Spark reads."""

    def __init__(self, spark, path):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name):
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if (
            self.fs.exists(at)) else []

    def sizes(self, name):
        """{name: bytes} of what lies in a folder, whole trees summed."""
        at = self._at(name)
        return {s.getPath().getName(): self.fs.getContentSummary(s.getPath()).getLength()
                for s in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def read(self, name):
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name, text):
        """A file that is there whole or not at all; one that is there already is an error."""
        if self.fs.exists(self._at(name)):
            raise FileExistsError(f"{self.path}/{name}: another writer was first")
        folder, _, last = name.rpartition("/")
        draft = self._at(f"{folder}/_{last}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(draft, self._at(name)):
            raise FileExistsError(f"{self.path}/{name}: another writer was first")

    def remove(self, name):
        self.fs.delete(self._at(name), True)


class Commit:
    """One version: {bucket: version of its rows}, markers by name, and the buckets' hash."""

    def __init__(self, version=0, buckets=None, markers=None, hashed="murmur3"):
        self.version, self.buckets, self.markers = version, buckets or {}, markers or {}
        self.hashed = hashed

    @classmethod
    def load(cls, text):
        found = json.loads(text)
        return cls(found["version"], {int(b): v for b, v in found["buckets"].items()},
                   found["markers"], found.get("hashed", "xxhash64"))

    def text(self):
        return json.dumps({"version": self.version, "buckets": self.buckets,
                           "markers": self.markers, "hashed": self.hashed})

    def reached(self, markers):
        return bool(markers) and all(self.markers.get(n, -1) >= v for n, v in markers.items())


class StateTable:
    """Rows of one schema, one per key. `buckets` is fixed for the life of the table: choose it
    so that a bucket's rows fit one task."""

    def __init__(self, spark, root, schema, key, buckets=64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.key = [key] if isinstance(key, str) else list(key)
        self.folder = Folder(spark, self.root)

    def commit(self, version=None):
        """The newest commit, or that of a version."""
        if version is None:
            found = [int(n[:-5]) for n in self.folder.names("commits")
                     if n.endswith(".json") and n[0] not in "_."]
            if not found:
                return Commit()
            version = max(found)
        return Commit.load(self.folder.read(f"commits/{version}.json"))

    def bucket_of(self):
        kinds = {f.name: f.dataType for f in self.schema}
        hashed = HASHES[self.commit().hashed]
        return F.pmod(hashed(*[F.col(k).cast(kinds[k]) for k in self.key]),
                      F.lit(self.buckets)).cast("int")

    def read(self, version=None, only=None):
        """The rows as of a version, of all buckets or of some."""
        own = self.commit(version).buckets
        paths = [f"{self.root}/rows/version={v}/{BUCKET}={b}" for b, v in sorted(own.items())
                 if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self._stored(*paths).where(~F.col(STEP).eqNullSafe(GONE)).select(
            *self.schema.names)

    def _stored(self, *paths):
        more = [T.StructField(WAS, self.schema), T.StructField(STEP, T.StringType())]
        return self.spark.read.schema(T.StructType([*self.schema.fields, *more])).parquet(*paths)

    def near(self, keys):
        """The rows of the buckets that the keys of `keys` fall into."""
        return self.read(only=self.touched(keys))

    def feed(self, since, until=None):
        """(before, after) of every key changed by the versions after `since`, version by
        version; NULL before a row was there and after it went."""
        row = T.StructType([T.StructField(n, self.schema) for n in ("before", "after")])
        until = self.commit().version if until is None else until
        versions, feed = range(since + 1, until + 1), self.spark.createDataFrame([], row)
        # Earlier code wrote the rows of a feed themselves.
        plain = [v for v in versions if any(
            n.endswith(".parquet") for n in self.folder.names(f"feed/version={v}"))]
        paths = [f"{self.root}/rows/version={v}/{BUCKET}={b}" for v in versions if v not in plain
                 for b in json.loads(self.folder.read(f"feed/version={v}/buckets.json"))]
        if paths:
            side = F.when(F.col(STEP) == SET, F.struct(*self.schema.names))
            feed = self._stored(*paths).where(F.col(STEP).isNotNull()).select(
                F.col(WAS).alias("before"), side.alias("after"))
        if not plain:
            return feed
        old = self.spark.read.schema(row).parquet(
            *[f"{self.root}/feed/version={v}" for v in plain])
        return feed.unionByName(old) if paths else old

    def touched(self, rows):
        """The buckets that the keys of `rows` fall into; only the key columns are read, so hand
        in rows as they are before they are joined or summed."""
        return set(rows.agg(F.collect_set(self.bucket_of()).alias("b")).head()["b"])

    def _united(self, sides, only):
        """The rows of several sources and the stored ones of some buckets (`old`), below each
        other: the key in its types, and a struct named by the side that has the other columns.
        The flag in it is for sides of keys alone."""
        kinds = {f.name: f.dataType for f in self.schema}
        own = [F.col(k).cast(kinds[k]).alias(k) for k in self.key]
        return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), [
            df.select(*own, F.struct(F.lit(True).alias("_there"), *[
                c for c in df.columns if c not in self.key]).alias(side))
            for side, df in {**sides, "old": self.read(only=only)}.items()])

    def _whole(self, side, columns):
        """A side's struct with the key in front; NULL where the side has no row."""
        return F.when(F.col(side).isNotNull(), F.struct(
            *self.key, *[F.col(side)[c].alias(c) for c in columns])).alias(side)

    def _beside(self, sides, only):
        """One row per key that is in any side or stored in some buckets, with the struct of
        every side that has the key; each side has a key once, or any of its rows will do. All
        rows are dealt once, by key, and stay so until they are written."""
        dealt = (self._united(sides, only).repartition(*self.key)
                 .withColumn(BUCKET, self.bucket_of()))
        columns = {**{side: df.columns for side, df in sides.items()}, "old": self.schema.names}
        return dealt.groupBy(BUCKET, *self.key).agg(*[
            F.first(side, ignorenulls=True).alias(side) for side in columns]).select(
                BUCKET, *self.key, *[self._whole(side, [c for c in names if c not in self.key])
                                     for side, names in columns.items()])

    def _paired(self, rows, only):
        """(new, old): `rows` and the stored rows of some buckets, one row per key that is in
        either."""
        return self._beside({"new": rows}, only).drop(*self.key)

    def _near(self, rows):
        """The buckets to be looked at for `rows`; none while nothing is stored."""
        return self.touched(rows) if self.commit().buckets else set()

    def _row(self, side):
        return F.struct(*[F.col(side)[f.name].cast(f.dataType).alias(f.name)
                          for f in self.schema])

    def replace(self, rows, markers=None, gone=None, only=None):
        """Store `rows`, one per key; with `gone`, a condition on them, drop those keys. `only`
        are the buckets of their keys, where they are known."""
        if self.commit().reached(markers):
            return False
        kept = F.lit(True) if gone is None else ~F.coalesce(gone, F.lit(False))
        pairs = self._paired(rows.withColumn("_kept", kept),
                             self._near(rows) if only is None else only)
        return self._apply(pairs, F.when(F.col("new._kept"), self._row("new")), markers)

    def rebuild(self, keys, sources, made, markers=None, gone=None, only=None):
        """Make the rows of `keys` anew from `sources`, {name: rows, one per key of this table}:
        `made` has the other columns by name and `gone` says when there is no row, both from the
        structs named by the sources. What is stored and all sources are dealt once, together;
        keys may repeat. `only` are the buckets of the keys, where they are known."""
        if self.commit().reached(markers):
            return False
        sides = self._beside({"new": keys.select(*self.key), **sources},
                             self._near(keys) if only is None else only)
        row = F.struct(*[(made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType)
                         .alias(f.name) for f in self.schema])
        kept = F.lit(True) if gone is None else ~F.coalesce(gone, F.lit(False))
        return self._apply(sides, F.when(kept, row), markers)

    def upsert(self, changes, order, markers=None):
        """Store the newest change per key where it is newer than the stored row, by `order`
        and then by all other columns, deletes being rows like any other: in whatever pieces
        and order a log comes, the state is that of `latest_by_key` over all of it. Each task
        keeps one change per key before the one shuffle, in which they meet what is stored."""
        if self.commit().reached(markers):
            return False
        by = [*order, *[f.name for f in self.schema
                        if f.name not in self.key and f.name not in order]]

        def image(side):
            return F.struct(*[F.col(side)[c].alias(c) for c in by])

        rows = self._united({"new": changes.select(*self.schema.names)}, self._near(changes))
        newest = F.max(F.when(F.col("new").isNotNull(), image("new")))
        pairs = rows.groupBy(*self.key).agg(
            newest.alias("new"), F.first("old", ignorenulls=True).alias("old")).select(
                self.bucket_of().alias(BUCKET), self._whole("new", by), self._whole("old", by))
        newer = F.col("old").isNull() | (image("new") > image("old"))
        return self._apply(
            pairs, F.when(newer, self._row("new")).otherwise(self._row("old")), markers)

    def add(self, deltas, markers=None, alive="rows"):
        """Add numbers per key to those stored, NULL being nothing; a key whose `alive` comes to
        0 goes. A key may have any number of deltas: each task sums them before the one shuffle,
        in which they meet what is stored. Each marker counts once, so a delta is never added
        twice."""
        if self.commit().reached(markers):
            return False
        numbers = [f.name for f in self.schema if f.name not in self.key]
        # Plain numbers, not structs of them, are summed without a sort.
        sums = self._united({"new": deltas}, self._near(deltas)).groupBy(*self.key).agg(
            *[F.coalesce(F.sum(F.col("new")[c]), F.lit(0)).alias(f"new_{c}") for c in numbers],
            *[F.max(F.col("old")[c]).alias(f"old_{c}") for c in numbers],
            *[F.max(F.col(side)["_there"]).alias(side) for side in ("new", "old")])
        pairs = sums.select(self.bucket_of().alias(BUCKET), *[
            F.when(F.col(side), F.struct(*self.key, *[F.col(f"{side}_{c}").alias(c)
                                                      for c in numbers])).alias(side)
            for side in ("new", "old")])
        total = {c: F.coalesce(F.col(f"old.{c}"), F.lit(0)) + F.col(f"new.{c}") for c in numbers}
        row = F.struct(*[F.col("new")[k].alias(k) for k in self.key],
                       *[total[c].cast(self.schema[c].dataType).alias(c) for c in numbers])
        return self._apply(pairs, F.when(total[alive] != 0, row), markers)

    def _apply(self, pairs, after, markers):
        """Write the buckets, each row with what it was before, the list of those that changed,
        then the commit. Buckets in which nothing changed are not kept."""
        now = self.commit()
        version = now.version + 1
        seen, written = Observation(), f"rows/version={version}"
        before = F.when(F.col("old").isNotNull(), self._row("old"))
        sides = pairs.select(BUCKET, before.alias("before"), F.when(
            F.col("new").isNull(), before).otherwise(after).alias("after"))
        same = F.col("before").eqNullSafe(F.col("after"))
        step = F.when(~same, F.when(F.col("after").isNull(), GONE).otherwise(SET))
        rows = sides.where(F.col("before").isNotNull() | F.col("after").isNotNull()).select(
            "after.*", F.when(~same, F.col("before")).alias(WAS), step.alias(STEP), BUCKET)
        rows = rows.observe(
            seen, F.collect_set(F.when(F.col(STEP).isNotNull(), F.col(BUCKET))).alias("changed"),
            F.collect_set(F.when(~F.col(STEP).eqNullSafe(GONE), F.col(BUCKET))).alias("filled"))
        with dealing(self.spark, self.buckets):
            (rows.write.mode("overwrite").option("compression", CODEC).partitionBy(BUCKET)
             .parquet(f"{self.root}/{written}"))
        changed, filled = set(seen.get["changed"]), set(seen.get["filled"])
        for bucket in filled - changed:
            self.folder.remove(f"{written}/{BUCKET}={bucket}")
        self.folder.remove(f"feed/version={version}")  # of a version that was not committed
        self.folder.write_new(f"feed/version={version}/buckets.json", json.dumps(sorted(changed)))
        # A bucket that lost its last row is none.
        buckets = {b: v for b, v in now.buckets.items() if b not in changed}
        buckets |= {b: version for b in filled & changed}
        self.folder.write_new(f"commits/{version}.json", Commit(
            version, buckets, {**now.markers, **(markers or {})}, now.hashed).text())
        return True

    def vacuum(self, keep=2, feed_from=None):
        """Remove what only versions before the last `keep` ones need, and feeds up to a
        version that every follower has passed. Readers of older versions lose their files. The
        rows of a feed are those of its version, so a feed that stays keeps its buckets."""
        newest = self.commit().version
        first = max(newest - keep + 1, 1)
        for name in self.folder.names("commits"):
            number = name.split(".")[0]
            if number.isdigit() and int(number) < first:
                self.folder.remove(f"commits/{name}")
        used = {(b, v) for n in range(first, newest + 1)
                for b, v in self.commit(n).buckets.items()}
        for name in self.folder.names("feed"):
            if feed_from is not None and int(name.split("=")[1]) <= min(feed_from, newest):
                self.folder.remove(f"feed/{name}")
        fed = {int(name.split("=")[1]) for name in self.folder.names("feed")}
        for name in self.folder.names("rows"):
            version, left = int(name.split("=")[1]), 0
            for own in self.folder.names(f"rows/{name}"):
                if own.startswith(f"{BUCKET}=") and (int(own.split("=")[1]), version) in used or (
                        version in fed):
                    left += 1
                elif own.startswith(f"{BUCKET}="):
                    self.folder.remove(f"rows/{name}/{own}")
            if not left and version <= newest:
                self.folder.remove(f"rows/{name}")
