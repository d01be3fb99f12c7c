"""A change log that stays in few files while a stream appends to it.

    root/commits/7.json                    the units that make up version 7, and markers
    root/data/_unit=x/table_name=orders/   the rows of a unit, split by source table

Every batch becomes a unit of level 0. As soon as there are `fan` neighbouring units of one
level, `compact` writes them again as one unit of the next, so that a row is rewritten once
per level at most and the number of units grows with the logarithm of that of the batches, up to
`levels`; beyond that units are large enough to stay. A unit that holds over `fan` times all
those it would be merged with, in large files, is raised to the next level as it is: a first
load is not written again for each level that small batches after it fill. A version is its
commit file, written last. Readers take the units of one version: a compaction or a batch that
comes meanwhile changes nothing for them, until `vacuum` removes what only old versions need.

Every row carries the version that brought it, which compaction keeps. So a reader can be
pinned to any version, and a follower reads what came after the one it knows, compacted or not.

One process writes a log; its stream and its compaction may be different threads of it.
"""

import json
import threading
import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cdclake.contracts import BRONZE_DDL
from cdclake.sinks.state_table import Folder

VERSION, UNIT = "_version", "_unit"
FILLED = 16  # files of at least 1/16 of `file_bytes` on average are large ones
_LOCKS = defaultdict(threading.Lock)


class ChangeLog:
    def __init__(self, spark, root, schema=BRONZE_DDL, split="table_name", fan=8, levels=4,
                 file_bytes=128 << 20):
        self.spark, self.root, self.split = spark, root.rstrip("/"), split
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = schema.names
        self.schema = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])
        self.fan, self.levels, self.file_bytes = fan, levels, file_bytes
        self.folder = Folder(spark, self.root)
        self.commits, self.work = _LOCKS[self.root], _LOCKS[f"{self.root}#compaction"]

    def versions(self):
        return sorted(int(n[:-5]) for n in self.folder.names("commits")
                      if n.endswith(".json") and n[0] not in "_.")

    def commit(self, version=None):
        """{version, units, markers} of the newest version, or of one that is still kept."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "units": [], "markers": {}}
            version = found[-1]
        return json.loads(self.folder.read(f"commits/{version}.json"))

    def _write(self, commit):
        self.folder.write_new(f"commits/{commit['version']}.json", json.dumps(commit))

    def append(self, rows, markers=None):
        """Rows as a new version. One whose markers were reached before adds nothing, so a
        batch that is run again after a failure counts once."""
        markers = markers or {}
        unit = f"{UNIT}=batch-{uuid.uuid4().hex}"
        with self.commits:
            now = self.commit()
            if markers and all(now["markers"].get(n, -1) >= v for n, v in markers.items()):
                return now["version"]
            version = now["version"] + 1
            (rows.select(*self.columns, F.lit(version).cast("bigint").alias(VERSION))
             .write.partitionBy(self.split).parquet(f"{self.root}/data/{unit}"))
            self._write({"version": version, "markers": {**now["markers"], **markers},
                         "units": [*now["units"], {"name": unit, "level": 0, "first": version,
                                                   "last": version}]})
            return version

    def _due(self, units):
        """The first `fan` neighbours of one level below the highest, lowest levels first."""
        for level in range(self.levels):
            own = [u for u in units if u["level"] == level]
            if len(own) >= self.fan:
                return own[:self.fan]
        return []

    def compact(self):
        """Merge until no `fan` neighbours of a level are left; the number of merges made.
        Batches may be committed meanwhile: only the commit itself waits for them."""
        done = 0
        with self.work:
            while due := self._due(units := self.commit()["units"]):
                if large := self._outgrown(due):
                    self._raise(large)
                    continue
                old, level = self._with_next(due, units)
                unit = f"{UNIT}=merged-{uuid.uuid4().hex}"
                self._merge(old, unit)
                merged = {"name": unit, "level": level, "first": min(u["first"] for u in old),
                          "last": max(u["last"] for u in old)}
                gone = {u["name"] for u in old}
                with self.commits:
                    now = self.commit()
                    kept = [merged if u["name"] == old[0]["name"] else u for u in now["units"]
                            if u["name"] not in gone or u["name"] == old[0]["name"]]
                    self._write({"version": now["version"] + 1, "units": kept,
                                 "markers": now["markers"]})
                done += 1
        return done

    def _with_next(self, due, units):
        """The units to merge now and the level of what they become: where that would be due on
        its level at once, the units there are taken along, so that it is not written twice."""
        level = due[0]["level"] + 1
        while level < self.levels:
            more = [u for u in units if u["level"] == level]
            if len(more) != self.fan - 1 or self._outgrown([*more, *due]):
                break
            due, level = [*more, *due], level + 1
        return [u for u in units if u in due], level

    def _outgrown(self, due):
        """The unit, if any, that holds over `fan` times what all others due hold, at least a
        file's worth, in files large enough to stay."""
        sizes = {u["name"]: self.folder.sizes(f"data/{u['name']}") for u in due}
        whole = {n: sum(s.values()) for n, s in sizes.items()}
        name = max(whole, key=whole.get)
        rest = sum(whole.values()) - whole[name]
        if whole[name] < self.file_bytes or whole[name] <= self.fan * rest:
            return None
        few = sum(-(-s * FILLED // self.file_bytes) for n, s in sizes[name].items()
                  if n.startswith(f"{self.split}="))
        files = sum(n.endswith(".parquet") for table in sizes[name]
                    for n in self.folder.names(f"data/{name}/{table}"))
        return name if files <= few else None

    def _raise(self, name):
        with self.commits:
            now = self.commit()
            units = [{**u, "level": u["level"] + 1} if u["name"] == name else u
                     for u in now["units"]]
            self._write({"version": now["version"] + 1, "units": units,
                         "markers": now["markers"]})

    def _merge(self, old, unit):
        """Files of about `file_bytes` each. Every source table is read by itself, in as many
        tasks as it fills files, and each task writes what it has read: nothing is shuffled, so
        neither copies of one row nor a large table gather in a task."""
        sizes, paths = defaultdict(int), defaultdict(list)
        for u in old:
            for name, size in self.folder.sizes(f"data/{u['name']}").items():
                if name.startswith(f"{self.split}="):
                    sizes[name] += size
                    paths[name].append(f"{u['name']}/{name}")
        tables = [self._read(paths[name]).coalesce(max(1, -(-size // self.file_bytes)))
                  for name, size in sorted(sizes.items())]
        rows = reduce(DataFrame.unionByName, tables) if tables else self._rows([])
        (rows.sortWithinPartitions(self.split, VERSION)
         .write.partitionBy(self.split).parquet(f"{self.root}/data/{unit}"))

    def _rows(self, units):
        return self._read([u["name"] for u in units])

    def _read(self, folders):
        paths = [f"{self.root}/data/{name}" for name in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data")
        return reader.parquet(*paths).select(*self.schema.names)

    def read(self, version=None):
        """The log as of a version: the newest, one read from `commit` before, or any earlier
        one, whose commit may be gone. Filters on the source table reach the folders."""
        return self.changes(0, version)

    def changes(self, since, until=None):
        """Rows that came after version `since`, up to version `until`."""
        newest = self.commit()
        until = newest["version"] if until is None else until
        if until > newest["version"]:
            raise ValueError(f"{self.root} has no version {until} yet")
        kept = [u for u in newest["units"] if u["last"] > since and u["first"] <= until]
        rows = self._rows(kept)
        if any(u["first"] <= since or u["last"] > until for u in kept):
            rows = rows.where((F.col(VERSION) > since) & (F.col(VERSION) <= until))
        return rows.select(*self.columns)

    def vacuum(self, keep=2):
        """Remove the files that only versions before the last `keep` need, and those of
        batches and merges that failed. Waits for batches and merges under way. Readers that
        opened an older version lose their files."""
        with self.work, self.commits:
            found = self.versions()
            for version in found[:-keep]:
                self.folder.remove(f"commits/{version}.json")
            used = {u["name"] for v in found[-keep:] for u in self.commit(v)["units"]}
            for name in self.folder.names("data"):
                if name not in used:
                    self.folder.remove(f"data/{name}")


def follow(rows, log, checkpoint, trigger=None, once=False, compacted=True):
    """Append a stream of bronze rows to a log, each batch once, resuming from the checkpoint;
    with `compacted`, the log is merged after each batch as far as it is due."""
    folder = Folder(rows.sparkSession, checkpoint)

    def apply(batch, number):
        # Batches are numbered per query, so a new checkpoint counts from 0 under a new id.
        stream = json.loads(folder.read("metadata"))["id"]
        log.append(batch, {f"stream {stream}": number})
        if compacted:
            log.compact()

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if once or trigger is None
              else writer.trigger(processingTime=trigger))
    return writer.start()
