"""Time travel from periodic states: the nearest state at or below a time, and the log after it."""

import json

from pyspark.sql import functions as F

from cdclake.operators.state import APPLY, IGNORE, NONE, latest_by_key, live
from cdclake.plans.silver import change_key, typed
from cdclake.sinks.state_table import Folder

KEY = "_key"
ORDER = ("ts_ms", "seq", "ingest_ts", "after")


class StateIndex:
    """States of one captured table at chosen times, below one folder.

    A state holds the newest image per key up to its time, deletes among them where they are
    applied, and the ingest time up to which it has read the log. Rows that reached the log
    later are read from there, however old their change is, so late ones are not lost; ingest
    times must grow from one batch of the log to the next.
    """

    def __init__(self, spark, root, contract, deletes=IGNORE):
        self.spark, self.root = spark, root.rstrip("/")
        self.contract, self.deletes = contract, deletes
        self.folder = Folder(spark, self.root)

    def times(self):
        """The times that have a state, ascending."""
        return sorted(int(n[:-5]) for n in self.folder.names("index") if n[0] not in "_.")

    def _log(self, bronze, ts_ms):
        log = bronze.where((F.col("table_name") == self.contract.table)
                           & (F.col("ts_ms") <= ts_ms))
        if self.deletes == IGNORE:
            log = log.where(F.col("op") != "d")
        return log

    def _rows(self, log):
        seq = F.col("seq") if "seq" in log.columns else F.lit(None)
        return log.select(change_key(self.contract, self.deletes).alias(KEY), "op", "ts_ms",
                          seq.cast("bigint").alias("seq"), "ingest_ts", "after")

    def images(self, bronze, ts_ms):
        """Newest image per key as of a time; deletes stay as rows where they are applied."""
        times = [t for t in self.times() if t <= ts_ms]
        log = self._log(bronze, ts_ms)
        if times:
            base = times[-1]
            known = json.loads(self.folder.read(f"index/{base}.json"))["ingested"]
            late = F.lit(True) if known is None else F.col("ingest_ts") > F.timestamp_micros(
                F.lit(known))
            log = log.where((F.col("ts_ms") > base) | late)
        rows = self._rows(log)
        if times:
            stored = self.spark.read.schema(rows.schema).parquet(f"{self.root}/at={base}")
            rows = stored.unionByName(rows)
        return latest_by_key(rows, KEY, list(ORDER), NONE)

    def take(self, bronze, ts_ms):
        """Write the state as of a time, from the one before it and the log since."""
        if ts_ms in self.times():
            return
        newest = self._log(bronze, ts_ms).agg(F.unix_micros(F.max("ingest_ts"))).head()[0]
        # What comes in while the state is written is left to the log.
        bound = bronze if newest is None else bronze.where(
            F.col("ingest_ts") <= F.timestamp_micros(F.lit(newest)))
        self.images(bound, ts_ms).write.mode("overwrite").parquet(f"{self.root}/at={ts_ms}")
        before = [t for t in self.times() if t <= ts_ms]
        if newest is None and before:
            newest = json.loads(self.folder.read(f"index/{before[-1]}.json"))["ingested"]
        self.folder.write_new(f"index/{ts_ms}.json", json.dumps({"ingested": newest}))

    def state_as_of(self, bronze, ts_ms):
        """The silver table as it was at `ts_ms`: what `silver.state_as_of` gives from the whole
        log."""
        images = self.images(bronze, ts_ms)
        if self.deletes == APPLY:
            images = live(images)
        row = F.from_json("after", self.contract.text_schema)
        return images.select(row.alias("row")).select(*typed(F.col("row"), self.contract))
