"""Continuous ingest of change events of all tables into one bronze log."""

from cdclake.contracts import BRONZE_DDL
from cdclake.operators.changes import TOPIC_PREFIX, decode_envelope
from cdclake.sinks.tables import ensure_namespace, ensure_table, replace_table

RAW_DDL = "topic STRING, value STRING"
TRIGGER = "10 seconds"
BATCH_LIMITS = {"kafka": "maxOffsetsPerTrigger"}  # files are limited by their number


def read_change_stream(spark, source, fmt="kafka", prefix=TOPIC_PREFIX, max_per_trigger=None,
                       **options):
    """Stream of (topic, value) from every topic with the prefix, from its start.

    With `kafka`, `source` is the list of brokers and the connector's jar must be there;
    any other format reads files with these two columns, `source` being their folder.
    `max_per_trigger` bounds a batch, in records or files, so that a long history is taken
    in steps.
    """
    if max_per_trigger:
        options[BATCH_LIMITS.get(fmt, "maxFilesPerTrigger")] = max_per_trigger
    if fmt == "kafka":
        pattern = prefix.replace(".", r"\.") + ".*"
        options = {"kafka.bootstrap.servers": source, "subscribePattern": pattern,
                   "startingOffsets": "earliest", **options}
        return spark.readStream.format("kafka").options(**options).load()
    return spark.readStream.format(fmt).schema(RAW_DDL).options(**options).load(source)


def ensure_bronze(spark, table, fmt="parquet", location=None, sequence=None):
    """The bronze table, split by source table so that silver reads only its own part."""
    ensure_namespace(spark, table.rsplit(".", 1)[0])
    ddl = BRONZE_DDL + ", seq BIGINT" if sequence else BRONZE_DDL
    ensure_table(spark, table, ddl, fmt, ["table_name"], location)


def start_bronze(rows, table, checkpoint, trigger=TRIGGER, once=False, fmt="parquet", **options):
    """Append a stream of bronze rows to a table, resuming from the checkpoint.

    `once` takes all that has arrived, in batches, and stops. Further options go to the
    sink, such as a fan-out writer for formats that offer one.
    """
    writer = (rows.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint).options(**options)
              .partitionBy("table_name"))
    writer = (writer.trigger(availableNow=True) if once
              else writer.trigger(processingTime=trigger))
    return writer.toTable(table)


def ingest(raw, table, checkpoint, prefix=TOPIC_PREFIX, sequence=None, keep_delete_image=False,
           **options):
    """With `keep_delete_image` a delete carries its key, without which it cannot be applied."""
    rows = decode_envelope(raw, prefix, keep_delete_image, sequence)
    return start_bronze(rows, table, checkpoint, **options)


def maintain_state(rows, table, merge, checkpoint, trigger=TRIGGER, once=False, fmt="parquet"):
    """Keep a current-state table up to date from a stream of bronze rows.

    `merge(current, changes)` gives the new state for each micro-batch, for instance by
    `upsert`. Each batch replaces the table in one step, and running a batch twice gives
    the same state, so a restart in the middle of one does no harm. A batch rewrites the
    whole state: give large tables a long trigger.
    """
    owner = rows.sparkSession

    def apply(changes, batch_id):
        replace_table(merge(changes.sparkSession.table(table), changes), table, fmt)
        owner.catalog.refreshTable(table)  # batches run in a session of their own

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if once
              else writer.trigger(processingTime=trigger))
    return writer.start()
