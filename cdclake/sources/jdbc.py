"""Relational source tables."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Partitioning:
    """Split of a relational scan into parallel range queries on one indexed column."""
    column: str
    lower: object
    upper: object
    partitions: int


def read_jdbc_table(spark, url, table, partitioning=None, properties=None):
    """Relational scan. Filters and column choices on the result run in the database.

    Without `partitioning` one task reads the table, so name a column for large ones;
    rows outside its bounds still arrive, in the first and last range.
    """
    reader = (spark.read.format("jdbc").options(**(properties or {}))
              .option("url", url).option("dbtable", table))
    if partitioning:
        reader = (reader.option("partitionColumn", partitioning.column)
                  .option("lowerBound", str(partitioning.lower))
                  .option("upperBound", str(partitioning.upper))
                  .option("numPartitions", str(partitioning.partitions)))
    return reader.load()


def truncate_load(df, url, table, properties=None, batch_rows=10_000):
    """Empty the table, keeping its definition, then bulk load it from all partitions."""
    (df.write.format("jdbc").mode("overwrite").options(**(properties or {}))
     .option("url", url).option("dbtable", table)
     .option("truncate", "true").option("batchsize", str(batch_rows)).save())


def insert_rows(df, url, table, properties=None, batch_rows=10_000):
    (df.write.format("jdbc").mode("append").options(**(properties or {}))
     .option("url", url).option("dbtable", table)
     .option("batchsize", str(batch_rows)).save())
