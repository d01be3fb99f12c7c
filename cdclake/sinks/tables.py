"""Namespaces, tables and files that jobs write."""

from pyspark.sql import functions as F

from cdclake.sources.files import CSV_OPTIONS

SESSION_CATALOG = "spark_catalog"


def quoted(name):
    return ".".join(f"`{part}`" for part in name.split("."))


def ensure_namespace(spark, namespace, location=None):
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {quoted(namespace)}{where}")


def ensure_table(spark, name, ddl, fmt="parquet", partitioned_by=(), location=None):
    parts = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({ddl}) USING {fmt}{parts}{where}")


def recreate_table(spark, name, ddl, fmt="parquet", location=None):
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
    ensure_table(spark, name, ddl, fmt, location=location)


def ctas(df, name, fmt="parquet", path=None):
    """Create a table from a query; fails if the table exists."""
    writer = df.write.format(fmt).mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def _in_session_catalog(spark, name):
    parts = name.split(".")
    catalog = parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()
    return catalog == SESSION_CATALOG


def _location(spark, name):
    """Current folder of a table, or None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(name)}")
    return detail.where(F.col("col_name") == "Location").head()["data_type"].rstrip("/")


def replace_table(df, name, fmt="parquet"):
    """Replace a table's content; readers see the old rows or the new rows.

    Catalogs with atomic replacement do it themselves. In the session catalog the table
    has two folders, `a` and `b`: the rows go into the one not in use and one catalog
    update then points the table at it. So a query may read the table it replaces, a
    failed write leaves the table as it was, and at most two copies are kept. A query
    that started before has until the next replacement to finish, and another session that
    knows the table already needs a REFRESH TABLE. Only a changed set of columns needs a
    drop and create, with a moment between them.
    """
    spark = df.sparkSession
    if not _in_session_catalog(spark, name):
        df.writeTo(name).using(fmt).createOrReplace()
        return
    namespace, table = name.split(".")[-2:]
    root = f"{spark.catalog.getDatabase(namespace).locationUri.rstrip('/')}/{table}"
    current = _location(spark, name)
    target = f"{root}/b" if current and current.endswith("/a") else f"{root}/a"
    df.write.format(fmt).mode("overwrite").save(target)
    columns = [(f.name, f.dataType.simpleString()) for f in df.schema]
    if current:
        known = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]
        if known == columns:
            spark.sql(f"ALTER TABLE {quoted(name)} SET LOCATION '{target}'")
            return
        spark.sql(f"DROP TABLE {quoted(name)}")
    ddl = ", ".join(f"`{column}` {kind}" for column, kind in columns)
    ensure_table(spark, name, ddl, fmt, location=target)


def append(df, name):
    """Add rows to a table, matching columns by name."""
    spark = df.sparkSession
    if _in_session_catalog(spark, name):
        df.select(*spark.table(name).columns).write.insertInto(name)
    else:
        df.writeTo(name).append()


def insert_select(df, name):
    """INSERT ... SELECT: add the result of a query to a table."""
    append(df, name)


def write_csv_table(df, path, mode="errorifexists"):
    df.write.options(**CSV_OPTIONS).mode(mode).csv(path)
