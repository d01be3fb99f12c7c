"""File, table and in-memory sources."""

CSV_OPTIONS = {
    # Quotes are doubled inside quoted text, as common CSV writers do.
    "header": "true", "quote": '"', "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}


def read_csv_table(spark, path, contract, multi_line=False):
    """CSV with a header, typed by the contract; a bad cell or header fails the read."""
    return (spark.read.options(**CSV_OPTIONS)
            .option("enforceSchema", "false").option("mode", "FAILFAST")
            .option("multiLine", multi_line)
            .schema(contract.schema).csv(path))


def read_table(spark, name, fmt=None):
    """A catalog table, or with `fmt` the files of that format at a path.

    Formats beyond the built-in ones need their jar on the class path.
    """
    return spark.read.format(fmt).load(name) if fmt else spark.table(name)


def tpch_customer(spark, directory):
    return spark.read.parquet(f"{directory}/customer.parquet")


def inline_rows(spark, rows, ddl):
    return spark.createDataFrame(rows, schema=ddl)
