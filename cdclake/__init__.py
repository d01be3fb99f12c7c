"""Change-data-capture lakehouse operators for PySpark."""
