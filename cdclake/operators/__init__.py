"""DataFrame operators over change logs, tables, lineage events and metric samples."""
