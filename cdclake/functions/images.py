"""JSON row images."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_image(df, columns=None, within=None):
    """JSON text of a row. NULL fields stay; timestamps go as text, to keep microseconds.

    `within` names a struct column that holds the columns, with the types they have in `df`.
    """
    times = (T.TimestampType, T.TimestampNTZType)
    cells = []
    for name in columns or df.columns:
        cell = F.col(within)[name] if within else F.col(name)
        if isinstance(df.schema[name].dataType, times):
            cell = cell.cast("string")
        cells.append(cell.alias(name))
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def epoch_millis(ts):
    """Epoch milliseconds of a timestamp; one without zone is read in the session zone (UTC)."""
    return F.unix_millis(ts.cast("timestamp"))
