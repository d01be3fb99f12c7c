"""Referential integrity."""

from pyspark.sql import functions as F

from cdclake.operators.joins import key_counts


def _parent_keys(parent, parent_key):
    return parent.select(F.col(parent_key).alias("_key")).distinct()


def orphan_keys(child, parent, key, parent_key=None):
    """Child keys without a parent, with their number of rows.

    The child is reduced to one row per key before the join, so a hot key costs nothing.
    """
    counted = key_counts(child.where(F.col(key).isNotNull()), key)
    parents = _parent_keys(parent, parent_key or key)
    return counted.join(parents, F.col(key) == F.col("_key"), "left_anti")


def orphans(child, parent, key, parent_key=None):
    """Child rows whose key has no parent; a NULL key references nothing and is no orphan.

    The few orphan keys are found first. Joining them back moves the child only if that
    list is too large to broadcast, as measured at run time.
    """
    missing = orphan_keys(child, parent, key, parent_key).select(F.col(key).alias("_orphan"))
    return child.join(missing, F.col(key) == F.col("_orphan"), "left_semi")
