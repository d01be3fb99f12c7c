"""Quality suites kept by partition: a gate reads new partitions only."""

import hashlib

from pyspark.sql import functions as F

from cdclake.operators.quality import merged_suite, suite_states
from cdclake.sinks.state_table import StateTable


class PartitionChecks:
    """The states of a suite for every value of the `by` columns of a table, below a folder.

    `take` looks at rows of whole partitions and stores their states, replacing those they
    had; so a partition that is taken again counts once. `results` merges what is stored,
    which is a row per partition, and never reads the table. The folder of a suite is named
    by its checks: one that changes begins anew. Every check needs a mergeable state.
    """

    def __init__(self, df, root, checks, by, buckets=4):
        self.checks, self.by = checks, [by] if isinstance(by, str) else list(by)
        said = repr([(c.name, [str(p) for p in c.state.parts] if c.state else None)
                     for c in checks] + self.by)
        schema = suite_states(df, checks, self.by).schema
        name = hashlib.sha256((said + schema.simpleString()).encode()).hexdigest()[:16]
        self.table = StateTable(df.sparkSession, f"{root.rstrip('/')}/suite-{name}", schema,
                                self.by, buckets)

    def take(self, df, markers=None):
        """Check the partitions that `df` holds whole; False if `markers` say it was done."""
        return self.table.replace(suite_states(df, self.checks, self.by), markers)

    def drop(self, gone, markers=None):
        """Forget the partitions, given by their `by` columns, that left the table."""
        stored = self.table.near(gone.select(*self.by)).join(
            gone.select(*self.by).distinct(), self.by, "left_semi")
        return self.table.replace(stored, markers, gone=F.lit(True))

    def results(self, only=None):
        """(check, observed, passed) over all partitions, or those that fit a condition."""
        states = self.table.read()
        return merged_suite(states if only is None else states.where(only), self.checks)

    def by_partition(self, check):
        """Partitions with what one check observes in each and whether it passes."""
        at = next(i for i, c in enumerate(self.checks) if c.name == check)
        found = self.checks[at]
        seen = found.state.value(*[F.col(f"c{at}_{j}") for j in range(len(found.state.parts))])
        return self.table.read().select(
            *self.by, seen.cast("double").alias("observed"),
            F.coalesce(found.passes(seen), F.lit(False)).alias("passed"))
