"""Data-quality checks: all checks of a table run in one aggregation."""

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cdclake.operators.integrity import orphan_keys

COMPARISONS = {">": operator.gt, ">=": operator.ge, "<": operator.lt,
               "<=": operator.le, "=": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class State:
    """A metric in parts: aggregates over any piece of a table, how each is merged over
    pieces, and the metric from the merged parts."""
    parts: tuple
    merges: tuple
    value: object     # merged columns -> column

    def over_table(self):
        return self.value(*self.parts)


@dataclass(frozen=True)
class Check:
    name: str
    observed: Column  # an aggregate over the table
    passes: object    # observed column -> boolean column
    state: State = None  # the same in parts, for checks kept by partition


def counted(column):
    """A count; over no pieces at all it is 0."""
    return State((column,), (F.sum,), lambda n: F.coalesce(n, F.lit(0).cast("bigint")))


def summed(column):
    return State((F.sum(column),), (F.sum,), lambda x: x)


def least(column):
    return State((F.min(column),), (F.min,), lambda x: x)


def greatest(column):
    return State((F.max(column),), (F.max,), lambda x: x)


def average(column):
    return State((F.sum(column), F.count(column)), (F.sum, F.sum),
                 lambda total, n: F.when(n > 0, total / n))


def distinct(column):
    """Distinct values by a sketch of about 1.6 % error that merges without loss."""
    return State((F.hll_sketch_agg(column, F.lit(12)),), (F.hll_union_agg,),
                 lambda sketch: F.coalesce(F.hll_sketch_estimate(sketch),
                                           F.lit(0).cast("bigint")))


def _count_check(name, count, passes):
    return Check(name, count, passes, counted(count))


def _is_zero(observed):
    return observed == 0


def row_count_between(minimum=None, maximum=None, name="row count"):
    def passes(n):
        bounds = [n >= minimum] if minimum is not None else []
        bounds += [n <= maximum] if maximum is not None else []
        return reduce(operator.and_, bounds, F.lit(True))
    return _count_check(name, F.count("*"), passes)


def not_null(column, name=None):
    return _count_check(name or f"{column} is not null", F.count_if(F.col(column).isNull()),
                        _is_zero)


def values_between(column, minimum=None, maximum=None, strict=False, name=None):
    """Every value that is not NULL lies between the bounds, which count as inside unless strict."""
    below, above = (operator.le, operator.ge) if strict else (operator.lt, operator.gt)
    outside = F.lit(False)
    if minimum is not None:
        outside = outside | below(F.col(column), minimum)
    if maximum is not None:
        outside = outside | above(F.col(column), maximum)
    return _count_check(name or f"{column} in range", F.count_if(outside), _is_zero)


def metric_threshold(metric, comparison, value, name):
    """Any aggregate against a value, such as min(c) > 5000. No value (NULL) fails. Given as a
    `State`, such as `least(c)`, it can be kept by partition."""
    state = metric if isinstance(metric, State) else None
    return Check(name, state.over_table() if state else metric,
                 lambda seen: COMPARISONS[comparison](seen, value), state)


def no_rows_where(predicate, name):
    return _count_check(name, F.count_if(predicate), _is_zero)


def missing_count(column):
    return F.count_if(F.col(column).isNull())


def _result(name, observed, passes):
    return F.struct(F.lit(name).alias("check"), observed.cast("double").alias("observed"),
                    F.coalesce(passes(observed), F.lit(False)).alias("passed"))


def run_suite(df, checks):
    """One row (check, observed, passed) per check, from a single pass over the table."""
    totals = df.agg(*[c.observed.alias(f"c{i}") for i, c in enumerate(checks)])
    results = [_result(c.name, F.col(f"c{i}"), c.passes) for i, c in enumerate(checks)]
    return totals.select(F.inline(F.array(*results)))


def _parts(checks):
    """(name, aggregate, merge) of every part of all checks."""
    lost = [c.name for c in checks if c.state is None]
    if lost:
        raise ValueError(f"no mergeable state: {lost}")
    return [(f"c{i}_{j}", part, merge) for i, c in enumerate(checks)
            for j, (part, merge) in enumerate(zip(c.state.parts, c.state.merges))]


def suite_states(df, checks, by):
    """One row per value of the `by` columns with the parts of all checks, in one pass."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*[part.alias(name) for name, part, _ in _parts(checks)])


def merged_suite(states, checks):
    """`run_suite` of the whole table from the states of its pieces."""
    totals = states.agg(*[merge(name).alias(name) for name, _, merge in _parts(checks)])
    results = [_result(c.name, c.state.value(*[F.col(f"c{i}_{j}")
                                               for j in range(len(c.state.parts))]), c.passes)
               for i, c in enumerate(checks)]
    return totals.select(F.inline(F.array(*results)))


def count_difference(left, right):
    """count(left) - count(right), as one row."""
    count = F.count("*")
    return left.agg(count.alias("_left")).select(
        (F.col("_left") - right.agg(count).scalar()).alias("difference"))


def same_count(left, right, name):
    """Coverage by number of rows. Says nothing about keys; see `references`."""
    return count_difference(left, right).select(
        F.inline(F.array(_result(name, F.col("difference"), _is_zero))))


def references(child, parent, key, name, parent_key=None):
    """Every child row's key has a parent; observes the number of rows without one."""
    lost = orphan_keys(child, parent, key, parent_key).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("lost"))
    return lost.select(F.inline(F.array(_result(name, F.col("lost"), _is_zero))))


class QualityError(ValueError):
    pass


def gate(results):
    """Run every check, then raise once with the names of all that failed.

    Collects one row per check.
    """
    rows = results.collect()
    failed = [r["check"] for r in rows if not r["passed"]]
    if failed:
        raise QualityError(f"data quality gate failed: {failed}")
    return rows


def verify_non_empty(df, by, k=5):
    """Number of rows and the k largest by a column, equal ones by the other columns in
    turn; raises if there are none."""
    count = df.count()
    if count == 0:
        raise QualityError("expected rows, found none")
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c != by]
    return count, df.orderBy(F.col(by).desc_nulls_last(), *rest).limit(k).collect()
