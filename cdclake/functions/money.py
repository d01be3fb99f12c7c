"""Exact money sums in 64-bit integers.

Prices arrive as doubles. Summing doubles gives results that depend on the order of
the rows, and sums of wide decimals leave the fast path of the aggregation. So amounts
are turned into integers of `digits` decimal places (BIGINT; ten-thousandths unless said
otherwise), multiplied and summed, and turned back once per group. A price with more places
than that fails the job instead of being rounded, and so does a group that overflows, which
with four digits is one beyond 922 trillion.
"""

from decimal import Decimal

from pyspark.sql import functions as F

PLACES = 4
# A price is off by half a unit in the last place of its double, its product by another half:
# together at most 2^-52 of it. Twice that still tells apart what doubles can hold.
SLACK = 2.0 ** -51


def minor_units(amount, digits=PLACES):
    scaled = amount.cast("double") * F.lit(float(10 ** digits))
    units = F.round(scaled)
    fits = F.abs(scaled - units) <= F.abs(scaled) * SLACK
    return F.when(fits | amount.isNull(), units.cast("bigint")).otherwise(F.raise_error(F.concat(
        amount.cast("string"), F.lit(f" has more than {digits} decimal places"))).cast("bigint"))


def from_minor_units(units, places=2, digits=PLACES):
    exact = units.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))
    return F.round(exact, places).cast("double")


def rounded(amount):
    """A mart's two-place amount as a decimal, for exact sums over marts."""
    return amount.cast("decimal(20,2)")
