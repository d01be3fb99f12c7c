"""Random draws that depend on the row's id and the seed only, never on partitioning."""

from pyspark.sql import functions as F


def uniform(seed, entity, slot, *ids):
    """Uniform double in [0, 1) from a hash of seed, entity, slot and ids."""
    bits = F.xxhash64(F.lit(seed), F.lit(entity), F.lit(slot), *ids)
    return F.shiftrightunsigned(bits, 11) / F.lit(float(2 ** 53))


def integer(u, low, high):
    """Integer in [low, high], both included."""
    low, high = (b if hasattr(b, "cast") else F.lit(b) for b in (low, high))
    return (low + F.floor(u * (high - low + F.lit(1)))).cast("bigint")


def choice(u, values):
    index = F.floor(u * F.lit(len(values))) + F.lit(1)
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def weighted(u, values, weights):
    total, seen, picked = sum(weights), 0, None
    for value, weight in list(zip(values, weights))[:-1]:
        seen += weight
        test = u < F.lit(seen / total)
        picked = F.when(test, value) if picked is None else picked.when(test, value)
    return picked.otherwise(values[-1])
