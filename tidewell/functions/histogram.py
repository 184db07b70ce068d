"""The fixed exponential histogram: 150 buckets growing by 15 % from 0.001, with slots for negatives, zeros and overflow.

Vector layout, 153 slots: negatives, zeros, the buckets in order, overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEAST = 1e-3
GROWTH = 1.15
BUCKETS = 150
SLOTS = BUCKETS + 3
QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}

#: Upper bounds, one table for every engine: pow() differs between runtimes in the last bit.
BOUNDS = [LEAST * GROWTH ** (i + 1) for i in range(BUCKETS)]


def slot(v: Column) -> Column:
    """Slot of a value; null for NaN, which no slot counts."""
    place = F.floor((F.log(v) - F.lit(math.log(LEAST))) / F.lit(math.log(GROWTH)))
    return (
        F.when(F.isnan(v), F.lit(None).cast("int"))
        .when(v < 0, 0)
        .when(v == 0, 1)
        .when(v <= LEAST, 2)
        .when(v == float("inf"), SLOTS - 1)
        .otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(BUCKETS)) + 2)
        .cast("int")
    )


def dense(sparse: Column) -> Column:
    """Vector of a map slot -> count."""
    return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at(sparse, i), F.lit(0).cast("long")))


def add(left: Column, right: Column) -> Column:
    """Sum of vectors: a null gives the other, different lengths keep the left one."""
    summed = F.zip_with(left, right, lambda a, b: a + b)
    return F.when(left.isNull(), right).when(right.isNull(), left).when(F.size(left) != F.size(right), left).otherwise(summed)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0).cast("long"), lambda a, b: a + b)


def quantile(vector: Column, q: float) -> Column:
    """Upper bound of the bucket that holds the quantile; null unless the vector has its 153 slots and some count.

    Negatives and zeros count as 0, overflow as the last bound; nothing is interpolated.
    """
    q = min(max(q, 0.0), 1.0)
    target = F.greatest(F.ceil(F.lit(q) * total(vector)), F.lit(1))
    # The target rides along in the state: an expression inside the lambda would be evaluated for every slot.
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at"), target.cast("long").alias("target"))
    reached = F.aggregate(
        vector,
        start,
        lambda s, n: F.struct((s["seen"] + n).alias("seen"), F.when(s["seen"] + n < s["target"], s["at"] + 1).otherwise(s["at"]).alias("at"), s["target"].alias("target")),
        lambda s: s["at"],
    )
    values = F.array(*[F.lit(0.0), F.lit(0.0), *[F.lit(b) for b in BOUNDS], F.lit(BOUNDS[-1])])
    return F.when((F.size(vector) == SLOTS) & (total(vector) > 0), F.get(values, reached))


def quantile_sparse(entries: Column, q: float) -> Column:
    """The same from the occupied slots alone: an array of (slot, count) in order of slot; null where it is empty.

    A rollup occupies a few slots of 153, so this is the way whenever no vector is wanted.
    """
    q = min(max(q, 0.0), 1.0)
    n = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["count"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at"), F.greatest(F.ceil(F.lit(q) * n), F.lit(1)).cast("long").alias("target"))
    reached = F.aggregate(
        entries,
        start,
        lambda s, e: F.struct((s["seen"] + e["count"]).alias("seen"), F.when(s["seen"] < s["target"], e["slot"]).otherwise(s["at"]).alias("at"), s["target"].alias("target")),
        lambda s: s["at"],
    )
    values = F.array(*[F.lit(0.0), F.lit(0.0), *[F.lit(b) for b in BOUNDS], F.lit(BOUNDS[-1])])
    return F.when(F.size(entries) > 0, F.get(values, reached))


def quantile_of(values: list[int] | None, q: float) -> float | None:
    """The same on the driver, for a list."""
    if values is None or len(values) != SLOTS or not sum(values):
        return None
    target, seen = max(1, math.ceil(min(max(q, 0.0), 1.0) * sum(values))), 0
    for i, n in enumerate(values):
        seen += n
        if seen >= target:
            return 0.0 if i < 2 else BOUNDS[min(i - 2, BUCKETS - 1)]
    return BOUNDS[-1]
