"""Label maps: identity, containment, display, size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sized(s: Column) -> Column:
    return F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)


def label_hash(labels: Column) -> Column:
    """128 bits of SHA-256 over the sorted, length-prefixed keys and values; null and empty maps share one hash."""
    keys = F.sort_array(F.map_keys(labels))
    parts = F.transform(keys, lambda k: F.concat(_sized(k), _sized(F.element_at(labels, k))))
    return F.substring(F.sha2(F.coalesce(F.array_join(parts, ""), F.lit("")), 256), 1, 32)


def contains(labels: Column, wanted: dict[str, str]) -> Column:
    """All wanted pairs are present; others may be. A missing key excludes the row."""
    out = F.lit(True)
    for k, v in sorted(wanted.items()):
        out = out & F.coalesce(F.try_element_at(labels, F.lit(k)) == F.lit(v), F.lit(False))
    return out


def has_key(labels: Column, key: str) -> Column:
    return F.map_contains_key(labels, F.lit(key))


def display(labels: Column) -> Column:
    """``{k=v,...}`` with sorted keys."""
    pairs = F.transform(F.sort_array(F.map_keys(labels)), lambda k: F.concat(k, F.lit("="), F.element_at(labels, k)))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def canonical_json(labels: Column) -> Column:
    """JSON object with sorted keys, for comparison across engines."""
    pairs = F.transform(F.sort_array(F.map_keys(labels)), lambda k: F.concat(F.lit('"'), k, F.lit('":"'), F.element_at(labels, k), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _bytes_in(labels: Column) -> Column:
    entries = F.map_entries(labels)
    return F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))


def state_cost(tenant: Column, metric: Column, hash_: Column, kind: Column, labels: Column) -> Column:
    """Estimated bytes of a series held in memory."""
    fixed = 1024 + 2 * (F.octet_length(tenant) + F.octet_length(metric) + F.octet_length(hash_)) + 128 * F.size(F.map_keys(labels))
    return (fixed + 2 * _bytes_in(labels) + F.when(kind == "histogram", 2048).otherwise(0)).cast("long")


def read_cost(tenant: Column, metric: Column, kind: Column, hash_: Column, labels_json: Column, buckets: Column) -> Column:
    """Estimated bytes of a stored row once read."""
    slots = F.when(buckets.isNull(), 0).otherwise(F.size(buckets))
    names = F.octet_length(tenant) + F.octet_length(metric) + F.octet_length(kind) + F.octet_length(hash_)
    return (1024 + 4 * F.octet_length(labels_json) + 16 * slots + names).cast("long")
