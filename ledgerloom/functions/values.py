"""Rates with undefined values as null, vectors, canonical JSON and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(n: Column | str, d: Column | str) -> Column:
    """n / d, null if d is 0."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0))


def value_range(c: str) -> Column:
    """Largest less smallest defined value of a group, null for fewer than two."""
    return F.when(F.count(c) >= 2, F.max(c) - F.min(c))


def value_ratio(c: str) -> Column:
    """Smallest by largest defined value of a group, null for fewer than two or a largest of 0."""
    return F.when(F.count(c) >= 2, F.min(c) / F.nullif(F.max(c), F.lit(0.0)))


def ordered_mean(value: str, order: str) -> Column:
    """Mean of the defined values, added in a fixed order so that equal groups get exactly equal means."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.aggregate(listed, F.lit(0.0), lambda s, x: s + x[value]) / F.nullif(F.count(value).cast("double"), F.lit(0.0))


def both(a: Column, b: Column) -> Column:
    """The larger of two values, null unless both are defined."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def is_usable_vector(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row's compact JSON array, nulls kept."""
    quoted = [F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null")) for c in columns]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256)


def sorted_map_json(m: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
