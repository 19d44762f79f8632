"""Canonical text of values, row digests, and the additive set-hash.

A value's text is the same in every session: decimals at a fixed scale, doubles in full
precision (a registry can name columns that are rounded to a scale), timestamps as microseconds in UTC, binary as lower-case hex. A row is the
concatenation of its values, each as ``length:text``, with ``N`` for null, so that no two
rows collide by their separators and null differs from the empty string.

The set-hash of a table is ``(n, s1, s2)``: its row count and two sums of 60-bit parts of
the rows' MD5 digests. It does not depend on order, counts duplicates, and adds up:
the set-hash of a union of disjoint parts is the sum of theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_text(value: Column, kind: T.DataType, scale: int | None = None) -> Column:
    """The text of one value; null stays null.

    Doubles and floats that differ have different texts, and 0.0 and -0.0 the same; with
    a ``scale`` they are brought to so many decimal places first.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        if scale is not None:
            return value.cast(T.DecimalType(18 + scale, scale)).cast("string")
        # a float is a double of the same value, and a double's text reads back as that double
        wide = value.cast("double")
        return F.when(wide == 0, F.lit("0.0")).otherwise(wide.cast("string"))
    if isinstance(kind, T.TimestampNTZType):
        # by difference, so that a session's time zone does not shift it
        return _ntz_micros(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return value.cast("string")


def _ntz_micros(value: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, value).cast("string")


def encoded(values: Sequence[tuple[Column, T.DataType]], scales: Sequence[int | None] = ()) -> Column:
    """The injective text of a row; empty for no values. ``scales`` has one entry for each value, or none."""
    parts = []
    for (value, kind), scale in zip(values, scales or [None] * len(values), strict=True):
        text = canonical_text(value, kind, scale)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    return F.concat(*parts) if parts else F.lit("")


def row_digest(values: Sequence[tuple[Column, T.DataType]], scales: Sequence[int | None] = ()) -> Column:
    return F.md5(encoded(values, scales).cast("binary"))


def digest_part(digest: Column, start: int) -> Column:
    """15 hexadecimal digits from ``start`` as a number below 2**60."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def _limb_sums(part: Column, name: str) -> list[Column]:
    # sums of 20-bit limbs stay within a long for 2**43 rows
    return [F.sum(F.shiftright(part, 20 * k).bitwiseAND(F.lit(0xFFFFF))).alias(f"{name}_{k}") for k in range(3)]


def set_hash_sums(digest: str) -> list[Column]:
    """Aggregates over a digest column; ``set_hash_columns`` turns them into (n, s1, s2)."""
    return [F.count(F.lit(1)).alias("n"), *_limb_sums(digest_part(F.col(digest), 1), "s1"), *_limb_sums(digest_part(F.col(digest), 17), "s2")]


def set_hash_columns() -> list[Column]:
    def total(name: str) -> Column:
        big = [F.coalesce(F.col(f"{name}_{k}"), F.lit(0)).cast("decimal(38,0)") * F.lit(1 << (20 * k)).cast("decimal(20,0)") for k in range(3)]
        return (big[0] + big[1] + big[2]).cast("decimal(38,0)").alias(name)

    return [F.col("n"), total("s1"), total("s2")]
