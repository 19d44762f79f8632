"""Set-hashes and value proofs of rows, whole or by bucket, in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.canonical import set_hash_columns, set_hash_sums


@dataclass(frozen=True)
class SetHash:
    """Count and two sums; adds up over disjoint parts."""

    n: int = 0
    s1: int = 0
    s2: int = 0

    def __add__(self, other: SetHash) -> SetHash:
        return SetHash(self.n + other.n, self.s1 + other.s1, self.s2 + other.s2)

    def __sub__(self, other: SetHash) -> SetHash:
        return SetHash(self.n - other.n, self.s1 - other.s1, self.s2 - other.s2)


def set_hash(rows: DataFrame, *by: str, values: bool = False) -> DataFrame:
    """(by, n, s1, s2[, v_sum, v_min, v_max]) of rows with a ``digest`` and a ``value``."""
    proof = [F.sum("value").alias("v_sum"), F.min("value").alias("v_min"), F.max("value").alias("v_max")] if values else []
    summed = rows.groupBy(*by).agg(*set_hash_sums("digest"), *proof)
    zero = [F.coalesce(c, F.lit(0)).cast("decimal(38,6)").alias(c) for c in ("v_sum", "v_min", "v_max")] if values else []
    return summed.select(*by, *set_hash_columns(), *zero)


def collected(hashes: DataFrame, key: str) -> dict[int, SetHash]:
    """Buckets' set-hashes; callers bound the number of buckets."""
    return {int(r[key]): SetHash(int(r["n"]), int(r["s1"]), int(r["s2"])) for r in hashes.collect()}


def plain(x: Decimal) -> str:
    """A decimal without trailing zeros."""
    text = format(x, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text
