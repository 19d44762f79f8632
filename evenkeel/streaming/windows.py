"""Set-hashes of a stream by event-time window.

The set-hash adds up, so a stream keeps it per window as it keeps a sum; the watermark is
the margin by which a window must lie behind the tip before it is final.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.canonical import row_digest, set_hash_columns, set_hash_sums


def windowed_set_hash(rows: DataFrame, time_col: str, columns: Sequence[str], *, width: str = "1 day", margin: str = "0 seconds", scales: Mapping[str, int] | None = None) -> DataFrame:
    """(window_start, n, s1, s2) for batch or streaming ``rows``; columns are hashed in name order, doubles at their ``scales``."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    digest = row_digest([(F.col(f"`{c}`"), kinds[c]) for c in sorted(columns)], [(scales or {}).get(c) for c in sorted(columns)])
    at = F.col(time_col).cast("timestamp").alias("_at")
    hashed = rows.select(at, digest.alias("digest"))
    if rows.isStreaming:
        hashed = hashed.withWatermark("_at", margin)
    summed = hashed.groupBy(F.window("_at", width).alias("w")).agg(*set_hash_sums("digest"))
    return summed.select(F.col("w.start").alias("window_start"), *set_hash_columns())
