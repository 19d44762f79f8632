"""Registry and sides of a small star schema of orders: the order number is the coordinate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.plans.registry import Anchor, KeyPart, Registry
from evenkeel.sources.snapshot import Snapshot

SURROGATES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
FOREIGN_KEYS = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}
NATURAL_KEYS = {
    # parts have none: what they look like is not unique
    "region": (KeyPart("r_name"),),
    "nation": (KeyPart("n_name"),),
    "customer": (KeyPart("c_name"),),
    "supplier": (KeyPart("s_name"),),
    "orders": (KeyPart("o_custkey", "customer"), KeyPart("o_block")),
}
#: Sums of money and the like, which the SQL over these tables reads as decimals.
SCALES = dict.fromkeys(("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"), 2)
#: What a side's surrogate keys are shifted by.
SHIFT = 100_000


def star_registry() -> Registry:
    return Registry(
        excluded=dict.fromkeys(("documents", "embeddings", "pages", "benchmark", "labels", "conversations"), "not part of the star"),
        giants=frozenset({"lineitem"}),
        foreign_keys=FOREIGN_KEYS,
        natural_keys=NATURAL_KEYS,
        anchors={"orders": Anchor("ids", "o_orderkey", "orders"), "lineitem": Anchor("ids", "l_orderkey", "orders"), "events": Anchor("epoch", "day")},
        spines={"orders": None},
        root="orders",
        coordinate="o_block",
        epoch_root="events",
        epoch="day",
        value_columns=("l_extendedprice", "o_totalprice", "value"),
        surrogates=SURROGATES,
        scales=SCALES,
    )


def star_side(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The tables as they are, orders with their number as ``o_block``, events with ``day``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (*SURROGATES, "lineitem")}
    tables["orders"] = tables["orders"].withColumn("o_block", F.col("o_orderkey"))
    tables["events"] = tables["events"].withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")))
    return Snapshot("star", tables)


def shifted(side: Snapshot, edits: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Snapshot:
    """Another copy of the same history: every surrogate and foreign key shifted, then edited."""
    tables = {}
    for name, table in side.tables.items():
        for column in table.columns:
            if column == SURROGATES.get(name) or column in FOREIGN_KEYS:
                table = table.withColumn(column, F.col(column) + SHIFT)
        tables[name] = (edits or {}).get(name, lambda t: t)(table)
    return Snapshot("shifted", tables)
