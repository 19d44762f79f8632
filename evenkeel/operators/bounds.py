"""The common part of two histories: tips, cutoff, and windows of ids on each side.

Ids differ between the sides, but on each side rows come in the order of the history,
so a stretch of it is a range of ids. The ranges follow the spine tables from the root.
``exact_bound`` needs no such order: it joins up to the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.buckets import bucket_of
from evenkeel.plans.planner import TablePlan, named
from evenkeel.plans.registry import Registry
from evenkeel.sources.snapshot import Snapshot

#: Lowest and highest id; None where the window is empty.
IdRange = tuple[int, int] | None


class EmptyHistory(Exception):
    """A side has no rows on the coordinate at all."""


@dataclass(frozen=True)
class Tip:
    block: int
    epoch: int | None


def tip(side: Snapshot, registry: Registry) -> Tip:
    if registry.root not in side:
        raise EmptyHistory(f"{side.label} has no table {registry.root}")
    found = side[registry.root].agg(F.max(named(registry.coordinate)).alias("block")).first()["block"]
    if found is None:
        raise EmptyHistory(f"{side.label} has no {registry.coordinate} in {registry.root}")
    root = registry.epoch_root or registry.root
    epoch = side[root].agg(F.max(named(registry.epoch)).alias("epoch")).first()["epoch"] if registry.epoch and root in side else None
    return Tip(int(found), None if epoch is None else int(epoch))


def common_cutoff(a: Tip, b: Tip, *, cutoff_block: int | None = None, block_margin: int = 0, epoch_margin: int = 2) -> Tip:
    """The lower tip, less the margins; ``cutoff_block`` overrides the block only."""
    block = max(0, (min(a.block, b.block) if cutoff_block is None else cutoff_block) - block_margin)
    epochs = [t.epoch for t in (a, b) if t.epoch is not None]
    return Tip(block, max(0, min(epochs) - epoch_margin) if epochs else None)


def _ends(table: DataFrame, column: str, key: str, low: int, high: int) -> IdRange:
    """Ids of the first and last row by (column, id) of those with ``column`` in a range."""
    id_, order = named(key), F.struct(named(column).alias("at"), named(key).alias("id"))
    row = table.where(named(column).between(low, high)).agg(F.min_by(id_, order).alias("low"), F.max_by(id_, order).alias("high")).first()
    return None if row["low"] is None else (int(row["low"]), int(row["high"]))


def spine_ranges(side: Snapshot, registry: Registry, cutoff: int, window: tuple[int, int] | None = None) -> dict[str, IdRange]:
    """Each spine table's ids up to ``cutoff``, or within ``window``.

    Up to a cutoff the root's range starts at id 0, so rows without a coordinate that
    come before it are in.
    """
    found: dict[str, IdRange] = {}
    for spine, step in registry.spines.items():
        if spine not in side:
            found[spine] = None
        elif step is None:
            if window is not None:
                found[spine] = _ends(side[spine], registry.coordinate, registry.surrogate(spine), *window)
            else:
                key, at = named(registry.surrogate(spine)), named(registry.coordinate)
                last = side[spine].where(at <= cutoff).agg(F.max_by(key, F.struct(at.alias("at"), key.alias("id"))).alias("high")).first()["high"]
                found[spine] = None if last is None else (0, int(last))
        else:
            parent, column = step
            above = found[parent]
            found[spine] = None if above is None else _ends(side[spine], column, registry.surrogate(spine), *above)
    return found


def bound(plan: TablePlan, ranges: dict[str, IdRange], cutoff_epoch: int | None, window: bool = False) -> Column | bool:
    """The condition that bounds a table on one side; False where nothing is in scope."""
    anchor = plan.anchor
    if anchor.kind == "ids":
        ids = ranges.get(anchor.spine)
        return False if ids is None else named(anchor.column).between(*ids)
    if window:
        return False
    if anchor.kind == "epoch":
        return False if cutoff_epoch is None else named(anchor.column) <= cutoff_epoch
    return True


def coordinates(side: Snapshot, registry: Registry, spine: str) -> DataFrame:
    """(id, coordinate) of every row of a spine table, by joins up to the root."""
    step = registry.spines[spine]
    key = registry.surrogate(spine)
    if step is None:
        return side[spine].select(named(key).alias("id"), named(registry.coordinate).alias("coordinate"))
    parent, column = step
    above = coordinates(side, registry, parent).withColumnRenamed("id", "_above")
    return side[spine].select(named(key).alias("id"), named(column).alias("_up")).join(above, F.col("_up") == F.col("_above")).select("id", "coordinate")


def exact_bound(side: Snapshot, registry: Registry, plan: TablePlan, cutoff: int) -> Snapshot:
    """``side`` with the plan's table cut at ``cutoff`` by a semi join, whatever the order of its ids."""
    if plan.anchor.kind != "ids":
        return side
    inside = coordinates(side, registry, plan.anchor.spine).where(F.col("coordinate").isNull() | (F.col("coordinate") <= cutoff)).select(F.col("id").alias("_inside"))
    table = side[plan.name].join(inside, named(plan.anchor.column) == F.col("_inside"), "left_semi")
    return Snapshot(side.label, side.tables | {plan.name: table}, side.facts)


def edges(cutoff: int, buckets: int) -> list[int]:
    """0, W, 2W, ... and the cutoff, for about ``buckets`` windows."""
    width = max(1, cutoff // max(1, buckets))
    return sorted({*range(0, cutoff + 1, width), cutoff})


def boundary_ids(side: Snapshot, registry: Registry, spine: str, at: Sequence[int]) -> list[int | None]:
    """For each of the ascending edges the spine's first id at or after it; None if there is none.

    One scan gives the first id of each window between edges, at most one row an edge;
    an empty window takes the id of the next one that has any.
    """
    windows = coordinates(side, registry, spine).where(F.col("coordinate").isNotNull()).withColumn("window", bucket_of(F.col("coordinate"), at))
    firsts = {r["window"]: int(r["id"]) for r in windows.where("window > 0").groupBy("window").agg(F.min_by("id", F.struct("coordinate", "id")).alias("id")).collect()}
    found: list[int | None] = []
    following = None
    for k in range(len(at), 0, -1):
        following = firsts.get(k, following)
        found.append(following)
    return found[::-1]
