"""From two schemas and a registry to a table's comparison plan, and its DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.canonical import row_digest
from evenkeel.plans.registry import Anchor, Registry
from evenkeel.sources.snapshot import Snapshot, spread

#: How far foreign keys are followed where a table is not a giant.
FULL_DEPTH = 8
BASE = "t0"


@dataclass(frozen=True)
class JoinStep:
    """A left join from a foreign key to the row it points to."""

    parent: str
    column: str
    target: str
    alias: str


@dataclass
class TablePlan:
    """What of a table is hashed, what it is joined with, and how it is bounded."""

    name: str
    kind: str  # normal, giant, accumulator or excluded
    reason: str = ""
    values: list[tuple[str, str]] = field(default_factory=list)  # (alias, column)
    joins: list[JoinStep] = field(default_factory=list)
    anchor: Anchor = field(default_factory=lambda: Anchor("none"))
    value_column: str | None = None
    skipped: list[str] = field(default_factory=list)
    drift: dict[str, list[str]] = field(default_factory=dict)


class _Draft:
    """Joins and values gathered so far; a key that is not resolved leaves nothing behind."""

    def __init__(self, registry: Registry, shared: Mapping[str, set[str]], depth: int, declared: Mapping[str, str]):
        self.registry, self.shared, self.depth, self.declared = registry, shared, depth, declared
        self.joins: dict[tuple[str, str, str], JoinStep] = {}
        self.values: list[tuple[str, str]] = []
        self.skipped: list[str] = []

    def _alias(self, parent: str, column: str, target: str) -> str:
        at = (parent, column, target)
        if at not in self.joins:
            self.joins[at] = JoinStep(parent, column, target, f"j{len(self.joins) + 1}")
        return self.joins[at].alias

    def key_of(self, target: str, parent: str, column: str, level: int) -> list[tuple[str, str]] | None:
        """The natural key of what ``parent.column`` points to, or None if it cannot be told."""
        parts = self.registry.natural_keys.get(target)
        if parts is None:
            return None
        alias = self._alias(parent, column, target)
        found: list[tuple[str, str]] = []
        for part in parts:
            if part.target is None:
                if part.column in self.shared.get(target, ()):
                    found.append((alias, part.column))
                else:
                    self.skipped.append(f"{target}.{part.column} (not on both sides)")
                continue
            if level >= self.depth:
                self.skipped.append(f"{target}.{part.column}->{part.target} (depth>{self.depth})")
                return None
            deeper = self.key_of(part.target, alias, part.column, level + 1)
            if deeper is None:
                return None
            found += deeper
        return found

    def add(self, table: str, column: str) -> None:
        # what is known of the schema goes before what a database declares of its keys
        target = self.registry.target(table, column) or self.declared.get(column)
        if target is None:
            if self.registry.points_somewhere(table, column):
                self.skipped.append(f"{column} (UNMAPPED FK -> excluded)")
            else:
                self.values.append((BASE, column))
            return
        before = dict(self.joins)
        key = self.key_of(target, BASE, column, 1)
        if key is None:
            # nothing of it is hashed, so none of its joins is needed
            self.joins = before
            note = f"{column}->{target}"
            if note not in self.skipped:
                self.skipped.append(note)
        else:
            self.values += key


def named(column: str) -> Column:
    """A column of just this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_columns(a: Snapshot, b: Snapshot) -> dict[str, set[str]]:
    return {t: set(a.columns(t)) & set(b.columns(t)) for t in a.tables if t in b}


def plan_table(name: str, a: Snapshot, b: Snapshot, registry: Registry, *, full: bool = False, giant_depth: int = 1, shared: Mapping[str, set[str]] | None = None) -> TablePlan:
    """Plan one table that both sides have."""
    if name in registry.excluded:
        return TablePlan(name, "excluded", registry.excluded[name])
    shared = shared if shared is not None else shared_columns(a, b)
    giant = name in registry.giants and not full
    anchor = registry.anchor(name)
    first, second = a.foreign_keys(name), b.foreign_keys(name)
    draft = _Draft(registry, shared, giant_depth if giant else FULL_DEPTH, {c: t for c, t in first.items() if second.get(c) == t})
    left_out = {registry.surrogate(name)} | a.generated(name) | b.generated(name) | registry.ignored.get(name, frozenset())
    for column in sorted(shared[name] - left_out):
        draft.add(name, column)
    one_sided = {"only_db1": sorted(set(a.columns(name)) - shared[name]), "only_db2": sorted(set(b.columns(name)) - shared[name])}
    return TablePlan(
        name,
        "giant" if giant else "accumulator" if anchor.kind == "none" else "normal",
        values=draft.values,
        joins=list(draft.joins.values()),
        anchor=anchor,
        value_column=_value_column(name, a, b, registry, shared[name]),
        skipped=draft.skipped,
        drift=one_sided if any(one_sided.values()) else {},
    )


def _value_column(name: str, a: Snapshot, b: Snapshot, registry: Registry, shared: set[str]) -> str | None:
    """The first value column that both sides hold as a number."""

    def numeric(side: Snapshot, column: str) -> bool:
        kind = side[name].schema[column].dataType
        return isinstance(kind, T.NumericType) and not isinstance(kind, T.FloatType)

    return next((c for c in registry.value_columns if c in shared and registry.target(name, c) is None and numeric(a, c) and numeric(b, c)), None)


def hashed_rows(
    plan: TablePlan,
    side: Snapshot,
    registry: Registry,
    bound: Column | bool = True,
    extra: Mapping[str, Column] | None = None,
    *,
    path: Sequence[tuple[str, str]] = (),
    placed: Mapping[str, tuple[str, Callable[[Column], Column]]] | None = None,
) -> DataFrame:
    """(digest, value, extra columns, placed columns) of the bounded rows of one side.

    The bound and the columns go below the joins, to the scan. Small targets are
    broadcast if Spark finds them small; nothing is hinted. ``placed``: functions of
    columns of the row that ``path``, steps of (column, target), leads to; the plan's
    own joins are used as far as they go the same way.
    """
    joins, end = list(plan.joins), BASE
    for column, target in path:
        step = next((j for j in joins if (j.parent, j.column, j.target) == (end, column, target)), None)
        if step is None:
            joins.append(step := JoinStep(end, column, target, f"p{len(joins) + 1}"))
        end = step.alias
    placed = dict(placed or {})
    read = [*plan.values, *((j.parent, j.column) for j in joins), *((end, c) for c, _ in placed.values())]
    base = side[plan.name]
    if bound is not True:
        base = base.where(bound if isinstance(bound, Column) else F.lit(bound))
    extra = dict(extra or {})
    needed = {c for alias, c in read if alias == BASE}
    value = named(plan.value_column) if plan.value_column else F.lit(None)
    rows = base.select(*(named(c).alias(f"{BASE}.{c}") for c in sorted(needed)), value.cast("decimal(38,6)").alias("value"), *(c.alias(k) for k, c in extra.items()))
    rows = spread(rows)
    kinds = {(BASE, f.name): f.dataType for f in side[plan.name].schema.fields}
    for join in joins:
        target = side[join.target]
        key = registry.surrogate(join.target)
        wanted = {c for alias, c in read if alias == join.alias}
        kinds |= {(join.alias, f.name): f.dataType for f in target.schema.fields}
        found = target.select(named(key).alias(f"{join.alias}#"), *(named(c).alias(f"{join.alias}.{c}") for c in sorted(wanted)))
        rows = rows.join(found, named(f"{join.parent}.{join.column}") == named(f"{join.alias}#"), "left")
    digest = row_digest([(named(f"{alias}.{c}"), kinds[alias, c]) for alias, c in plan.values], [registry.scales.get(c) for _, c in plan.values])
    return rows.select(digest.alias("digest"), "value", *extra, *(of(named(f"{end}.{c}")).alias(k) for k, (c, of) in placed.items()))


def explain(plan: TablePlan) -> list[str]:
    """A plan in words, as ``--plan`` prints it."""
    if plan.kind == "excluded":
        return [f"{plan.name}: excluded ({plan.reason})"]
    anchor = plan.anchor
    lines = [f"{plan.name}: {plan.kind}, bounded by {anchor.kind}" + (f" {anchor.column}" if anchor.column else "") + (f" in {anchor.spine}" if anchor.spine else "")]
    lines.append("  hashed: " + (", ".join(f"{a}.{c}" for a, c in plan.values) or "nothing"))
    lines += [f"  left join {j.target} {j.alias} on {j.parent}.{j.column}" for j in plan.joins]
    if plan.value_column:
        lines.append(f"  sum, min and max of {plan.value_column}")
    if plan.skipped:
        lines.append(f"  not hashed: {plan.skipped}")
    if plan.drift:
        lines.append(f"  on one side only: {plan.drift}")
    return lines
