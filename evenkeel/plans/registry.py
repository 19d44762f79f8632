"""Domain facts that a comparison needs and no schema has."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class KeyPart:
    """A part of a natural key: a plain column, or a foreign key with its target."""

    column: str
    target: str | None = None


@dataclass(frozen=True)
class Anchor:
    """How a table lies on the common coordinate.

    ``ids``: ``column`` holds ids of the spine table ``spine``; ``epoch``: ``column``
    is the epoch itself; ``none``: the table is compared whole.
    """

    kind: str
    column: str | None = None
    spine: str | None = None


WHOLE = Anchor("none")


@dataclass(frozen=True)
class Registry:
    """Everything known about a family of schemas."""

    excluded: Mapping[str, str] = field(default_factory=dict)
    giants: frozenset[str] = frozenset()
    foreign_keys: Mapping[str, str] = field(default_factory=dict)  # column -> target
    table_keys: Mapping[tuple[str, str], str] = field(default_factory=dict)  # (table, column) -> target
    natural_keys: Mapping[str, tuple[KeyPart, ...]] = field(default_factory=dict)
    anchors: Mapping[str, Anchor] = field(default_factory=dict)
    #: spine table -> (parent spine table, column with the parent's ids); the first has none
    spines: Mapping[str, tuple[str, str] | None] = field(default_factory=dict)
    root: str = "block"
    coordinate: str = "block_no"
    epoch: str | None = "epoch_no"
    #: table that has the epoch's tip; the root where not given
    epoch_root: str | None = None
    value_columns: tuple[str, ...] = ()
    #: table -> its surrogate key, ``id`` where not given
    surrogates: Mapping[str, str] = field(default_factory=dict)
    #: double column -> decimal places to which it is rounded before hashing; others keep full precision
    scales: Mapping[str, int] = field(default_factory=dict)
    #: columns that may legitimately differ, by table
    ignored: Mapping[str, frozenset[str]] = field(default_factory=dict)

    def surrogate(self, table: str) -> str:
        return self.surrogates.get(table, "id")

    def target(self, table: str, column: str) -> str | None:
        """The table that a column points to; what is known of the table goes before the column's name."""
        return self.table_keys.get((table, column)) or self.foreign_keys.get(column)

    def points_somewhere(self, table: str, column: str) -> bool:
        """Whether a column looks like a foreign key that nobody registered."""
        return column != self.surrogate(table) and column.endswith("_id")

    def anchor(self, table: str) -> Anchor:
        return self.anchors.get(table, WHOLE)
