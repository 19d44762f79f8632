"""One side of a comparison: named tables with what their schemas cannot say."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableFacts:
    """What Parquet does not record: key columns, columns the database generates, and declared foreign keys (column to table)."""

    primary_key: tuple[str, ...] = ()
    generated: frozenset[str] = frozenset()
    foreign_keys: Mapping[str, str] = field(default_factory=dict)


@dataclass
class Snapshot:
    """Tables by name, all of one independently built copy of a history."""

    label: str
    tables: dict[str, DataFrame]
    facts: dict[str, TableFacts] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def columns(self, name: str) -> list[str]:
        return self.tables[name].columns

    def generated(self, name: str) -> frozenset[str]:
        return self.facts.get(name, TableFacts()).generated

    def foreign_keys(self, name: str) -> Mapping[str, str]:
        return self.facts.get(name, TableFacts()).foreign_keys

    def has_primary_key(self, name: str, column: str) -> bool:
        return self.facts.get(name, TableFacts()).primary_key == (column,)

    @classmethod
    def from_frames(cls, label: str, tables: Mapping[str, DataFrame], facts: Mapping[str, TableFacts] | None = None) -> Snapshot:
        return cls(label, dict(tables), dict(facts or {}))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, names: list[str] | None = None, facts: Mapping[str, TableFacts] | None = None) -> Snapshot:
        """Every ``NAME.parquet`` (file or folder) below ``path``, which Spark alone needs to reach."""
        if names is None:
            jvm = spark.sparkContext._jvm
            top = jvm.org.apache.hadoop.fs.Path(path)
            listed = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)
            found = [s.getPath().getName() for s in listed]
            names = sorted(f.removesuffix(".parquet") for f in found if f.endswith(".parquet"))
        tables = {n: spark.read.parquet(f"{path.rstrip('/')}/{n}.parquet") for n in names}
        return cls(path.rstrip("/").rpartition("/")[2], tables, dict(facts or {}))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, facts: Mapping[str, TableFacts] | None = None) -> Snapshot:
        """The base tables of a catalog database; views are left out."""
        listed = [t.name for t in spark.catalog.listTables(database) if t.tableType in ("MANAGED", "EXTERNAL")]
        return cls(database, {n: spark.table(f"`{database}`.`{n}`") for n in sorted(listed)}, dict(facts or {}))

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, names: list[str], *, partition_column: str = "id", partitions: int = 16, facts: Mapping[str, TableFacts] | None = None, **options: str) -> Snapshot:
        """Tables of a database by JDBC, with what it declares of their keys.

        A table with a whole-numbered ``partition_column`` is read in ``partitions`` ranges
        between its least and greatest value, which the database is asked for. ``options``
        are the JDBC reader's, ``user`` and ``password`` among them.
        """

        def reader(query: str) -> DataFrame:
            return spark.read.format("jdbc").option("url", url).option("dbtable", query).options(**options).load()

        def opened(name: str) -> DataFrame:
            table = reader(name)
            column = next((c for c, kind in table.dtypes if c.lower() == partition_column.lower() and kind in ("int", "bigint")), None)
            if column is None or partitions < 2:
                return table
            # one row, computed by the database
            ends = reader(f"(select min({column}) as low, max({column}) as high from {name}) ends").first()
            if ends[0] is None:
                return table
            cut = {"partitionColumn": column, "lowerBound": str(int(ends[0])), "upperBound": str(int(ends[1]) + 1), "numPartitions": str(partitions)}
            return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).options(**cut).load()

        return cls(jdbc_label(url), {n: opened(n) for n in names}, dict(facts if facts is not None else jdbc_facts(spark, url, names, options)))


#: Bytes below which a table is not worth dealing out.
SMALL = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out to all cores if they are read in fewer parts.

    A large row group is read by one task whatever the number of cores; what is computed
    for its rows afterwards need not be. Tables with as many parts as cores stay as they
    are, and so do those that are more than a scan, whose parts only running them would tell.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SMALL or re.search("Exchange|Adaptive", plan.executedPlan().toString()):
        return rows
    return rows.repartition(cores) if plan.toRdd().getNumPartitions() < cores else rows


def jdbc_facts(spark: SparkSession, url: str, names: list[str], options: Mapping[str, str]) -> dict[str, TableFacts]:
    """Primary keys, generated columns and declared foreign keys, from the database's own catalog."""
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for key, value in options.items():
        properties.setProperty(key, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)

    def listed(rows, *columns: str) -> list[tuple]:
        out = []
        while rows.next():
            out.append(tuple(rows.getString(c) for c in columns))
        rows.close()
        return out

    try:
        catalog = connection.getMetaData()
        upper = catalog.storesUpperCaseIdentifiers()
        facts = {}
        for name in names:
            stored = name.upper() if upper else name
            given = (lambda x: x.lower()) if upper else (lambda x: x)
            keys = listed(catalog.getPrimaryKeys(None, None, stored), "KEY_SEQ", "COLUMN_NAME")
            made = listed(catalog.getColumns(None, None, stored, None), "COLUMN_NAME", "IS_GENERATEDCOLUMN")
            links = listed(catalog.getImportedKeys(None, None, stored), "FKCOLUMN_NAME", "PKTABLE_NAME")
            facts[name] = TableFacts(tuple(given(c) for _, c in sorted(keys, key=lambda x: int(x[0]))), frozenset(given(c) for c, yes in made if yes == "YES"), {given(c): given(t) for c, t in links})
        return facts
    finally:
        connection.close()


def jdbc_label(url: str) -> str:
    """Database name, with the host if it is a network host; never user or password."""
    rest = url.partition("://")[2].partition("?")[0].partition(";")[0]
    host, _, name = rest.partition("/")
    return secret_free_label(name or None, host.rpartition("@")[2].partition(":")[0] or None)


def secret_free_label(name: str | None, host: str | None = None) -> str:
    """What a report calls a database: its name, and where it runs if that is a host and no socket's path."""
    known = [x for x in (name or "?", host) if x and not os.path.isabs(x)]
    return "@".join(known)
