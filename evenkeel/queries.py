"""The comparison engine's queries over the star tables, each with its DuckDB SQL.

Side A is the tables as they are; side B is derived: every surrogate and foreign key is
shifted, and each query makes its own edits. Sums of digest parts are given as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.canonical import digest_part, row_digest, set_hash_columns, set_hash_sums
from evenkeel.operators.bounds import boundary_ids, common_cutoff, edges, exact_bound, spine_ranges, tip
from evenkeel.operators.compare import Comparison, Options, compare, judged, status_counts
from evenkeel.operators.localize import Difference, aligned, localize_bisect, localize_buckets
from evenkeel.operators.setsum import set_hash
from evenkeel.operators.verify import EXAMPLES, compare_keys, duplicated_keys, key_text, multiset_difference, orphan_counts, row_difference, verify_accumulator
from evenkeel.plans.planner import TablePlan, hashed_rows, plan_table
from evenkeel.plans.star import SHIFT, shifted, star_registry, star_side
from evenkeel.sources.snapshot import Snapshot, spread
from evenkeel.streaming.windows import windowed_set_hash

REGISTRY = star_registry()
Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL of canonical rows -------------------------------------------------------------

_TEXT, _MONEY, _TIME = "{}::varchar", "cast({} as decimal(20,2))::varchar", "epoch_us({})::varchar"
_MONIES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
_TIMES = {"o_orderdate", "l_shipdate", "ts"}
_COLUMNS = {
    "region": "r_name r_regionkey",
    "nation": "n_name n_nationkey n_regionkey",
    "customer": "c_acctbal c_custkey c_mktsegment c_name c_nationkey",
    "supplier": "s_acctbal s_name s_nationkey s_suppkey",
    "part": "p_brand p_name p_partkey p_retailprice p_size p_type",
    "orders": "o_custkey o_orderdate o_orderkey o_orderpriority o_orderstatus o_totalprice",
    "lineitem": "l_discount l_extendedprice l_linenumber l_linestatus l_orderkey l_partkey l_quantity l_returnflag l_shipdate l_suppkey l_tax",
    "events": "event_id event_type props ts user_id value",
}


def _text(expr: str) -> str:
    column = expr.rpartition(".")[2]
    return (_MONEY if column in _MONIES else _TIME if column in _TIMES else _TEXT).format(expr)


def _digest(exprs: str) -> str:
    """MD5 of the length-prefixed texts of blank-separated expressions."""
    parts = [f"coalesce(length({_text(e)})::varchar || ':' || {_text(e)}, 'N')" for e in exprs.split()]
    return f"md5({' || '.join(parts)})"


_SUMS = "count(*) as n, coalesce(sum(('0x' || substr(h, 1, 15))::bigint), 0)::varchar as s1, coalesce(sum(('0x' || substr(h, 17, 15))::bigint), 0)::varchar as s2"

#: What the plans hash of each table, with the joins that translate its keys.
_HASHED = {
    "region": ("t.r_name", "region t"),
    "nation": ("t.n_name r.r_name", "nation t left join region r on t.n_regionkey = r.r_regionkey"),
    "customer": ("t.c_acctbal t.c_mktsegment t.c_name n.n_name", "customer t left join nation n on t.c_nationkey = n.n_nationkey"),
    "supplier": ("t.s_acctbal t.s_name n.n_name", "supplier t left join nation n on t.s_nationkey = n.n_nationkey"),
    "part": ("t.p_brand t.p_name t.p_retailprice t.p_size t.p_type", "part t"),
    "orders": ("t.o_orderkey c.c_name t.o_orderdate t.o_orderpriority t.o_orderstatus t.o_totalprice", "orders t left join customer c on t.o_custkey = c.c_custkey"),
    "lineitem": (
        "t.l_discount t.l_extendedprice t.l_linenumber t.l_linestatus c.c_name o.o_orderkey t.l_quantity t.l_returnflag t.l_shipdate s.s_name t.l_tax",
        "lineitem t left join orders o on t.l_orderkey = o.o_orderkey left join customer c on o.o_custkey = c.c_custkey left join supplier s on t.l_suppkey = s.s_suppkey",
    ),
    "events": ("t.day t.event_type t.props t.ts t.value", "(select *, date_diff('day', date '1970-01-01', ts::date) as day from events) t"),
}
_GIANT_LINEITEM = (
    "t.l_discount t.l_extendedprice t.l_linenumber t.l_linestatus t.l_quantity t.l_returnflag t.l_shipdate s.s_name t.l_tax",
    "lineitem t left join supplier s on t.l_suppkey = s.s_suppkey",
)


def _hash_sql(hashed: tuple[str, str], where: str = "true") -> str:
    exprs, tables = hashed
    return f"select {_SUMS} from (select {_digest(exprs)} as h from {tables} where {where})"


def _as_text(hashes: DataFrame) -> DataFrame:
    return hashes.withColumns({c: F.col(c).cast("string") for c in ("s1", "s2")})


def _plan(a: Snapshot, b: Snapshot, table: str, *, full: bool = True, depth: int = 1) -> TablePlan:
    return plan_table(table, a, b, REGISTRY, full=full, giant_depth=depth)


# --- digests and set-hashes ------------------------------------------------------------


def _all_columns(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.withColumn("digest", row_digest([(F.col(c), kinds[c]) for c in sorted(rows.columns)], [REGISTRY.scales.get(c) for c in sorted(rows.columns)])).withColumn("value", F.lit(None).cast("decimal(38,6)"))


@_query("row_digest", f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, {_digest(_COLUMNS['lineitem'])} as digest from lineitem")
def _row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_columns(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "digest")


@_query("digest_chunks", f"select o_orderkey, (('0x' || substr(h, 1, 15))::bigint)::varchar as part1, (('0x' || substr(h, 17, 15))::bigint)::varchar as part2 from (select o_orderkey, {_digest(_COLUMNS['orders'])} as h from orders)")
def _digest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _all_columns(spark, sf_dir, "orders")
    return rows.select("o_orderkey", *(digest_part(F.col("digest"), at).cast("string").alias(name) for at, name in ((1, "part1"), (17, "part2"))))


def _whole(table: str) -> Query:
    return lambda spark, sf_dir: _as_text(set_hash(_all_columns(spark, sf_dir, table)))


def _translated(table: str, full: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = star_side(spark, sf_dir)
        return _as_text(set_hash(hashed_rows(_plan(a, a, table, full=full), a, REGISTRY)))

    return run


for _table, _columns in _COLUMNS.items():
    _query(f"set_hash_{_table}", f"select {_SUMS} from (select {_digest(_columns)} as h from {_table})")(_whole(_table))
for _table in ("nation", "customer", "supplier", "orders", "events"):
    _query(f"set_hash_translated_{_table}", _hash_sql(_HASHED[_table]))(_translated(_table))
_query("full_lineitem", _hash_sql(_HASHED["lineitem"]))(_translated("lineitem"))
_query("depth_limited_lineitem", _hash_sql(_GIANT_LINEITEM))(_translated("lineitem", full=False))

# --- sides and verdicts ----------------------------------------------------------------

_TIP = "(select 9 * max(o_orderkey) // 10 from orders)"


def _tip_gap(a: Snapshot) -> int:
    return 9 * a["orders"].agg(F.max("o_orderkey")).first()[0] // 10


def _two_sides(spark: SparkSession, sf_dir: str, edits: dict | None = None) -> tuple[Snapshot, Snapshot]:
    a = star_side(spark, sf_dir)
    return a, shifted(a, edits)


def _both(a: Snapshot, b: Snapshot, plan: TablePlan, limits: tuple = (True, True)) -> DataFrame:
    """(kind, n1, n2, a1, a2, b1, b2, v1, v2): the hashes of both sides in one row."""
    with_values = plan.value_column is not None
    sides = []
    for k, (side, limit) in enumerate(zip((a, b), limits, strict=True), 1):
        h = _as_text(set_hash(hashed_rows(plan, side, REGISTRY, limit), values=with_values))
        v = F.concat_ws(",", "v_sum", "v_min", "v_max") if with_values else F.lit(None).cast("string")
        sides.append(h.select(F.lit(1).alias("one"), F.col("n").alias(f"n{k}"), F.col("s1").alias(f"a{k}"), F.col("s2").alias(f"b{k}"), v.alias(f"v{k}")))
    return sides[0].join(sides[1], "one").drop("one").withColumn("kind", F.lit(plan.kind))


def _verdict(name: str, table: str, sql2: str, edits: Callable[[Snapshot], dict] = lambda a: {}, limit: Callable[[Snapshot, Snapshot], tuple] = lambda a, b: (True, True), sql1: str | None = None, full: bool = True) -> None:
    """A query of (n1, n2, status), and SQL made of both sides' hashes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = star_side(spark, sf_dir)
        b = shifted(a, edits(a))
        return judged(_both(a, b, _plan(a, b, table, full=full), limit(a, b))).select("n1", "n2", "status")

    one = sql1 or _hash_sql(_HASHED[table])
    sql = (
        f"select x.n as n1, y.n as n2, case when (x.n = 0) <> (y.n = 0) or x.n <> y.n then 'COUNT_DIFF' when x.s1 <> y.s1 or x.s2 <> y.s2 then 'HASH_DIFF' else 'MATCH' end as status "
        f"from ({one}) x, ({sql2}) y"
    )
    _query(name, sql)(run)


def _edited(table: str, change: str, where: str = "true") -> str:
    """SQL of a table's hash after ``change`` (a select list's replacement)."""
    exprs, tables = _HASHED[table]
    return _hash_sql((exprs, tables.replace(f"{table} t", f"(select * replace ({change}) from {table}) t")), where)


_Q = "case when l_orderkey % 997 = 0 then l_quantity + 1 else l_quantity end as l_quantity"


def _more_quantity(every: int = 997) -> Callable[[DataFrame], DataFrame]:
    return lambda t: t.withColumn("l_quantity", F.when((F.col("l_orderkey") - SHIFT) % every == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))


_verdict("drift_match", "lineitem", _hash_sql(_HASHED["lineitem"]))
_verdict("drift_match_orders", "orders", _hash_sql(_HASHED["orders"]))
_verdict("value_fault", "lineitem", _edited("lineitem", _Q), lambda a: {"lineitem": _more_quantity()})
_verdict("duplicate_rows", "part", f"select {_SUMS} from (select {_digest(_HASHED['part'][0])} as h from part t union all select {_digest(_HASHED['part'][0])} from part t where p_partkey % 10 = 0)", lambda a: {"part": lambda t: t.unionByName(t.where((F.col("p_partkey") - SHIFT) % 10 == 0))})
_verdict("orphan_fk", "orders", _edited("orders", "case when o_custkey % 7 = 0 then -1 else o_custkey end as o_custkey"), lambda a: {"orders": lambda t: t.withColumn("o_custkey", F.when((F.col("o_custkey") - SHIFT) % 7 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))})
_verdict("one_side_empty", "supplier", _hash_sql(_HASHED["supplier"], "false"), lambda a: {"supplier": lambda t: t.where(F.lit(False))})
_verdict(
    "tip_gap_bounded", "orders", _hash_sql(_HASHED["orders"], f"t.o_orderkey <= {_TIP}"), lambda a: {"orders": lambda t: t.where(F.col("o_block") <= _tip_gap(a))},
    lambda a, b: tuple(F.col("o_orderkey").between(*spine_ranges(s, REGISTRY, common_cutoff(tip(a, REGISTRY), tip(b, REGISTRY)).block)["orders"]) for s in (a, b)), sql1=_hash_sql(_HASHED["orders"], f"t.o_orderkey <= {_TIP}"),
)
_verdict("tip_gap_unbounded", "orders", _hash_sql(_HASHED["orders"], f"t.o_orderkey <= {_TIP}"), lambda a: {"orders": lambda t: t.where(F.col("o_block") <= _tip_gap(a))})


@_query("null_vs_empty", f"select x.n as n1, y.n as n2, case when x.s1 = y.s1 and x.s2 = y.s2 then 'MATCH' else 'HASH_DIFF' end as status from ({_edited('customer', "'' as c_mktsegment")}) x, ({_edited('customer', "case when c_custkey % 5 = 0 then null else '' end as c_mktsegment")}) y")
def _null_vs_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    empty = lambda t: t.withColumn("c_mktsegment", F.lit(""))
    some = lambda t: t.withColumn("c_mktsegment", F.when((F.col("c_custkey") - SHIFT) % 5 == 0, F.lit(None)).otherwise(F.lit("")))
    one, two = Snapshot("a", a.tables | {"customer": empty(a["customer"])}), shifted(a, {"customer": some})
    return judged(_both(one, two, _plan(one, two, "customer"))).select("n1", "n2", "status")


@_query("shared_columns_hash", f"select x.n as n1, y.n as n2, x.s1 = y.s1 and x.s2 = y.s2 as same, 'p_extra' as only_db2, 'p_size' as only_db1 from ({_hash_sql(('t.p_brand t.p_name t.p_retailprice t.p_type', 'part t'))}) x, ({_hash_sql(('t.p_brand t.p_name t.p_retailprice t.p_type', 'part t'))}) y")
def _shared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sides(spark, sf_dir, {"part": lambda t: t.drop("p_size").withColumn("p_extra", F.lit(1))})
    plan = _plan(a, b, "part")
    return _both(a, b, plan).select("n1", "n2", ((F.col("a1") == F.col("a2")) & (F.col("b1") == F.col("b2"))).alias("same"), F.lit(plan.drift["only_db2"][0]).alias("only_db2"), F.lit(plan.drift["only_db1"][0]).alias("only_db1"))


@_query("unmapped_fk_dropped", "select 'user_id (UNMAPPED FK -> excluded)' as skipped, count(*) as n from events")
def _unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    plan = _plan(a, a, "events")
    return set_hash(hashed_rows(plan, a, REGISTRY)).select(F.lit(plan.skipped[0]).alias("skipped"), "n")


def _proof(table: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = star_side(spark, sf_dir)
        found = set_hash(hashed_rows(_plan(a, a, table), a, REGISTRY), values=True)
        return found.select(*(F.col(f"v_{k}").cast("decimal(38,2)").cast("string").alias(f"v_{k}") for k in ("sum", "min", "max")))

    sql = ", ".join(f"{k}(cast({column} as decimal(20,2)))::varchar as v_{k}" for k in ("sum", "min", "max"))
    _query(f"value_proof_{table}", f"select {sql} from {table}")(run)


_proof("lineitem", "l_extendedprice")
_proof("orders", "o_totalprice")

# --- bounds ----------------------------------------------------------------------------

_DAY = "date_diff('day', date '1970-01-01', max(ts)::date)"


@_query("tips_and_cutoff", f"select o.m as block1, {_TIP} as block2, e.d as epoch1, e.d as epoch2, greatest(0, {_TIP} - 100) as cutoff_block, greatest(0, e.d - 2) as cutoff_epoch from (select max(o_orderkey) as m from orders) o, (select {_DAY} as d from events) e")
def _tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    b = shifted(a, {"orders": lambda t: t.where(F.col("o_block") <= _tip_gap(a))})
    x, y = tip(a, REGISTRY), tip(b, REGISTRY)
    cut = common_cutoff(x, y, block_margin=100)
    return spark.createDataFrame([(x.block, y.block, x.epoch, y.epoch, cut.block, cut.epoch)], "block1 long, block2 long, epoch1 long, epoch2 long, cutoff_block long, cutoff_epoch long")


def _tip_ranges(window: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = _two_sides(spark, sf_dir)
        cut = _tip_gap(a)
        rows = [(name, *spine_ranges(side, REGISTRY, cut, (cut // 9, cut) if window else None)["orders"]) for name, side in (("a", a), ("b", b))]
        return spark.createDataFrame(rows, "side string, low long, high long")

    return run


_query("spine_window_cutoff_tip", f"select 'a' as side, 0::bigint as low, max(o_orderkey) as high from orders where o_orderkey <= {_TIP} union all select 'b', 0, max(o_orderkey) + {SHIFT} from orders where o_orderkey <= {_TIP}")(_tip_ranges(False))
_query("spine_window_block_range_tip", f"select 'a' as side, min(o_orderkey) as low, max(o_orderkey) as high from orders where o_orderkey between {_TIP} // 9 and {_TIP} union all select 'b', min(o_orderkey) + {SHIFT}, max(o_orderkey) + {SHIFT} from orders where o_orderkey between {_TIP} // 9 and {_TIP}")(_tip_ranges(True))


@_query("epoch_bounded_events", _hash_sql(_HASHED["events"], f"t.day <= (select {_DAY} - 2 from events)"))
def _epoch_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    cut = common_cutoff(tip(a, REGISTRY), tip(a, REGISTRY))
    return _as_text(set_hash(hashed_rows(_plan(a, a, "events"), a, REGISTRY, F.col("day") <= cut.epoch)))


@_query("exact_bounding_tip", _hash_sql(_HASHED["lineitem"], f"t.l_orderkey <= {_TIP}"))
def _exact_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    plan = _plan(a, a, "lineitem")
    return _as_text(set_hash(hashed_rows(plan, exact_bound(a, REGISTRY, plan, _tip_gap(a)), REGISTRY)))


_TIP_EDGES = f"(select unnest(range(0, cut + 1, greatest(1, cut // 16))) as edge from (select {_TIP} as cut) union select {_TIP})"


@_query("boundary_ids_tip", f"select edge::bigint as edge, min(o_orderkey) as first_id from {_TIP_EDGES} e left join orders on o_orderkey >= edge group by edge")
def _boundaries_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    at = edges(_tip_gap(a), 16)
    return spark.createDataFrame(list(zip(at, boundary_ids(a, REGISTRY, "orders", at), strict=True)), "edge long, first_id long")


@_query("align_boundaries_tip", f"with f as (select edge, min(o_orderkey) as x, min(case when o_orderkey % 200 >= 100 then o_orderkey end) + {SHIFT} as y from {_TIP_EDGES} e join orders on o_orderkey >= edge group by edge) select min(edge)::bigint as edge, y from f where y is not null group by y")
def _align_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    b = shifted(a, {"orders": lambda t: t.where(F.col("o_block") % 200 >= 100)})
    at = edges(_tip_gap(a), 16)
    kept, _, second = aligned(at, *(boundary_ids(s, REGISTRY, "orders", at) for s in (a, b)))
    return spark.createDataFrame(list(zip(kept, second, strict=True)), "edge long, y long")


# --- buckets and localization ----------------------------------------------------------


@_query("bucketed_hash_events", f"select day, {_SUMS} from (select t.day, {_digest(_HASHED['events'][0])} as h from {_HASHED['events'][1]}) group by day")
def _bucketed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    return _as_text(set_hash(hashed_rows(_plan(a, a, "events"), a, REGISTRY, True, {"day": F.col("day")}), "day"))


@_query("bucketed_hash_lineitem", f"select l_orderkey // 50 as bucket, {_SUMS} from (select l_orderkey, {_digest(_HASHED['lineitem'][0])} as h from {_HASHED['lineitem'][1]}) group by 1")
def _bucketed_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    return _as_text(set_hash(hashed_rows(_plan(a, a, "lineitem"), a, REGISTRY, True, {"bucket": F.floor(F.col("l_orderkey") / 50)}), "bucket"))


@_query("hash_tree_rollup", f"select l_orderkey // 400 as upper, l_orderkey // 50 as lower, {_SUMS} from (select l_orderkey, {_digest(_HASHED['lineitem'][0])} as h from {_HASHED['lineitem'][1]}) group by rollup (1, 2)")
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    rows = hashed_rows(_plan(a, a, "lineitem"), a, REGISTRY, True, {"upper": F.floor(F.col("l_orderkey") / 400), "lower": F.floor(F.col("l_orderkey") / 50)})
    return _as_text(rows.rollup("upper", "lower").agg(*set_hash_sums("digest")).select("upper", "lower", *set_hash_columns()))


_FAULTS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "value": (_more_quantity(), f"select * replace ({_Q}) from lineitem"),
    "drop": (lambda t: t.where((F.col("l_orderkey") - SHIFT) % 997 != 0), "select * from lineitem where l_orderkey % 997 <> 0"),
    "insert": (lambda t: t.unionByName(t.where((F.col("l_orderkey") - SHIFT) % 997 == 0)), "select * from lineitem union all select * from lineitem where l_orderkey % 997 = 0"),
}


def _windows_sql(fault: str, windows: str, limit: str = "") -> str:
    exprs, tables = _HASHED["lineitem"]
    side = lambda table: f"select w.low, w.high, {_SUMS} from (select t.l_orderkey as k, {_digest(exprs)} as h from {tables.replace('lineitem t', f'({table}) t')}) join windows w on k between w.first and w.last group by 1, 2"
    return (
        f"with recursive {windows}, a as ({side('select * from lineitem')}), b as ({side(_FAULTS[fault][1])}) "
        "select coalesce(a.low, b.low)::bigint as low, coalesce(a.high, b.high)::bigint as high, coalesce(a.n, 0) as n1, coalesce(b.n, 0) as n2, "
        "case when coalesce(a.n, 0) = coalesce(b.n, 0) then 'content differs' else 'row count differs' end as what "
        f"from a full join b on a.low = b.low and a.high = b.high where a.n is distinct from b.n or a.s1 is distinct from b.s1 or a.s2 is distinct from b.s2 order by low {limit}"
    )


_CUT = "(select max(o_orderkey) from orders)"
_BUCKETS = (
    f"c as (select {_CUT} as cut, greatest(1, {_CUT} // 64) as w), e as (select unnest(range(0, cut + 1, w)) as edge from c union select cut from c), "
    "p as (select edge as low, lead(edge) over (order by edge) as following from e), "
    "windows as (select low, coalesce(following, (select cut from c)) as high, low as first, coalesce(following - 1, (select cut from c)) as last from p)"
)
_LEAVES = (
    f"tree(low, high) as (select 0::bigint, {_CUT}::bigint union all select case when right_half then (low + high) // 2 + 1 else low end, case when right_half then high else (low + high) // 2 end "
    "from tree, (values (false), (true)) v(right_half) where high - low > 100), windows as (select low, high, low as first, high as last from tree where high - low <= 100)"
)


def _rows(spark: SparkSession, found: list[Difference]) -> DataFrame:
    rows = [(d.low, d.high, d.n1, d.n2, "content differs" if d.n1 == d.n2 else "row count differs") for d in found]
    return spark.createDataFrame(rows, "low long, high long, n1 long, n2 long, what string")


def _localized(fault: str, how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = _two_sides(spark, sf_dir, {"lineitem": _FAULTS[fault][0]})
        plan, cut = _plan(a, b, "lineitem"), tip(a, REGISTRY).block
        if how == "buckets":
            return _rows(spark, localize_buckets(plan, a, b, REGISTRY, cut, buckets=64))
        return _rows(spark, localize_bisect(plan, a, b, REGISTRY, 0, cut, cut, None, width=100))

    return run


for _fault in _FAULTS:
    _query(f"localize_buckets_{_fault}", _windows_sql(_fault, _BUCKETS))(_localized(_fault, "buckets"))
_query("localize_bisect_value", _windows_sql("value", _LEAVES, "limit 8"))(_localized("value", "bisect"))


@_query("localize_bisect_epoch", f"select day::bigint as low, day::bigint as high, count(*) as n1, count(*) - count(*) filter (event_id % 501 = 0) as n2, 'row count differs' as what from {_HASHED['events'][1]} group by day having count(*) filter (event_id % 501 = 0) > 0 order by day limit 8")
def _bisect_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sides(spark, sf_dir, {"events": lambda t: t.where((F.col("event_id") - SHIFT) % 501 != 0)})
    last = tip(a, REGISTRY).epoch
    return _rows(spark, localize_bisect(_plan(a, b, "events"), a, b, REGISTRY, 0, last, 0, last))


# --- keys and rows ---------------------------------------------------------------------


def _verified(name: str, edit: Callable[[DataFrame], DataFrame], table: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = _two_sides(spark, sf_dir, {"customer": edit})
        one, two = (s["customer"].select(key_text(s, REGISTRY, "customer").alias("k")) for s in (a, b))
        found = compare_keys(one, two)
        case = F.when((F.col("only_db1") == 0) & (F.col("only_db2") == 0), "identical").when(F.col("only_db2") == 0, "superset").when(F.col("only_db1") == 0, "subset").otherwise("neither")
        return found.withColumn("verdict", case)

    sql = (
        "with x as (select c_name as k, count(*) as c from customer group by 1), "
        f"y as (select c_name as k, count(*) as c from ({table}) group by 1), "
        "z as (select sum(greatest(coalesce(x.c, 0) - coalesce(y.c, 0), 0))::bigint as only_db1, sum(greatest(coalesce(y.c, 0) - coalesce(x.c, 0), 0))::bigint as only_db2, sum(least(coalesce(x.c, 0), coalesce(y.c, 0)))::bigint as \"both\" from x full join y using (k)) "
        "select *, case when only_db1 = 0 and only_db2 = 0 then 'identical' when only_db2 = 0 then 'superset' when only_db1 = 0 then 'subset' else 'neither' end as verdict from z"
    )
    _query(name, sql)(run)


def _number():
    return F.col("c_custkey") - SHIFT


_verified("verify_identical", lambda t: t, "select * from customer")
_verified("verify_superset", lambda t: t.where(_number() % 9 != 0), "select * from customer where c_custkey % 9 <> 0")
_verified("verify_neither", lambda t: t.withColumn("c_name", F.when(_number() % 9 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))), "select * replace (case when c_custkey % 9 = 0 then c_name || 'x' else c_name end as c_name) from customer")
_verified("verify_duplicates", lambda t: t.unionByName(t.where(_number() % 9 == 0)), "select * from customer union all select * from customer where c_custkey % 9 = 0")


@_query("multiset_diff", f"with x as (select r_name, n_name from nation join region on n_regionkey = r_regionkey), y as (select r_name, n_name from x where n_name not like '%7' union all select r_name, n_name from x where n_name like '%3') select *, 1 as side from (select * from x except all select * from y) union all select *, 2 as side from (select * from y except all select * from x)")
def _multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = star_side(spark, sf_dir)
    x = a["nation"].join(a["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    return multiset_difference(x, x.where(~F.col("n_name").like("%7")).unionByName(x.where(F.col("n_name").like("%3"))))


@_query("row_difference", f"select h as digest, sum(c)::bigint as surplus from (select h, 1 as c from (select {_digest(_HASHED['lineitem'][0])} as h from {_HASHED['lineitem'][1]}) union all select h, -1 from (select {_digest(_HASHED['lineitem'][0])} as h from {_HASHED['lineitem'][1].replace('lineitem t', f'({_FAULTS["value"][1]}) t')})) group by h having sum(c) <> 0")
def _row_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sides(spark, sf_dir, {"lineitem": _more_quantity()})
    plan = _plan(a, b, "lineitem")
    return row_difference(plan, *(hashed_rows(plan, s, REGISTRY) for s in (a, b)))


@_query("duplicate_keys", f"select c_custkey + {SHIFT} as key, 2::bigint as n from customer where c_custkey % 11 = 0")
def _duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, b = _two_sides(spark, sf_dir, {"customer": lambda t: t.unionByName(t.where(_number() % 11 == 0))})
    return duplicated_keys(b, REGISTRY, "customer")


@_query("orphan_counts", "select 'o_custkey' as \"column\", count(*) filter (o_custkey % 13 = 0)::bigint as nulls, count(*) filter (o_custkey % 13 <> 0 and o_custkey % 7 = 0)::bigint as orphans from orders")
def _orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_custkey") - SHIFT
    edit = lambda t: t.withColumn("o_custkey", F.when(number % 13 == 0, F.lit(None)).when(number % 7 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))
    a, b = _two_sides(spark, sf_dir, {"orders": edit})
    return orphan_counts(_plan(a, b, "orders"), b, REGISTRY)


# --- whole runs ------------------------------------------------------------------------

#: What _whole_run does to the tables of B, as SQL.
_RUN_EDITS = {
    "customer": "select * from customer where c_custkey % 9 <> 0",
    "supplier": "select * from supplier where false",
    "part": "select * replace (case when p_partkey = 1 then p_size + 1 else p_size end as p_size) from part",
    "orders": f"select * from orders where o_orderkey <= {_TIP}",
    "lineitem": "select * replace (case when l_orderkey % 7 = 0 then l_quantity + 1 else l_quantity end as l_quantity) from lineitem",
    "events": "select * from events where event_id % 501 <> 0",
}
_RUN_KINDS = {"region": "accumulator", "nation": "accumulator", "customer": "accumulator", "supplier": "accumulator", "part": "accumulator", "orders": "normal", "lineitem": "giant", "events": "normal"}
_RUN_BOUNDS = {"orders": f"t.o_orderkey <= {_TIP}", "lineitem": f"t.l_orderkey <= {_TIP}", "events": f"t.day <= (select {_DAY} - 2 from events)"}


def _run_sql(bounds: dict[str, str]) -> str:
    """(table_name, kind, status, n1, n2) of a run over both sides, from their hashes."""
    rows = []
    for table, kind in _RUN_KINDS.items():
        exprs, tables = _GIANT_LINEITEM if kind == "giant" else _HASHED[table]
        other = re.sub(rf"\b({'|'.join(_RUN_EDITS)})\b(?=[ )])", lambda m: f"({_RUN_EDITS[m[0]]})", tables)
        one, two = (_hash_sql((exprs, t), bounds.get(table, "true")) for t in (tables, other))
        rows.append(
            f"select '{table}' as table_name, '{kind}' as kind, case when x.n <> y.n then 'COUNT_DIFF' when x.s1 <> y.s1 or x.s2 <> y.s2 then 'HASH_DIFF' else 'MATCH' end as status, x.n as n1, y.n as n2 from ({one}) x, ({two}) y"
        )
    return " union all ".join(rows)


def _run_sides(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    a = star_side(spark, sf_dir)
    return a, shifted(
        a,
        {
            "customer": lambda t: t.where(_number() % 9 != 0),
            "supplier": lambda t: t.where(F.lit(False)),
            "part": lambda t: t.withColumn("p_size", F.when(F.col("p_partkey") == SHIFT + 1, F.col("p_size") + 1).otherwise(F.col("p_size"))),
            "orders": lambda t: t.where(F.col("o_block") <= _tip_gap(a)),
            "lineitem": _more_quantity(7),
            "events": lambda t: t.where((F.col("event_id") - SHIFT) % 501 != 0),
        },
    )


def _verdicts(spark: SparkSession, run: Comparison) -> DataFrame:
    rows = [(r.name, r.kind, r.status, r.hash1.n, r.hash2.n) for r in run.results]
    return spark.createDataFrame(rows, "table_name string, kind string, status string, n1 long, n2 long")


@_query("compare_all", _run_sql(_RUN_BOUNDS))
def _compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, compare(*_run_sides(spark, sf_dir), REGISTRY, Options(localize=None)))


_WINDOW = {"orders": f"t.o_orderkey between {_TIP} // 3 and {_TIP} // 2", "lineitem": f"t.l_orderkey between {_TIP} // 3 and {_TIP} // 2"}


@_query("compare_window", f"select table_name, kind, case when table_name in ('orders', 'lineitem') then status else 'SKIPPED' end as status, case when table_name in ('orders', 'lineitem') then n1 else 0 end as n1, case when table_name in ('orders', 'lineitem') then n2 else 0 end as n2 from ({_run_sql(_WINDOW)})")
def _compare_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _run_sides(spark, sf_dir)
    cut = _tip_gap(a)
    return _verdicts(spark, compare(a, b, REGISTRY, Options(window=(cut // 3, cut // 2))))


@_query("compare_localized", f"select 'lineitem' as table_name, * from ({_windows_sql('value', _BUCKETS)})")
def _compare_localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sides(spark, sf_dir, {"lineitem": _more_quantity()})
    run = compare(a, b, REGISTRY, Options(full=True, localize="buckets", buckets=64, tables=("nation", "orders", "lineitem")))
    rows = [(r.name, d.low, d.high, d.n1, d.n2, "content differs" if d.n1 == d.n2 else "row count differs") for r in run.results for d in r.localized]
    return spark.createDataFrame(rows, "table_name string, low long, high long, n1 long, n2 long, what string")


_OUTCOMES = "case when status = 'MATCH' then 'match' when status = 'COUNT_DIFF' and kind = 'accumulator' then 'accumulator_deltas' else 'discrepancies' end"


@_query("summary_counts", f"with r as ({_run_sql(_RUN_BOUNDS)}) select o.outcome, count(r.table_name)::bigint as tables from (values ('match'), ('discrepancies'), ('accumulator_deltas'), ('errors'), ('skipped')) o(outcome) left join r on {_OUTCOMES} = o.outcome group by 1")
def _summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = compare(*_run_sides(spark, sf_dir), REGISTRY, Options(localize=None))
    return spark.createDataFrame(list(status_counts(run.results).items()), "outcome string, tables long")


@_query("verdict_ladder", "select * from (values (1, 'COUNT_DIFF'), (2, 'COUNT_DIFF'), (3, 'HASH_DIFF'), (4, 'HASH_DIFF'), (5, 'VALUE_DIFF'), (6, 'MATCH'), (7, 'MATCH'), (8, 'COUNT_DIFF')) v(scenario, status)")
def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (1, "normal", 0, 5, "0", "1", "0", "1", None, None), (2, "normal", 4, 5, "1", "1", "1", "1", "3", "3"), (3, "normal", 5, 5, "1", "2", "1", "1", "3", "3"), (4, "accumulator", 5, 5, "1", "1", "1", "2", None, None),
        (5, "giant", 5, 5, "1", "1", "1", "1", "3", "4"), (6, "giant", 5, 5, "1", "1", "1", "1", "3", "3"), (7, "normal", 0, 0, "0", "0", "0", "0", None, None), (8, "accumulator", 4, 5, "1", "2", "1", "2", None, None),
    ]
    table = spark.createDataFrame(rows, "scenario int, kind string, n1 long, n2 long, a1 string, a2 string, b1 string, b2 string, v1 string, v2 string")
    return judged(table).select("scenario", "status")


@_query("windowed_hash_events", f"select epoch_us(date_trunc('day', ts)) as window_start, {_SUMS} from (select ts, {_digest('event_id event_type props ts user_id value')} as h from events) group by 1")
def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = windowed_set_hash(events, "ts", ["event_id", "event_type", "props", "ts", "user_id", "value"], scales=REGISTRY.scales)
    return _as_text(found).withColumn("window_start", F.unix_micros("window_start"))


def _key_sides(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    """Customers: A lacks every seventh, B every ninth, and B has every thirteenth twice."""
    a, b = _two_sides(spark, sf_dir, {"customer": lambda t: t.where(_number() % 9 != 0).unionByName(t.where(_number() % 13 == 0))})
    return Snapshot(a.label, a.tables | {"customer": a["customer"].where(F.col("c_custkey") % 7 != 0)}), b


_KEYS = (
    "x as (select c_name as k, count(*) as c from customer where c_custkey % 7 <> 0 group by 1), "
    "y as (select c_name as k, count(*) as c from (select * from customer where c_custkey % 9 <> 0 union all select * from customer where c_custkey % 13 = 0) group by 1), "
    "z as (select k, coalesce(x.c, 0) as cx, coalesce(y.c, 0) as cy from x full join y using (k))"
)


@_query(
    "verify_accumulator",
    f"with {_KEYS}, e as (select k, greatest(cx - cy, 0) as o1, greatest(cy - cx, 0) as o2, least(cx, cy) as b from z), t as (select sum(o1)::bigint as only_db1, sum(o2)::bigint as only_db2, sum(b)::bigint as \"both\" from e) "
    "select *, case when only_db1 = 0 and only_db2 = 0 then 'identical' when only_db2 = 0 then 'db2 ⊆ db1' when only_db1 = 0 then 'db1 ⊆ db2' else 'NEITHER' end as verdict from t",
)
def _verified_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify_accumulator(*_key_sides(spark, sf_dir), REGISTRY, "customer")
    head = next(x for x in ("identical", "db2 ⊆ db1", "db1 ⊆ db2", "NEITHER") if found["verdict"].startswith(x))
    return spark.createDataFrame([(found["only_db1"], found["only_db2"], found["both"], head)], "only_db1 long, only_db2 long, both long, verdict string")


@_query(
    "key_examples",
    f"with {_KEYS}, s as (select 1 as side, k, unnest(range(cx - cy)) as again from z where cx > cy union all select 2, k, unnest(range(cy - cx)) from z where cy > cx), "
    f"p as (select side, k, row_number() over (partition by side order by k) as place from s) select * from p where place <= {EXAMPLES}",
)
def _key_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify_accumulator(*_key_sides(spark, sf_dir), REGISTRY, "customer")
    rows = [(side, k, place) for side in (1, 2) for place, k in enumerate(found[f"examples_db{side}"], 1)]
    return spark.createDataFrame(rows, "side int, k string, place long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: lineitem against its shifted copy, with the verdict."""
    a, b = _two_sides(spark, sf_dir)
    return judged(_both(a, b, _plan(a, b, "lineitem")))
