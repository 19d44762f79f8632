"""Single parts: plans, digests, set-hashes, windows, keys, report and command line."""

import json
from decimal import Decimal

import pytest
from chain_pairs import rows, snapshot
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenkeel.cli import block_range, main, parser, read_settings
from evenkeel.functions.buckets import bucket_of
from evenkeel.functions.canonical import row_digest
from evenkeel.operators.compare import judge
from evenkeel.operators.localize import aligned, halved, localize_bisect
from evenkeel.operators.setsum import SetHash, set_hash
from evenkeel.operators.verify import anchor_warning, compare_keys, subset_verdict
from evenkeel.plans.chain import chain_registry
from evenkeel.plans.planner import explain, hashed_rows, plan_table
from evenkeel.queries import oracle_sql, queries
from evenkeel.sources.snapshot import Snapshot, TableFacts, jdbc_label, secret_free_label, spread
from evenkeel.streaming.windows import windowed_set_hash

REGISTRY = chain_registry()


def plan(spark, name, tables, full=False, facts=None):
    frames = {n: spark.createDataFrame([], s) for n, s in tables.items()}
    side = Snapshot.from_frames("x", frames, facts)
    return plan_table(name, side, side, REGISTRY, full=full)


WITHDRAWAL = {
    "withdrawal": "id long, addr_id long, amount decimal(20,0), redeemer_id long, tx_id long",
    "stake_address": "id long, hash_raw binary",
    "redeemer": "id long, tx_id long, purpose string, index int",
    "tx": "id long, hash binary",
}


def test_registry_is_closed():
    parts = [p for key in REGISTRY.natural_keys.values() for p in key if p.target]
    assert all(p.target in REGISTRY.natural_keys for p in parts)
    targets = set(REGISTRY.foreign_keys.values()) | set(REGISTRY.table_keys.values())
    assert all(t in REGISTRY.natural_keys or t in REGISTRY.excluded for t in targets)
    assert not REGISTRY.giants & REGISTRY.excluded.keys()
    assert (len(REGISTRY.excluded), len(REGISTRY.giants), len(REGISTRY.foreign_keys), len(REGISTRY.natural_keys), len(REGISTRY.anchors)) == (18, 13, 41, 23, 61)


def test_plans_translate_keys_in_name_order(spark):
    found = plan(spark, "withdrawal", WITHDRAWAL)
    assert [c for _, c in found.values] == ["hash_raw", "amount", "hash", "purpose", "index", "hash"]
    assert found.value_column == "amount" and found.kind == "normal" and found.anchor.spine == "tx"
    assert len(found.joins) == 4 and len({j.alias for j in found.joins}) == 4


def test_generated_and_unmapped_columns_are_left_out(spark):
    tables = WITHDRAWAL | {"withdrawal": WITHDRAWAL["withdrawal"] + ", gencol int, mystery_id long"}
    found = plan(spark, "withdrawal", tables, facts={"withdrawal": TableFacts(generated=frozenset({"gencol"}))})
    assert len(found.values) == 6 and found.skipped == ["mystery_id (UNMAPPED FK -> excluded)"]


def test_giants_follow_keys_one_step(spark):
    tables = {"ma_tx_out": "id long, ident long, quantity decimal(20,0), tx_out_id long", "multi_asset": "id long, policy binary, name binary", "tx_out": "id long, tx_id long, index int", "tx": "id long, hash binary"}
    tiered, full = plan(spark, "ma_tx_out", tables), plan(spark, "ma_tx_out", tables, full=True)
    assert tiered.kind == "giant" and len(tiered.values) == 3 and "tx_out_id->tx_out" in tiered.skipped
    assert full.kind == "normal" and len(full.values) == 5 and not full.skipped
    # what is not hashed is not joined
    assert [j.target for j in tiered.joins] == ["multi_asset"]
    assert "left join multi_asset" in "\n".join(explain(tiered))


def test_unknown_tables_are_compared_whole_and_text_is_no_value(spark):
    found = plan(spark, "novel", {"novel": "id long, value string"})
    assert found.kind == "accumulator" and found.value_column is None


@pytest.mark.parametrize("name", ["exact_bounding_tip", "boundary_ids_tip", "align_boundaries_tip", "spine_window_cutoff_tip", "spine_window_block_range_tip"])
def test_bounds_relative_to_the_tip_agree_with_their_sql(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "supplier"):
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    expected = db.execute(oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, queries()[name](spark, sf_dir).collect())) == sorted(expected)
    last = db.execute("select max(o_orderkey) from orders").fetchone()[0]
    if name.startswith("boundary"):
        assert max(x for x, _ in expected) >= 9 * last // 10
    if name.startswith("exact"):
        assert expected[0][0] > db.execute("select count(*) from lineitem").fetchone()[0] * 0.8


def test_doubles_are_hashed_in_full_precision_unless_a_scale_is_given(spark):
    df = spark.createDataFrame([(x,) for x in (0.0000721, 0.0012, 0.015, 0.0199, 0.1, 0.1 + 2**-56, 1e300, 2e300, 0.0, -0.0, float("nan"), None)], "d double")
    kind = df.schema["d"].dataType
    assert df.select(row_digest([(F.col("d"), kind)]).alias("h")).distinct().count() == 11
    some = df.where("abs(d) < 1")
    assert some.select(row_digest([(F.col("d"), kind)], [2]).alias("h")).distinct().count() == 3
    kinds = {"block": "id long, block_no int, epoch_no int, rate double"}
    side = [Snapshot.from_frames(n, {"block": spark.createDataFrame([(1, 1, 0, rate)], kinds["block"])}) for n, rate in (("a", 0.0000721), ("b", 0.0012))]
    made = plan_table("block", *side, REGISTRY)
    assert ("t0", "rate") in made.values
    assert len({hashed_rows(made, s, REGISTRY).first()["digest"] for s in side}) == 2


def test_digests_tell_null_from_empty_and_do_not_run_together(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("N", "x"), ("x", ""), ("1:x", "")], "a string, b string")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = df.select(row_digest([(F.col(c), kinds[c]) for c in "ab"]).alias("d")).distinct().count()
    assert found == 5


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text(max_size=3)), min_size=1, max_size=12), st.randoms())
def test_set_hashes_add_up_and_ignore_order(spark, data, random):
    def hashed(part):
        df = spark.createDataFrame(part, "a int, b string")
        kinds = {f.name: f.dataType for f in df.schema.fields}
        row = set_hash(df.select(row_digest([(F.col(c), kinds[c]) for c in "ab"]).alias("digest"))).first()
        return SetHash(row["n"], int(row["s1"]), int(row["s2"]))

    mixed = list(data)
    random.shuffle(mixed)
    half = len(data) // 2
    assert hashed(data) == hashed(mixed) == hashed(data[:half]) + hashed(data[half:])
    assert hashed(data + data[:1]) != hashed(data)


def test_ladder():
    h = SetHash
    assert judge("normal", h(0), h(3))[0] == "COUNT_DIFF" and "disabled" in judge("normal", h(0), h(3))[1]
    assert judge("accumulator", h(2, 1, 1), h(3, 9, 9))[0] == "COUNT_DIFF"
    assert judge("normal", h(2, 1, 1), h(2, 1, 2))[0] == "HASH_DIFF"
    assert judge("normal", h(2, 1, 1), h(2, 1, 1), ("1",), ("2",))[0] == "VALUE_DIFF"
    assert judge("normal", h(2, 1, 1), h(2, 1, 1), ("1",), ("1",))[0] == "MATCH"


def test_alignment():
    assert aligned([0, 1, 2, 3], [10, None, 20, 30], [100, None, 200, 200]) == ([0, 2], [10, 20], [100, 200])
    assert aligned([0, 1, 2], [10, 5, 20], [100, 200, 300]) == ([0, 2], [10, 20], [100, 300])


@given(st.integers(0, 50), st.integers(0, 400), st.integers(0, 20), st.integers(2, 64))
def test_halving_covers_the_range_and_ends_at_the_width(low, size, width, most):
    windows = halved([(low, low + size)], width, most)
    assert [x for a, b in windows for x in range(a, b + 1)] == list(range(low, low + size + 1))
    assert len(windows) <= most and (all(b - a <= width for a, b in windows) or 2 * len(windows) > most)
    # halved further where it stopped, it ends at the same windows
    assert halved(windows, width) == halved([(low, low + size)], width)


@pytest.mark.parametrize("most", [4, 4096])
def test_bisection_finds_the_first_windows_that_differ(spark, monkeypatch, most):
    monkeypatch.setattr(halved, "__defaults__", (most,))
    kinds = {"block": "id long, block_no int, epoch_no int, hash string"}
    rows = [(k + 1, k, 0, f"h{k}") for k in range(100)]
    other = [(k, n, e, "x" if n in (7, 8, 40, 41, 90) else h) for k, n, e, h in rows if n != 77]
    a, b = (Snapshot.from_frames(n, {"block": spark.createDataFrame(x, kinds["block"])}) for n, x in (("a", rows), ("b", other)))
    plan = plan_table("block", a, b, REGISTRY)
    for width, first in ((0, 8), (5, 8), (5, 2)):
        leaves = halved([(0, 99)], width, 4096)
        expected = [(x, y) for x, y in leaves if any(x <= n <= y for n in (7, 8, 40, 41, 77, 90))][:first]
        found = localize_bisect(plan, a, b, REGISTRY, 0, 99, 99, None, width=width, most=first)
        assert [(d.low, d.high) for d in found] == expected
        assert all((d.n1, d.n2) == (d.high - d.low + 1, d.high - d.low + 1 - (d.low <= 77 <= d.high)) for d in found)


@pytest.mark.parametrize("thresholds", [[], [5], [0, 3, 3, 9], [0, 1, 500], [0, 4, 9, 13, 17, 22], [3, 4, 5], list(range(0, 1000, 7))])
def test_buckets_count_thresholds(spark, thresholds):
    values = [None, -1, 0, 3, 4, 9, 500, 5000]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(bucket_of(F.col("v"), thresholds)).collect()]
    assert got == [0 if v is None else sum(t <= v for t in thresholds) for v in values]


@pytest.mark.parametrize(("a", "b", "expected"), [("ac", "abcd", (0, 2, 2)), ("abx", "acx", (1, 1, 2)), ("", "ab", (0, 2, 0)), ("ab", "ab", (0, 0, 2)), ("aab", "ab", (1, 0, 2))])
def test_keys_pair_one_to_one(spark, a, b, expected):
    one, two = (spark.createDataFrame([(c,) for c in x], "k string") for x in (a, b))
    assert tuple(compare_keys(one, two).first()) == expected


def test_verdict_texts():
    assert subset_verdict(0, 0).startswith("identical") and "db2 ⊆ db1" in subset_verdict(1, 0)
    assert "db1 ⊆ db2" in subset_verdict(0, 1) and subset_verdict(1, 1).startswith("NEITHER")


def test_labels_hold_no_secret():
    assert secret_free_label("db", "/var/run") == "db" and secret_free_label("db", "h") == "db@h" and secret_free_label(None) == "?"
    assert jdbc_label("jdbc:postgresql://me:pw@host:5432/db?password=pw") == "db@host"


def test_command_line(spark, tmp_path, capsys):
    assert block_range("3:9") == (3, 9) and block_range(None) is None
    args = parser().parse_args(["--db1", "a", "--db2", "b"])
    assert (args.workers, args.giant_fk_depth, args.block_margin, args.epoch_margin, args.localize, args.localize_buckets) == (4, 1, 0, 2, "bisect", 1024)
    for name, off, tip in (("one", 0, 6), ("two", 100, 7)):
        for table, df in snapshot(spark, name, rows(off, tip)).tables.items():
            df.coalesce(1).write.parquet(str(tmp_path / name / f"{table}.parquet"))
    where = ["--db1", str(tmp_path / "one"), "--db2", str(tmp_path / "two"), "--tables", "tx_out,multi_asset", "--epoch-margin", "0"]
    assert main([*where, "--json", str(tmp_path / "r.json")]) == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["db1"] == "one" and [r["status"] for r in report["results"]] == ["MATCH", "MATCH"]
    assert main([*where, "--plan", "--check-anchors", "--conf", "spark.sql.shuffle.partitions=4"]) == 0
    said = capsys.readouterr().out
    assert "tx_out: giant" in said and "bound in one: " in said and "PushedFilters" in said
    assert main(["--db1", str(tmp_path / "none"), "--db2", str(tmp_path / "two")]) == 2
    two = snapshot(spark, "x", rows(100, 7))["tx_out"].withColumn("value", F.col("value") + Decimal(1))
    two.write.mode("overwrite").parquet(str(tmp_path / "two" / "tx_out.parquet"))
    capsys.readouterr()
    assert main([*where, "--no-localize"]) == 1
    said = capsys.readouterr().out
    assert "[HASH_DIFF] tx_out: 10 rows on both sides" in said and "1 match" in said and "1 discrepancies" in said


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    df = spark.createDataFrame([(k, f"2024-01-0{k % 4 + 1} 0{k % 9}:00:00") for k in range(40)], "k int, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed_set_hash(stream, "t", ["k", "t"]).writeStream.outputMode("complete").format("memory").queryName("hashes").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hashes").collect())) == sorted(map(tuple, windowed_set_hash(df, "t", ["k", "t"]).collect()))


def test_catalog_views_are_left_out(spark):
    spark.sql("create database if not exists parts")
    spark.sql("drop table if exists parts.epoch_finalized")
    spark.range(3).write.saveAsTable("parts.epoch_finalized")
    spark.sql("create or replace view parts.epoch as select * from parts.epoch_finalized")
    assert list(Snapshot.from_catalog(spark, "parts").tables) == ["epoch_finalized"]
    spark.sql("drop database parts cascade")


def test_a_database_is_read_in_ranges_with_its_keys(spark):
    connection = spark._jvm.java.sql.DriverManager.getConnection("jdbc:derby:memory:parts;create=true")
    say = connection.createStatement()
    say.execute("create table block (id bigint primary key, block_no int, twice int generated always as (block_no * 2))")
    say.execute("create table tx (id bigint primary key, block_id bigint references block (id), odd_id bigint references block (id))")
    for k in range(10):
        say.execute(f"insert into block (id, block_no) values ({k + 1}, {k})")
        say.execute(f"insert into tx values ({k + 100}, {k + 1}, {k + 1})")
    side = Snapshot.from_jdbc(spark, "jdbc:derby:memory:parts", ["block", "tx"], partitions=3)
    assert side["block"].rdd.getNumPartitions() == 3 and side["block"].count() == 10
    assert side.facts["block"] == TableFacts(("id",), frozenset({"twice"}), {})
    assert side.facts["tx"].foreign_keys == {"block_id": "block", "odd_id": "block"}
    assert side.has_primary_key("block", "id") and not side.has_primary_key("tx", "block_id")


def test_declared_keys_are_followed_where_both_sides_declare_them(spark):
    frames = {"block": spark.createDataFrame([], "id long, hash binary, block_no int"), "tx": spark.createDataFrame([], "id long, odd_id long, hash binary")}
    plain = Snapshot.from_frames("a", frames)
    declared = Snapshot.from_frames("b", frames, {"tx": TableFacts(foreign_keys={"odd_id": "block"})})
    assert any("UNMAPPED" in x for x in plan_table("tx", plain, declared, REGISTRY).skipped)
    made = plan_table("tx", declared, declared, REGISTRY)
    assert not made.skipped and [(j.column, j.target) for j in made.joins] == [("odd_id", "block")]


def test_odd_column_names(spark):
    side = Snapshot.from_frames("a", {"block": spark.createDataFrame([(1, 0, 2, "x")], "id long, block_no int, `a``b.c` int, `select` string")})
    made = plan_table("block", side, side, REGISTRY)
    assert {c for _, c in made.values} >= {"a`b.c", "select"} and hashed_rows(made, side, REGISTRY).count() == 1


def test_files_that_a_bound_cannot_skip_are_warned_of(spark, tmp_path):
    made = plan(spark, "tx", {"tx": "id long, block_id long, hash binary", "block": "id long, hash binary, block_no int"})
    table = spark.range(1000).selectExpr("id", "id as block_id", "cast(null as binary) as hash")
    for name, dealt in (("sorted", table.repartitionByRange(8, "id")), ("mixed", table.repartition(8))):
        dealt.write.parquet(str(tmp_path / name))
    found = {n: anchor_warning(made, Snapshot.from_frames(n, {"tx": spark.read.parquet(str(tmp_path / n))})) for n in ("sorted", "mixed")}
    assert found["sorted"] is None and "not clustered by block_id" in found["mixed"]


def test_rows_of_one_large_row_group_are_dealt_out(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(700_000).selectExpr("id", "xxhash64(id) as h").coalesce(1).write.parquet(str(tmp_path / "large"))
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "small"))
    large, small = (spark.read.parquet(str(tmp_path / n)) for n in ("large", "small"))
    assert spread(large).rdd.getNumPartitions() == cores and spread(large).count() == 700_000
    assert spread(small).rdd.getNumPartitions() == small.rdd.getNumPartitions()
    # what only running it would tell is left as it is
    joined = large.groupBy("h").count()
    assert spread(joined) is joined


def test_options_of_a_file():
    assert read_settings(["user = me", "# no", "", "password=a=b"]) == {"user": "me", "password": "a=b"}
