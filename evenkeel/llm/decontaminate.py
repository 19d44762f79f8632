"""Benchmark decontamination: winnowed fingerprints, a join, and extended hits.

A benchmark item's windows are its runs of ``WINDOW`` consecutive words; an item with
fewer words, but not none, is one window. A document word is hit if it lies in any
occurrence of a window in the document.

For windows of n words, k-grams of ``k = (n + 1) // 2`` words are hashed, and of every
``n - k + 1`` neighbouring k-gram hashes the least is kept as a fingerprint (winnowing).
Any n words that two texts share contain the same n - k + 1 k-grams in both, hence the
same fingerprint: no shared window is missed. Neighbouring places with the same least
hash are one fingerprint, about two for every n - k + 2 words. Document fingerprints are
joined with benchmark fingerprints; a hit is extended to the windows it stands for,
which are joined with the benchmark's windows by hash and then compared word by word.

All of it is DataFrame operations. A benchmark of at most ``BLOCK_WINDOWS`` windows is
broadcast, and the documents are read once; only hits and one row for each text are
shuffled. A larger one is worked off in blocks of so many windows, for which only the texts
are read again that share a fingerprint with the benchmark at all; which those are follows
from one pass whose fingerprints are joined with the benchmark's by shuffle.

Defined cases: a null text has no words and hits nothing; texts of any length are read
whole; rows that repeat (same id, same text) each get a row; items that repeat count by
their distinct ids, a null item id is written ``null``; with an empty benchmark no word
is hit; an empty table gives an empty result. Only the named columns are read;
``without_contaminated`` keeps all columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import ascii_lower, saved, text_or_empty

WINDOW = 10
#: Distinct windows of the benchmark that are broadcast at a time.
BLOCK_WINDOWS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _upto(count: Column) -> Column:
    """0 .. count - 1; empty if there is none."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _run_hash(hashes: str, start: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(F.col(hashes), start + j) for j in range(n)))


def _gram(n: int) -> tuple[int, int]:
    """k-gram size, and how many neighbouring k-grams a window of n words has."""
    k = (n + 1) // 2
    return k, n - k + 1


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Written tables: windows (wid, n, run, fp, whash), and which items have them (wid, item)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words_of(text_or_empty(text_col)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    placed = items.select("item", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("start"))
    runs = saved(placed.select("item", "n", F.expr("slice(words, start + 1, n)").alias("run")), "benchmark-runs")
    hashed = runs.select("n", "run").distinct().withColumn("h", F.transform("run", lambda w: F.xxhash64(w)))
    whash = fp = F.lit(None).cast("long")
    for size in range(1, window + 1):
        k, w = _gram(size)
        grams = [_run_hash("h", F.lit(j), k) for j in range(w)]
        whash = F.when(F.col("n") == size, _run_hash("h", F.lit(0), size)).otherwise(whash)
        fp = F.when(F.col("n") == size, F.least(*grams) if w > 1 else grams[0]).otherwise(fp)
    windows = saved(hashed.select(F.monotonically_increasing_id().alias("wid"), "n", "run", fp.alias("fp"), whash.alias("whash")), "benchmark-windows")
    members = runs.join(windows, ["n", "run"]).select("wid", "item").distinct()
    return windows, saved(members, "benchmark-members")


def _marked(docs: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """``docs`` with columns of k-gram hashes, their least, where another least begins; the marks made of them."""
    k, w = _gram(n)
    grams, least, begins = f"grams{n}", f"least{n}", f"begins{n}"
    docs = docs.withColumn(grams, F.transform(_upto(F.size("h") - (k - 1)), lambda p: _run_hash("h", p, k)))
    of_window = (lambda p: F.least(*(F.get(F.col(grams), p + j) for j in range(w)))) if w > 1 else (lambda p: F.get(F.col(grams), p))
    docs = docs.withColumn(least, F.transform(_upto(F.size(grams) - (w - 1)), of_window))
    docs = docs.withColumn(begins, F.filter(_upto(F.size(least)), lambda p: (p == 0) | (F.get(F.col(least), p) != F.get(F.col(least), p - 1))))
    end = lambda i: F.coalesce(F.get(F.col(begins), i + 1), F.size(least)) - 1
    return docs, F.transform(F.col(begins), lambda p, i: F.struct(F.lit(n).alias("n"), F.get(F.col(least), p).alias("fp"), p.alias("start"), end(i).alias("end")))


def _fingerprinted(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """``docs`` (key, digest, words) with marks: (n, fp, start, end) for each fingerprint, and one of n = 0."""
    out = docs.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    marks = [F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("fp"), F.lit(-1).alias("start"), F.lit(-1).alias("end")))]
    for n in sizes:
        out, mark = _marked(out, n)
        marks.append(mark)
    return out.select("key", "digest", "words", "h", F.concat(*marks).alias("marks"))


def _hits(docs: DataFrame, windows: DataFrame, sizes: list[int], first: bool) -> DataFrame:
    """(key, digest, n_words, start, n, wid): a row for each hit window, and in the first block one for each row of ``docs``."""
    # outer: Spark would otherwise repeat the whole expression in a filter below, at every level
    marked = _fingerprinted(docs, sizes).select("key", "digest", "words", "h", F.explode_outer("marks").alias("m"))
    marked = marked.select("key", "digest", "words", "h", "m.*")
    prints = windows.select(F.col("n").alias("fp_n"), F.col("fp").alias("fp_hash")).distinct()
    met = marked.join(F.broadcast(prints), (F.col("fp") == F.col("fp_hash")) & (F.col("n") == F.col("fp_n")), "left")
    own = (F.col("n") == 0) if first else F.lit(False)
    met = met.where(own | F.col("fp_hash").isNotNull()).select("key", "digest", "words", "h", F.col("n").alias("size"), F.explode_outer(F.sequence("start", "end")).alias("place"))
    whash = F.lit(None).cast("long")
    for n in sizes:
        whash = F.when(F.col("size") == n, _run_hash("h", F.col("place"), n)).otherwise(whash)
    met = met.withColumn("place_hash", whash)
    # a hash is only where to look: the words themselves decide
    same = (F.col("place_hash") == F.col("whash")) & (F.col("size") == F.col("n")) & (F.when(F.col("size") > 0, F.slice("words", F.greatest(F.col("place"), F.lit(0)) + 1, F.greatest(F.col("size"), F.lit(1)))) == F.col("run"))
    found = met.join(F.broadcast(windows.select("wid", "n", "run", "whash")), same, "left")
    own = (F.col("size") == 0) if first else F.lit(False)
    return found.where(own | F.col("wid").isNotNull()).select("key", "digest", F.size("words").alias("n_words"), F.col("place").alias("start"), F.col("size").alias("n"), "wid")


def _in_blocks(read: DataFrame, windows: DataFrame, sizes: list[int], blocks: int) -> DataFrame:
    """What ``_hits`` gives for all windows, block by block over the texts that share any fingerprint with them."""
    marks = _fingerprinted(read, sizes).select("digest", F.explode_outer("marks").alias("m")).select("digest", "m.n", "m.fp")
    prints = windows.select("n", "fp").distinct()
    sharing = saved(marks.join(prints, ["n", "fp"]).select("digest").distinct(), "sharing-texts")
    again = saved(read.join(sharing, "digest", "left_semi").select(read.columns), "texts-again")
    own = read.select("key", "digest", F.size("words").alias("n_words"), F.lit(-1).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("wid"))
    return reduce(DataFrame.unionByName, [own, *(_hits(again, windows.where(F.pmod("wid", F.lit(blocks)) == b), sizes, False) for b in range(blocks))])


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``digest`` of the text, ``n_words``, ``n_hit``, ``items``, ``copies`` folded out.

    ``items``: the ids of the items with occurring windows, as sorted strings.
    """
    windows, members = benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, window=window)
    # at most `window` sizes
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())
    blocks = max(1, -(-windows.count() // block_windows))
    read = docs.select(F.col(id_col).alias("key"), F.md5(text_or_empty(text_col).cast("binary")).alias("digest"), words_of(text_or_empty(text_col)).alias("words"))
    hits = _hits(read, windows, sizes, True) if blocks == 1 else _in_blocks(read, windows, sizes, blocks)
    spans = F.collect_set(F.when(F.col("n") > 0, F.struct("start", "n")))
    texts = hits.groupBy("key", "digest").agg(F.max("n_words").cast("long").alias("n_words"), F.count(F.when(F.col("n") == 0, True)).alias("copies"), spans.alias("spans"), F.collect_set("wid").alias("wids"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate(
        F.array_sort("spans"), start,
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["n"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"])).cast("long")).alias("sum")),
        lambda a: a["sum"],
    )
    texts = saved(texts.select("key", "digest", "n_words", "copies", covered.alias("n_hit"), "wids"), "contamination")
    named = texts.where("n_hit > 0").select("key", "digest", F.explode("wids").alias("wid")).join(members, "wid").groupBy(F.col("key").alias("hit_key"), F.col("digest").alias("hit_digest")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = texts.join(named, F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("digest") == F.col("hit_digest")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("key").alias(id_col), "digest", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose texts hold a window of the benchmark; all columns stay."""
    found = contamination(docs.select(id_col, text_col), benchmark, id_col=id_col, text_col=text_col)
    leaks = saved(found.where("n_hit > 0").select(F.col("digest").alias("_leak")).distinct(), "leaks")
    # a row goes as one column, whose names clash with none
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.md5(text_or_empty(text_col).cast("binary")).alias("digest"))
    return marked.join(leaks, F.col("digest") == F.col("_leak"), "left_anti").select("row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
