"""Document fingerprints: canonical exact digests.

A text's canonical form is its NFKC normalisation with full case folding (so that "Straße"
and "STRASSE" agree), normalised again, white space folded to single blanks and trimmed. Its fingerprint is a wide xxhash of that form, two 64-bit
hashes of it as 32 hexadecimal digits. Texts meet by wide hash; inside a bucket that
several texts share, the canonical forms themselves are compared, byte by byte. Should
different forms ever share a hash, their fingerprints get ``-1``, ``-2``, ... by order
of the forms, so equal fingerprints of documents always mean equal forms. Edited forms are
only looked up among the documents' and not compared with each other, so
``edited_fingerprint`` is as sure as the 128 bits of its hash. As the digest is exact,
the likeness of two fingerprints is 1 if they are equal and 0 if not.

``edited_against_next`` puts documents in ascending order of their ids over all tasks:
ranges of ids are dealt out by quantiles, those of numbers over all rows, those of other
ids over a sample of them (an id that holds several quantiles is split by a hash of the text), each task sees its neighbours in a window, and where ranges
meet the few edge rows are joined.

All of it is DataFrame operations; normalisation is a JVM call by ``reflect``.

Defined cases: a null text counts as empty, and all empty texts share a fingerprint;
null ids come first; rows of one id are in the order of a hash of their texts, repeated
rows each get a row; the document after the last is the first, so a single document is
its own next; texts of any length are digested whole; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import saved, text_or_empty

#: Shared hashes up to which one pass looks at their texts by broadcast; beyond, by shuffle.
BROADCAST_HASHES = 1_000_000


#: Ids that splits between buckets are drawn from where they are not numbers, and bytes of text of a bucket, about.
SAMPLED_IDS, BUCKET_BYTES = 10_000, 64 << 20


def canonical(column: str) -> Column:
    """NFKC, case and white space folded. Not for use in conditions: Spark holds it for nondeterministic."""
    text = F.col(column)
    composed = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = composed(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True)))
    # of ASCII texts the same without the normaliser
    form = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(form, r"(?U)\s+", " "))


def wide_hash(column: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), F.col(column))), 16, "0") for k in (1, 2))))


def _with_form(docs: DataFrame, text: str, form: str, hashed: str) -> DataFrame:
    return docs.withColumn(form, canonical(text)).withColumn(hashed, wide_hash(form))


def told_apart(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(wide, form, place): canonical forms that share their wide hash with another one.

    Compares the bytes of the forms in every bucket that more than one row has.
    """
    forms = _with_form(docs.select(text_or_empty(text_col).alias("text")), "text", "form", "wide").select("wide", "form")
    shared = saved(forms.groupBy("wide").agg(F.count("*").alias("n")).where("n > 1").select("wide"), "shared-hashes")
    few = shared.count() <= BROADCAST_HASHES
    bucket = forms.join(F.broadcast(shared) if few else shared, "wide", "left_semi")
    # grouping by the form compares its bytes; copies fold where they are read
    distinct = bucket.groupBy("wide", "form").agg(F.count("*").alias("n")).drop("n")
    several = distinct.withColumn("forms", F.count("*").over(Window.partitionBy("wide"))).where("forms > 1")
    place = F.row_number().over(Window.partitionBy("wide").orderBy("form"))
    return saved(several.select("wide", "form", place.alias("place")), "told-apart")


def _named(docs: DataFrame, form: str, hashed: str, apart: DataFrame | None, out: str) -> DataFrame:
    if apart is None:
        return docs.withColumn(out, F.col(hashed))
    other = apart.select(F.col("wide").alias("_wide"), F.col("form").alias("_form"), F.col("place").alias("_place"))
    met = docs.join(other, (F.col(hashed) == F.col("_wide")) & (F.col(form) == F.col("_form")), "left")
    return met.withColumn(out, F.concat(hashed, F.coalesce(F.concat(F.lit("-"), F.col("_place").cast("string")), F.lit("")))).drop("_wide", "_form", "_place")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row."""
    apart = told_apart(docs, text_col=text_col)
    rows = _with_form(docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text")), "text", "form", "wide")
    return _named(rows, "form", "wide", apart if apart.count() else None, "fingerprint").select(F.col("key").alias(id_col), "fingerprint")


def likeness(a: str, b: str) -> Column:
    return (F.col(a) == F.col(b)).cast("double")


def _ranged(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (key, tie, ...) with ``bucket``, which rises with (key, tie)."""
    share = [k / buckets for k in range(1, buckets)]
    if isinstance(docs.schema["key"].dataType, T.NumericType):
        splits = (docs.agg(F.percentile_approx("key", share, 10_000).alias("s")).first()["s"] if share else None) or []
    else:
        drawn = docs.where(F.col("key").isNotNull()).select("key", "tie").orderBy(F.xxhash64("key", "tie"), "key").limit(SAMPLED_IDS)
        found = sorted(r["key"] for r in drawn.collect())
        splits = [found[int(x * len(found))] for x in share] if found else []
    if not splits:
        return docs.withColumn("bucket", F.lit(0))
    held: dict = {}
    for s in splits:
        held[s] = held.get(s, 0) + 1
    # splits below the key: whole groups of splits first, then those of one group
    step = max(1, math.isqrt(len(splits)))
    coarse, fine = F.array(*map(F.lit, splits[step - 1 :: step])), F.array(*map(F.lit, splits))
    groups = F.size(F.filter(coarse, lambda s: s < F.col("key")))
    below = groups * step + F.size(F.filter(F.slice(fine, groups * step + 1, F.lit(step)), lambda s: s < F.col("key")))
    bucket = F.when(F.col("key").isNull(), F.lit(0)).otherwise(below)
    wide = {s: n for s, n in held.items() if n > 1}
    for s, n in wide.items():
        # one id with many rows: its buckets by the hash of the text
        bucket = F.when(F.col("key") == s, below + F.floor(F.shiftrightunsigned("tie", 33) * n / (1 << 31)).cast("int")).otherwise(bucket)
    return docs.withColumn("bucket", bucket)


def edited_against_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``, see the columns below.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document. Columns: the id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    spark = docs.sparkSession
    apart = told_apart(docs, text_col=text_col)
    apart = apart if apart.count() else None
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"), F.xxhash64(text_or_empty(text_col)).alias("tie"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    rows = _with_form(_ranged(rows, buckets), "text", "form", "wide")
    rows = _named(rows, "form", "wide", apart, "fingerprint").select("key", "tie", "bucket", "text", "fingerprint")
    order = Window.partitionBy("bucket").orderBy(F.col("key").asc_nulls_first(), F.shiftrightunsigned("tie", 33), "tie", "text")
    placed = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).withColumn("place", F.row_number().over(order))
    edge = (F.col("place") == 1) | F.col("next_text").isNull()
    inner = _edited(placed.withColumn("edge_text", F.when(edge, F.col("text"))), apart)
    kept = ["key", "bucket", "place", "edge_text", "next_fingerprint", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    inner = saved(inner.select(*kept), "edited")
    # the last row of each bucket goes on to the first of the next bucket
    filled = sorted(r["bucket"] for r in inner.where("place = 1").select("bucket").collect())
    after = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1], strict=True)), "bucket int, next_bucket int")
    last = inner.where("edge_text is not null and next_fingerprint is null").select("key", "bucket", F.col("edge_text").alias("text"), "fingerprint")
    first = inner.where("place = 1").select(F.col("bucket").alias("next_bucket"), F.col("edge_text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    edges = _edited(last.join(after, "bucket").join(first, "next_bucket"), apart)
    out = [F.col("key").alias(id_col), *kept[5:]]
    return inner.where("next_fingerprint is not null").select(*out).unionByName(edges.select(*out))


def _edited(rows: DataFrame, apart: DataFrame | None) -> DataFrame:
    """Adds what follows from text and next_text; null next_text counts as empty."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = _named(_with_form(rows, "edited", "edited_form", "edited_wide"), "edited_form", "edited_wide", apart, "edited_fingerprint")
    return rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness("fingerprint", "next_fingerprint"))


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edited_against_next(docs)
