"""Best-fit packing: documents into bins of tokens, under conflicts of source and duplicate cluster.

Documents are dealt by a hash into packing groups of about ``GROUP_ROWS`` rows, and
each group is packed by itself. In a group, pieces go longest first, ties by id. The
open bins are ordered by the tokens they have left; each bin carries a bitmap of the
sources and one of the duplicate clusters that it holds. A piece goes to the tightest
bin that has room and shares neither its source nor its cluster; the search starts at
the first bin with room and goes on to the next successor while bits collide. If none
is left, a new bin opens.

A document of more tokens than a bin is cut into full pieces, which fill bins of their
own, and a rest, which is packed like other documents; no token is dropped. Duplicate
clusters are texts that agree after case and white space are folded, unless a column
gives them.

Defined cases: a null or empty text has no tokens and takes a place of length 0; a null
source or cluster conflicts with nothing; rows that repeat are pieces of their own, and
copies by definition conflict; ties go by id (nulls first) and then by the text's hash;
an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import saved, text_or_empty
from evenkeel.llm.token_counts import token_counts

CAPACITY = 4096
GROUP_ROWS = 8192


@dataclass
class Packer:
    """Bins by what they have left, from 0 to the capacity; a bitmap tells which lists have bins."""

    capacity: int
    by_room: dict[int, list[int]] = field(default_factory=dict)
    filled: int = 0
    room: list[int] = field(default_factory=list)
    sources: list[int] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)

    def _file(self, number: int) -> None:
        self.by_room.setdefault(self.room[number], []).append(number)
        self.filled |= 1 << self.room[number]

    def _tightest(self, size: int, source: int, cluster: int) -> int | None:
        room = size
        above = self.filled >> size
        while above:
            step = (above & -above).bit_length() - 1
            room += step
            numbers = self.by_room[room]
            for k, number in enumerate(numbers):
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    del numbers[k]
                    if not numbers:
                        self.filled &= ~(1 << room)
                    return number
            above >>= step + 1
            room += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a piece; ``source`` and ``cluster`` are bits (0: none). The bin, and where in it."""
        number = self._tightest(size, source, cluster)
        if number is None:
            number = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        at = self.capacity - self.room[number]
        self.room[number] -= size
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self._file(number)
        return number, at


def bits_of(values: list) -> list[int]:
    """A bit of its own for each value that occurs more than once; 0 for the others and None."""
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    places = {v: 1 << k for k, v in enumerate(v for v, n in counts.items() if n > 1 and v is not None)}
    return [places.get(v, 0) for v in values]


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, bin, offset, tokens) of rows in the order given, longest rest first."""
    packer = Packer(capacity)
    source_bits, cluster_bits = bits_of(sources), bits_of(clusters)
    rests = []
    for row, size in enumerate(sizes):
        full = max(0, (size - 1) // capacity)
        for piece in range(full):
            number, at = packer.put(capacity, 0, 0)
            yield row, piece, number, at, capacity
        rests.append((size - full * capacity, row, full))
    for size, row, piece in sorted(rests, key=lambda x: (-x[0], x[1])):
        number, at = packer.put(size, source_bits[row], cluster_bits[row])
        yield row, piece, number, at, size


def folded_text_digest(column: Column) -> Column:
    """Equal for texts that agree up to case and white space."""
    return F.md5(F.trim(F.regexp_replace(F.lower(column), r"\s+", " ")).cast("binary"))


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece: the id, ``piece``, ``group``, ``bin`` (of its group), ``bin_offset``, ``n_tokens``."""
    named = docs.select(
        F.col(id_col).alias("key"), F.col(source_col).cast("string").alias("from_source"), text_or_empty(text_col).alias("text"),
        (folded_text_digest(text_or_empty(text_col)) if cluster is None else cluster.cast("string")).alias("cluster"), F.xxhash64(text_or_empty(text_col)).alias("tie"),
    )
    counted = saved(token_counts(named, text_col="text", keep=["key", "from_source", "cluster", "tie"]).drop("n_words"), "token-counts")
    groups = max(1, -(-counted.count() // group_rows))
    # rows that repeat are numbered, so that they too spread over all groups; the cluster is
    # left out of the hash for the same reason
    numbered = counted.groupBy(*counted.columns).agg(F.count("*").alias("n")).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("key", "tie", "number"), F.lit(groups))).drop("n", "number")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("tie", "ascending")])
        got = list(pack(rows.column("n_tokens").to_pylist(), rows.column("from_source").to_pylist(), rows.column("cluster").to_pylist(), capacity))
        row, piece, number, at, size = zip(*got, strict=True)
        group = rows.column("group")[0].as_py()
        return pa.table([rows.column("key").take(pa.array(row, pa.int64())), pa.array(piece, pa.int64()), pa.array([group] * len(got), pa.int64()), *(pa.array(x, pa.int64()) for x in (number, at, size))], ["key", "piece", "group", "bin", "bin_offset", "n_tokens"])

    long = F.lit(0).cast("long")
    schema = counted.select("key", *(long.alias(c) for c in ("piece", "group", "bin", "bin_offset", "n_tokens"))).schema
    return dealt.groupBy("group").applyInArrow(run, schema).withColumnRenamed("key", id_col)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack_documents(docs)
