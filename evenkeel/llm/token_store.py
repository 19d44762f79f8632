"""Token-ID / binary output: shards of raw ids, and a minimal perfect hash index over them.

Layout of a store (all under one path of a file system that every executor reaches):

* ``shards/shard-NNNNN.bin``: the token ids of the shard's documents, end id included,
  one after the other, as little-endian unsigned 16-bit integers (32-bit where an id
  needs it); nothing else,
* ``shards/shard-NNNNN.idx``: one unsigned 64-bit integer more than the shard has
  documents, the place in ids where each document starts,
* ``entries/``: a Parquet table of (key, shard, ordinal, n_tokens), what the tasks wrote,
* ``index/``: a Parquet table of index buckets. A key's hash chooses its bucket; in the
  bucket a minimal perfect hash (a cascade of bit arrays, ranks counted by bit count)
  gives each key a slot of its own, and the slot holds a 32-bit fingerprint of the key,
  the shard, the ordinal, and the number of documents with this key. Keys whose 64-bit
  hashes are equal, as those of strings may be, are listed beside by their text.

Documents are in ascending order of their ids over all shards (ties by a hash of the
text), so documents that share an id follow each other, possibly over several shards,
and one slot stands for all of them. Task outputs have the same names and bytes when a
task is run again, and appear by renaming, so lost executors do no harm.

Defined cases: a null text is empty and has just the end id; a null id sorts first and
is a key of its own; ids that occur repeatedly keep all their rows, also where one id
has a large share of the table; texts of any length are encoded whole; an empty table
makes an empty store. Only the named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import frugal, in_small_batches, mix64, portions, saved, scratch, text_or_empty

#: Words whose ids a worker remembers.
REMEMBERED = 600_000
#: Keys of an index bucket, about.
BUCKET_KEYS = 32_768
#: Bytes of text that are encoded at once, and ids that are read at once.
HELD_BYTES, READ_IDS = 4 << 20, 1 << 20
#: Bytes of text of a shard at most, about.
SHARD_BYTES = 256 << 20
END_ID = 2
_CLOSING = ".,"
#: A closing mark after a digit or a Latin-1 letter, whose lower-case forms are letters too.
_CLOSED = "[0-9A-Za-zÀ-ÖØ-öø-ÿ][.,]$"


def spread(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` that begin at ``starts``, one after the other."""
    return pool[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Ids of whole texts by the tokenizers library; each word between white space is encoded once.

    The tokenizer's words never contain white space, so the ids of a text are the ids of
    its chunks one after the other. Arrow splits the texts and finds the distinct chunks;
    a closing mark after a letter or digit is a word of its own to the tokenizer, and words
    that differ in ASCII case are the same. A worker remembers words by their places in one
    array of ids; when it remembers too many, the half that was not met for longest goes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._ends_word = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._ends_word[[i for t, i in self._tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._marks = {m: self._tokenizer.encode(m, add_special_tokens=False).ids for m in _CLOSING}
        self._cut = all(len(x) == 1 for x in self._marks.values())
        self._known: dict[str, int] = {}
        self._pool, self._starts, self._sizes, self._met = np.zeros(0, self.dtype), *(np.zeros(0, np.int64) for _ in range(3))
        self._calls = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, an end id after each, and how many each text has."""
        chunks = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(chunks.flatten())
        place = coded.indices.to_numpy()
        ids, sizes = self._ids_of(coded.dictionary)
        length = sizes[place]
        upto = chunks.offsets.to_numpy().astype(np.int64) - chunks.offsets[0].as_py()
        counts = np.diff(np.concatenate([[0], np.cumsum(length)])[upto])
        out = np.full(int(counts.sum()) + len(counts), END_ID, self.dtype)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        out[inner] = spread(ids, (np.cumsum(sizes) - sizes)[place], length)
        return out, counts + 1

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after the other, and how many each has."""
        marked = pc.and_(pc.match_substring_regex(chunks, _CLOSED), self._cut)
        words = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        # the strings of special tokens are told apart by case
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        coded = pc.dictionary_encode(pc.if_else(plain, pc.ascii_lower(words), words))
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        marked, sizes = marked.to_numpy(zero_copy_only=False), self._sizes[place]
        whole = sizes + marked
        out = np.empty(int(whole.sum()), self.dtype)
        inner = np.ones(len(out), bool)
        at = np.cumsum(whole)[marked] - 1
        inner[at] = False
        out[inner] = spread(self._pool, self._starts[place], sizes)
        point = pc.ends_with(chunks, ".").to_numpy(zero_copy_only=False)[marked]
        out[at] = np.where(point, self._marks["."][0], self._marks[","][0])
        return out, whole

    def _places(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > REMEMBERED:
            self._forget()
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            self._learn([words[k] for k in new])
            found[new] = np.fromiter((known[words[k]] for k in new), np.int64, len(new))
        self._calls += 1
        self._met[found] = self._calls
        return found

    def _forget(self) -> None:
        kept = np.flatnonzero(self._met > np.median(self._met))
        words = list(self._known)
        self._pool, self._sizes = spread(self._pool, self._starts[kept], self._sizes[kept]), self._sizes[kept]
        self._starts, self._met = np.cumsum(self._sizes) - self._sizes, self._met[kept]
        self._known.clear()
        self._known.update((words[k], place) for place, k in enumerate(kept.tolist()))

    def _learn(self, words: list[str]) -> None:
        letters, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        named, ids, sizes = [], [], []
        for k in range(0, len(letters), 4096):
            some = letters[k : k + 4096]
            # words of letters as one text, cut after the ids that end a word, if that fits
            joined = np.array(self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self._ends_word[joined]) + 1
            if len(cuts) == len(some):
                named += some
                ids.append(joined)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                others += some
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            found = [x.ids for x in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            named += some
            ids.append(np.array([i for x in found for i in x], self.dtype))
            sizes.append(np.array([len(x) for x in found], np.int64))
        self._known.update(zip(named, range(len(self._known), len(self._known) + len(named)), strict=True))
        self._pool = np.concatenate([self._pool, *ids])
        self._sizes = np.concatenate([self._sizes, *sizes])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._met = np.concatenate([self._met, np.full(len(named), self._calls)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with its scheme, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: without one it is on Spark's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _written(system: fs.FileSystem, path: str, attempt: str, fill) -> None:
    """Write under a name of this attempt's own, then rename; what another attempt has left has the same bytes and stays."""
    own = f"{path}.{attempt}"
    there = lambda: system.get_file_info(path).type == fs.FileType.File
    try:
        with system.open_output_stream(own) as out:
            fill(out)
        if not there():
            try:
                system.move(own, path)
            except OSError:
                if not there():
                    raise
    finally:
        if system.get_file_info(own).type == fs.FileType.File:
            system.delete_file(own)


@dataclass(frozen=True)
class TokenStore:
    """Where a store lies, and what its shards hold (a few numbers for each shard)."""

    path: str
    wide: bool
    records: tuple[int, ...]
    ids: tuple[int, ...]
    n_buckets: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<u4" if self.wide else "<u2")


def write_store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shards: int | None = None, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
    """Encode ``docs`` into shards in ascending order of the ids and index them.

    ``shards``: how many files; if not given as many as shuffle partitions, more where
    one would get over ``SHARD_BYTES`` of text. ``path`` without a scheme is on Spark's
    default file system.
    """
    spark = docs.sparkSession
    vocabulary, path = vocabulary or vocabulary_path(), qualified(spark, path)
    wide = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"))
    if shards is None:
        size = wide.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), f"attempt-{context.taskAttemptId()}"
        mine = encoder(vocabulary)
        system, top = _files(f"{path}/shards")
        system.create_dir(top, recursive=True)
        starts, outputs = [0], []

        def fill(out):
            for batch in batches:
                sizes = []
                for texts in portions(batch.column(1), HELD_BYTES):
                    ids, n = mine.encode(texts)
                    out.write(ids.tobytes())
                    sizes.append(n)
                sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
                first = len(starts) - 1
                starts.extend((starts[-1] + np.cumsum(sizes)).tolist())
                outputs.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array([shard] * len(sizes), pa.int32()), pa.array(range(first, first + len(sizes)), pa.int64()), pa.array(sizes)], ["key", "shard", "ordinal", "n_tokens"]))

        name = f"{top}/shard-{shard:05d}"
        _written(system, f"{name}.bin", attempt, fill)
        _written(system, f"{name}.idx", attempt, lambda out: out.write(np.array(starts, "<u8").tobytes()))
        yield from outputs

    ordered = wide.repartitionByRange(shards, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    schema = wide.select("key", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("n_tokens")).schema
    in_small_batches(ordered).mapInArrow(frugal(run), schema).write.parquet(f"{path}/entries")
    entries = spark.read.schema(schema).parquet(f"{path}/entries")
    # one row for each shard
    totals = {r["shard"]: (r["n"], r["ids"]) for r in entries.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids")).collect()}
    upto = max(totals, default=-1) + 1
    n_keys = sum(n for n, _ in totals.values())
    store = TokenStore(path, encoder(vocabulary).dtype.itemsize == 4, tuple(totals.get(k, (0, 0))[0] for k in range(upto)), tuple(totals.get(k, (0, 0))[1] for k in range(upto)), max(1, -(-n_keys // bucket_keys)))
    first = entries.groupBy("key").agg(F.min(F.struct("shard", "ordinal")).alias("at"), F.count("*").alias("n"))
    hashed = first.select(F.col("key").cast("string").alias("text"), F.xxhash64("key").alias("hash"), F.hash(F.lit("fingerprint"), "key").alias("mark"), "at.shard", "at.ordinal", "n")
    hashed.withColumn("bucket", F.pmod("hash", F.lit(store.n_buckets))).groupBy("bucket").applyInArrow(_build_bucket, _BUCKET_SCHEMA).write.parquet(f"{path}/index")
    return store


_BUCKET_SCHEMA = "bucket long, n_keys long, levels array<int>, bits binary, marks binary, shards binary, ordinals binary, counts binary, same array<struct<text:string,shard:int,ordinal:long,n:long>>"
#: Bits of a level for each key that is still to be placed.
GAMMA = 2


def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(hashes ^ mix64(np.full(1, level, np.uint64))) % np.uint64(size)).astype(np.int64)


def build_hash(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits (one after the other) of a minimal perfect hash of distinct 64-bit keys.

    Keys must be distinct: equal ones would collide at every level.
    """
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("keys of a perfect hash must be distinct")
    left, sizes, levels = hashes, [], []
    while len(left):
        size = max(8, -(-len(left) * GAMMA // 8) * 8)
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def find_slots(hashes: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for some of the keys that were never placed."""
    ranks = np.cumsum(bits) - 1
    slots, open_, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
    for level, size in enumerate(sizes):
        if not len(open_):
            break
        at = base + _place(hashes[open_], level, size)
        hit = bits[at]
        slots[open_[hit]] = ranks[at[hit]]
        open_, base = open_[~hit], base + size
    return slots


def _build_bucket(rows: pa.Table) -> pa.Table:
    """A bucket's row. Keys that share their whole hash, which string keys may, are listed by their text in ``same``."""
    bucket = rows.column("bucket")[0]
    hashes, times = np.unique(rows.column("hash").to_numpy(), return_counts=True)
    again = np.isin(rows.column("hash").to_numpy(), hashes[times > 1])
    same = rows.filter(pa.array(again)).select(["text", "shard", "ordinal", "n"]).to_pylist()
    rows = rows.filter(pa.array(~again))
    hashes = rows.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    sizes, bits = build_hash(hashes)
    order = np.argsort(find_slots(hashes, sizes, bits))
    blob = lambda name, kind: pa.array([rows.column(name).to_numpy()[order].astype(kind).tobytes()], pa.binary())
    return pa.table([
        pa.array([bucket.as_py()], pa.int64()), pa.array([len(hashes)], pa.int64()), pa.array([sizes], pa.list_(pa.int32())),
        pa.array([np.packbits(bits).tobytes()], pa.binary()), blob("mark", "<i4"), blob("shard", "<i4"), blob("ordinal", "<i8"), blob("n", "<i8"),
        pa.array([same], pa.list_(pa.struct([("text", pa.string()), ("shard", pa.int32()), ("ordinal", pa.int64()), ("n", pa.int64())]))),
    ], ["bucket", "n_keys", "levels", "bits", "marks", "shards", "ordinals", "counts", "same"])


def locate(store: TokenStore, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, shard, first, upto): the ordinals of each distinct key's documents, one row for each shard they lie in.

    Keys that the store doesn't have give no row.
    """
    spark = keys.sparkSession
    records = store.records
    distinct = keys.select(F.col(key_col).alias("key")).distinct()
    asked = distinct.select("key", F.col("key").cast("string").alias("text"), F.xxhash64("key").alias("hash"), F.hash(F.lit("fingerprint"), "key").alias("mark")).withColumn("bucket", F.pmod("hash", F.lit(store.n_buckets)))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            row = right.to_pylist()[0]
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["levels"])].astype(bool)
            slots = find_slots(left.column("hash").to_numpy().astype(np.int64).view(np.uint64), row["levels"], bits)
            marks, shards = np.frombuffer(row["marks"], "<i4"), np.frombuffer(row["shards"], "<i4")
            ordinals, counts = np.frombuffer(row["ordinals"], "<i8"), np.frombuffer(row["counts"], "<i8")
            hits = (slots >= 0) & (marks[slots] == left.column("mark").to_numpy()) if len(marks) else np.zeros(len(slots), bool)
            found = [(k, int(shards[slots[k]]), int(ordinals[slots[k]]), int(counts[slots[k]])) for k in np.flatnonzero(hits).tolist()]
            listed = {x["text"]: (x["shard"], x["ordinal"], x["n"]) for x in row["same"]}
            if listed:
                found = [(k, *listed[t]) for k, t in enumerate(left.column("text").to_pylist()) if t in listed] + [x for x in found if left.column("text")[x[0]].as_py() not in listed]
            for k, shard, first, n in found:
                while n > 0:
                    here = min(n, records[shard] - first)
                    if here:
                        got.append((k, shard, first, first + here))
                    shard, first, n = shard + 1, 0, n - here
        k, shard, first, upto = zip(*got, strict=True) if got else ((), (), (), ())
        return pa.table([left.column("key").take(pa.array(k, pa.int64())), pa.array(shard, pa.int32()), pa.array(first, pa.int64()), pa.array(upto, pa.int64())], ["key", "shard", "first", "upto"])

    index = spark.read.parquet(f"{store.path}/index")
    schema = distinct.select("key", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("upto")).schema
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, schema)


def read_ids(store: TokenStore, located: DataFrame, *, ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of located documents, read from the shards.

    ``start``: the ids of all documents before it. ``ids``: little-endian as stored.
    """
    before = [0, *np.cumsum(store.ids).tolist()]
    dtype, path = store.dtype, store.path

    def read(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        system, top = _files(f"{path}/shards")
        name = f"{top}/shard-{shard:05d}"
        with system.open_input_stream(f"{name}.idx") as f:
            starts = np.frombuffer(f.read(), "<u8").astype(np.int64)
        keys, out = [], []
        with system.open_input_file(f"{name}.bin") as f:
            order = np.argsort(rows.column("first").to_numpy())
            first, upto = rows.column("first").to_numpy(), rows.column("upto").to_numpy()
            window, held = b"", (0, 0)
            for k in order.tolist():
                for ordinal in range(first[k], upto[k]):
                    a, b = int(starts[ordinal]), int(starts[ordinal + 1])
                    if not held[0] <= a <= b <= held[1]:
                        # neighbours are asked for in order: read ahead a little
                        held = a, max(b, min(a + READ_IDS, int(starts[-1])))
                        window = f.read_at((held[1] - a) * dtype.itemsize, a * dtype.itemsize)
                    data = window[(a - held[0]) * dtype.itemsize : (b - held[0]) * dtype.itemsize]
                    keys.append(k)
                    out.append((before[shard] + a, b - a, zlib.crc32(np.frombuffer(data, dtype).astype("<u4").tobytes()), data if ids else None))
        columns = [pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        names = ["start", "n_tokens", "ids_crc32", "ids"]
        return pa.table([rows.column("key").take(pa.array(keys, pa.int64())), *columns[: 3 + ids]], ["key", *names[: 3 + ids]])

    long = F.lit(0).cast("long")
    schema = located.select("key", long.alias("start"), long.alias("n_tokens"), long.alias("ids_crc32"), *([F.lit(b"").alias("ids")] if ids else [])).schema
    return located.groupBy("shard").applyInArrow(read, schema)


def op1_token_store(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store = write_store(docs, scratch(spark, "token-store"))
    located = saved(locate(store, docs.select("doc_id")), "located")
    return read_ids(store, located, ids=False).withColumnRenamed("key", "doc_id")
