"""SimHash near-dedup: fingerprints, links within a Hamming radius, and their components.

A fingerprint's bit is set where more than half of the hashes of a text's shingles have
it set. Texts link where their fingerprints differ in at most ``radius`` bits.

Finding the links takes three steps.

1. *Buckets.* Fingerprints meet under keys made of some of their bits. For the exact
   search, 64 bits are cut into five blocks; fingerprints that differ in at most three
   bits agree on two whole blocks, so the ten pairs of blocks as keys miss no link.
   Keys that only one fingerprint has are dropped by their counts. A key with more than
   ``BUCKET`` fingerprints is dealt out over all pairs of its parts, so that no task
   gets all of it.
2. *Pivot distance tables.* The Hamming distances of every distinct fingerprint to
   reference fingerprints are tabled once and go with it. In a bucket, members are sorted
   by the first of them; a pair is dropped if any coordinate differs by more than the
   radius (distances to a common point cannot differ by more than the distance of the
   pair). Survivors are verified bit by bit. Members that are already connected are not compared again, so a dense
   group costs about one comparison for each member.
3. *Components.* A bucket gives a star of links for each of its components, never all
   pairs. Alternating large-star and small-star rounds on the links, each written to
   the shared folder, lead every fingerprint to the smallest of its component.

Near groups of whole corpora (``near_groups``) take the sets of distinct five-word
shingles. Their keys are the prefix filter's: with the sets in one common order, two sets
of Jaccard similarity J or more share one of their first n - ceil(J n) + 1 shingles, n
being the set's own size, so no such pair is missed. Any order is right; shingles that a
sample shows to be frequent come last, the others by their hashes, so that common lines
rarely are keys. Keys with the same members count once. Under a key the sets'
fingerprints of 2,048 bits are compared, with a limit that a pair at J does not pass but
once in 10^9: sets with similarity J have cosine 2J / (1 + J), and vectors with an angle
of a differ in a share of a / pi of the bits; for small sets the share is counted out. The
links so found only gather texts into clusters. In each cluster the sets themselves are
compared, and only pairs whose true similarity is J or more are linked; texts that are
already connected are not compared again. A large cluster is dealt out like a key.

Defined cases: null and empty texts have no words and fingerprint zero, and link like
any other; texts with fewer words than a shingle are one shingle; texts of any length
are read whole, in pieces; repeated rows and copies share their fingerprint and each
get a row; a null id counts as larger than any other; an empty table gives an empty
result. Only the named columns are read; ``one_of_each_group`` keeps all columns.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import frugal, hashed_share, in_small_batches, mix64, pieces, removed, saved, scratch, setting, shuffles_removed, text_or_empty

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that a bucket compares at once; larger ones are dealt out in parts.
BUCKET = 4096
#: Reference fingerprints of the pivot distance tables.
PIVOTS = 24
#: Bytes of a text that are read at a time.
PIECE = 1 << 20

# near groups
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8
NEAR_LANES = 32
#: Texts that are searched for frequent shingles, how many of them make one frequent, and
#: how many of those are kept. They set the order of shingles, never what is found.
HOT_TEXTS, HOT_LEAST, HOT_MOST = 8000, 8, 1 << 16
#: Standard deviations of the estimate by which a candidate may miss the similarity.
SLACK = 6.0
#: Sets up to this size have their share of differing bits counted out.
SMALL_SET = 48
#: Texts of a cluster that are compared at once; larger clusters are dealt out in parts.
CLUSTER = 1024
#: Texts whose sets are held at a time, and rows that Spark hands over with their sets.
HELD, SET_ROWS = 256, 1000


def shingles(data: bytes, n: int) -> Iterator[list[bytes]]:
    """Lists of the n-word shingles of lower-case ``data``; all lists together are the text's."""
    kept: list[bytes] = []
    found = False
    for part in pieces(data, PIECE):
        words = kept + part.split()
        if len(words) >= n:
            found = True
            yield [b" ".join(t) for t in zip(*(words[k:] for k in range(n)), strict=False)] if n > 1 else words
            kept = words[len(words) - n + 1 :]
        else:
            kept = words
    if not found and kept:
        yield [b" ".join(kept)]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows of unsigned 64-bit lanes have each bit set."""
    lanes = hashes.shape[1]
    total = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(hashes), 255 * 16):
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + 255 * 16]).view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            total += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return total


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, shingle repeats included."""
    counts, total = np.zeros(64, np.int64), 0
    for some in shingles((text or "").encode().lower(), n):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in some], np.uint64)
        counts += bit_counts(h.reshape(-1, 1))
        total += len(h)
    return int(majority(counts, total)[0])


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    return np.stack([mix64(h + np.uint64(k)) for k in range(lanes)], axis=1)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-word shingles."""
    hashes = [np.array([xxhash.xxh64_intdigest(s, SEED) for s in set(some)], np.uint64) for some in shingles((text or "").encode().lower(), n)]
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def wide_fingerprint(text: str | None, n: int, lanes: int) -> bytes:
    """A fingerprint of 64 * lanes bits over the set of a text's n-word shingles."""
    return wide_bits(shingle_set(text, n), lanes)


def wide_bits(h: np.ndarray, lanes: int) -> bytes:
    counts = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(h), 1 << 14):
        counts += bit_counts(_lanes(h[k : k + (1 << 14)], lanes))
    return majority(counts, len(h)).tobytes()


def prefix(h: np.ndarray, hot: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, ``hot`` ones last; sets of this similarity share one of theirs."""
    if not len(h):
        return np.zeros(1, np.uint64)
    last = np.isin(h, hot)
    ordered = np.concatenate([h[~last], h[last]])
    return ordered[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, n) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [batch.schema.names[0], "fp"])

    wide = docs.select(id_col, text_or_empty(text_col).alias("_hashed_text"))
    return in_small_batches(wide).mapInArrow(frugal(run), wide.select(id_col, F.lit(0).cast("long").alias("fp")).schema)


class Forest:
    """Connected sets of 0..n-1."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[k] with b[k] for every k."""
        while True:
            x, y = self.labels[a], self.labels[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.labels, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = self.labels[self.labels]
                if (further == self.labels).all():
                    break
                self.labels = further


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """The row of the pivot distance table for each row of unsigned 64-bit lanes."""
    lanes = fps.shape[1]
    pivots = mix64(np.arange(PIVOTS * lanes, dtype=np.uint64)).reshape(PIVOTS, lanes)
    return np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)


def tabled(fps: np.ndarray) -> pa.Array:
    """Each fingerprint's bytes, and after them its distances to the pivots."""
    rows = np.concatenate([fps.view(np.uint8), pivot_distances(fps).view(np.uint8)], axis=1)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def connected(fps: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """For each row of unsigned 64-bit lanes, the first row of its component at ``radius``; ``table``: their ``pivot_distances``."""
    n = len(fps)
    forest = Forest(n)
    if n < 2:
        return forest.labels
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], np.ascontiguousarray(table[order])
    upto = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    at, size = 0, 1
    while at < n:
        # few rows at first: when they have connected the rest, little is left to compare
        end = min(n, at + size)
        size = min(256, size * 2)
        # rows of a window in the first coordinate, without pairs that are connected
        rows, width = end - at, int(upto[end - 1]) - at
        alive = (np.arange(rows)[:, None] < np.arange(width)[None, :]) & (forest.labels[at:end, None] != forest.labels[None, at : at + width])
        i, j = np.nonzero(alive)
        for k in range(PIVOTS):
            if not len(i):
                break
            near = np.abs(table[at + i, k] - table[at + j, k]) <= radius
            i, j = i[near], j[near]
        for k in range(0, len(i), 1 << 16):
            a, b = at + i[k : k + (1 << 16)], at + j[k : k + (1 << 16)]
            apart = forest.labels[a] != forest.labels[b]
            a, b = a[apart], b[apart]
            close = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= radius
            forest.join(a[close], b[close])
        at = end
    labels = np.empty(n, np.int64)
    labels[order] = order[forest.labels]
    return labels


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of distinct hashes, the first of its component at this Jaccard similarity."""
    n = len(sets)
    forest = Forest(n)
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(ids), bool)
    for k in range(n - 1):
        other = k + 1 + np.flatnonzero(forest.labels[k + 1 :] != forest.labels[k])
        other = other[np.minimum(sizes[other], sizes[k]) >= similarity * np.maximum(sizes[other], sizes[k]) - 1e-9]
        if not len(other):
            continue
        mine = ids[starts[k] : starts[k + 1]]
        mark[mine] = True
        if len(other) * 8 < n - k:
            common = np.array([np.count_nonzero(mark[ids[starts[x] : starts[x + 1]]]) for x in other])
        else:
            common = np.add.reduceat(mark[ids], starts[:-1], dtype=np.int64)[other]
        mark[mine] = False
        close = other[common / (sizes[k] + sizes[other] - common) >= similarity]
        forest.join(np.full(len(close), k), close)
    return forest.labels


def _near_bits(radius: int, lanes: int):
    def labelled(bits: list[bytes]) -> np.ndarray:
        rows = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
        fps, table = (np.ascontiguousarray(x) for x in (rows[:, : 8 * lanes], rows[:, 8 * lanes :]))
        return connected(fps.view("<u8"), table.view("<i2"), radius)

    return labelled


def _near_sets(similarity: float):
    return lambda sets: alike([np.frombuffer(x, "<u8") for x in sets], similarity)


def _stars(labelled):
    """Links of each bucket, of whose members' bytes ``labelled`` makes components; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def links(rows: pa.Table) -> pa.RecordBatch:
            key = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            node = rows.column("node").to_numpy()
            bits = rows.column("bits").to_pylist()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    labels = labelled(bits[lo:hi])
                    other = np.flatnonzero(labels != np.arange(hi - lo))
                    a.append(node[lo:hi][other])
                    b.append(node[lo:hi][labels[other]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            # the last bucket of a batch may go on in the next one
            last = [rows.column(c)[rows.num_rows - 1].as_py() for c in ("key", "i", "j")]
            same = np.ones(rows.num_rows, bool)
            for c, v in zip(("key", "i", "j"), last, strict=True):
                same &= rows.column(c).to_numpy() == v
            first = int(np.argmax(same))
            if first or (held and [held[-1].column(c)[0].as_py() for c in ("key", "i", "j")] != last):
                held.append(rows.slice(0, first))
                yield links(pa.concat_tables(held))
                held = [rows.slice(first)]
            else:
                held.append(rows)
        if held:
            yield links(pa.concat_tables(held))

    return run


def once_each(keyed: DataFrame, path: str) -> DataFrame:
    """Of keys that several nodes have, one for each set of nodes; written below ``path``."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    common = saved(keyed.join(shared, "key").select("node", "key"), "postings", f"{path}/postings")
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "node")).alias("y")]
    chosen = common.groupBy("key").agg(F.count("*").alias("n"), *members).groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return saved(common.join(chosen.select("key"), "key").select("node", "key"), "buckets", f"{path}/buckets")


def links(nodes: DataFrame, keys, radius: int, lanes: int, *, thin: str | None = None) -> DataFrame:
    """(a, b): links that connect what lies within ``radius`` and shares a key.

    ``nodes`` has node (long) and bits (binary, see ``tabled``); ``keys`` is an array column of longs.
    ``thin``: keys of the same nodes count once; a path that what is left is written below.
    """
    keyed = nodes.select("node", F.explode(keys).alias("key"))
    return met_links(nodes, once_each(keyed, thin) if thin else keyed, _near_bits(radius, lanes), BUCKET)


def met_links(nodes: DataFrame, keyed: DataFrame, labelled, bucket: int) -> DataFrame:
    """(a, b): links of all that share a key in ``keyed`` (node, key), as ``labelled`` makes them of the nodes' bits."""
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a large bucket's parts i and j meet in one task for each pair of parts
    parts = F.ceil(F.col("n") / bucket).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = (
        keyed.join(shared.withColumn("parts", parts), "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node")
    )
    spread = met.join(nodes, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return spread.select("key", "i", "j", "node", "bits").mapInArrow(frugal(_stars(labelled)), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge, the smallest node that it is connected with."""
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "links")
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", path)
    before = None
    while True:
        # every pair (a, b) has a > b
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == before or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(state)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, path = path, scratch(spark, "links")
        now = saved(small.where("a <> b").distinct(), "links", path)
        # the next round reads only what this one has written
        removed(spark, last)


def _block_pairs(bits) -> F.Column:
    """Ten keys of a 64-bit fingerprint: the number of a pair of blocks, and its bits."""
    edges = [0, 13, 26, 39, 52, 64]
    blocks = [F.shiftrightunsigned(F.shiftleft(bits, 64 - b), 64 - (b - a)) for a, b in zip(edges, edges[1:], strict=False)]
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    return F.array(*(F.shiftleft(blocks[i], 13).bitwiseOR(blocks[j]).bitwiseOR(F.lit(k << 32)) for k, (i, j) in enumerate(pairs)))


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id that its links reach."""
    with shuffles_removed(docs.sparkSession):
        return _near_components(docs, id_col, text_col)


def _near_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prints = saved(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64).reshape(-1, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), tabled(fps)], ["node", "bits"])

    # copies meet here, once for each task
    nodes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    table = saved(nodes.select(F.col("fp").alias("node")).mapInArrow(with_distances, "node long, bits binary"), "pivot-distances")
    edges = links(table, _block_pairs(F.col("node")), RADIUS, 1)
    roots = saved(components(edges), "components")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = saved(rooted.join(smallest, "root").select("fp", "component_id", "n"), "classes")
    # fingerprints of over a thousandth of the rows are fewer than a thousand: their many rows are not shuffled
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    common = F.col("n") * 1000 > total
    often = prints.join(F.broadcast(classes.where(common).select("fp", "component_id")), "fp")
    others = prints.join(F.broadcast(classes.where(common).select("fp")), "fp", "left_anti").join(classes.where(~common).select("fp", "component_id"), "fp")
    return often.unionByName(others).select(id_col, "fp", "component_id")


@functools.cache
def differing_share(similarity: float) -> float:
    """The largest share of bits in which fingerprints of sets with this Jaccard similarity differ."""

    def binomial(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n

    most = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    for x in range(1, SMALL_SET + 1):
        for y in range(x, int(x / similarity + 1e-9) + 1):
            for both in range(math.ceil(similarity * (x + y) / (1 + similarity) - 1e-9), x + 1):
                # a bit is set in each set where more than half of its hashes have it
                p, q = (np.array([binomial(n - both)[max(0, n // 2 + 1 - c) :].sum() for c in range(both + 1)]) for n in (x, y))
                most = max(most, float(binomial(both) @ (p * (1 - q) + q * (1 - p))))
    return most


def differing_bits(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of sets with this Jaccard similarity differ at most, with some slack."""
    share = differing_share(similarity)
    return int(bits * share + SLACK * math.sqrt(bits * share * (1 - share)))


def frequent_shingles(hashed: DataFrame) -> np.ndarray:
    """Hashes of the shingles that many of a sample of the texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x, NEAR_SHINGLE).view(np.int64))], ["h"])

    some = hashed.where(hashed_share(hashed.count(), HOT_TEXTS, "digest")).dropDuplicates(["digest"]).select("_hashed_text")
    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST)
    return np.array([r["h"] for r in found.orderBy(F.desc("n"), "h").limit(HOT_MOST).collect()], np.int64).view(np.uint64)


def only_named(prints: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of ``prints`` (digest, bits), once each, with the digests of ``named`` and few others.

    One bit for each digest's hash keeps most of the others from being shuffled.
    """
    size = 1 << max(10, (16 * named.count()).bit_length())
    at = F.xxhash64("digest").bitwiseAND(F.lit(size - 1))
    words = named.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("word")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("set")).collect()
    table = np.zeros(size >> 3, np.uint8)
    table[[w["word"] for w in words]] = [w["set"] for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)).select([0, 1])

    return prints.withColumn("at", at).mapInArrow(run, prints.schema).groupBy("digest").agg(F.first("bits").alias("bits"))


def near_groups(docs: DataFrame, *, text_col: str = "text", similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """(digest, root): for every distinct text with near copies, its MD5 digest and that of its group's first text.

    Texts are near copies if the Jaccard similarity of their five-word shingle sets is
    ``similarity`` or more.
    """
    hashed = docs.select(F.md5(text_or_empty(text_col).cast("binary")).alias("digest"), text_or_empty(text_col).alias("_hashed_text"))
    hot = frequent_shingles(hashed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (batch.slice(k, HELD) for batch in batches for k in range(0, batch.num_rows, HELD)):
            sets = [shingle_set(x, NEAR_SHINGLE) for x in some.column(1).to_pylist()]
            bits = tabled(np.frombuffer(b"".join(wide_bits(h, NEAR_LANES) for h in sets), "<u8").reshape(-1, NEAR_LANES))
            keys = pa.array([prefix(h, hot, similarity).view(np.int64) for h in sets], pa.list_(pa.int64()))
            # sets without any shingle are alike
            whole = pa.array([(h if len(h) else np.zeros(1, np.uint64)).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), bits, keys, whole], ["digest", "bits", "keys", "whole"])

    spark = docs.sparkSession
    path = scratch(spark, "near-groups")
    # a table is deleted, and a job's shuffle files are, once what is made of them is written
    with shuffles_removed(spark):
        prints = saved(in_small_batches(hashed).mapInArrow(frugal(run), "digest string, bits binary, keys array<long>, whole binary"), "prints", f"{path}/prints")
        distinct = prints.groupBy("digest").agg(F.first("bits").alias("bits"), F.first("keys").alias("keys"))
        # numbers that are written down once, and so stay
        nodes = saved(distinct.withColumn("node", F.monotonically_increasing_id()), "texts", f"{path}/texts")
        edges = links(nodes, F.col("keys"), differing_bits(similarity, 64 * NEAR_LANES), NEAR_LANES, thin=path)
        clusters = components(edges).select("node", F.col("root").alias("key"))
        clusters = saved(clusters.join(nodes.select("node", "digest"), "node"), "clusters", f"{path}/clusters")
        for done in ("postings", "buckets", "texts"):
            removed(spark, f"{path}/{done}")
        # rows with whole sets are large, so fewer of them go to Python at a time
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(SET_ROWS)):
            sets = only_named(prints.select("digest", F.col("whole").alias("bits")), clusters)
            members = saved(clusters.join(sets, "digest").select("node", "key", "bits"), "members", f"{path}/members")
            removed(spark, f"{path}/prints")
            edges = saved(met_links(members.select("node", "bits"), members.select("node", "key"), _near_sets(similarity), CLUSTER), "near-links", f"{path}/near-links")
            removed(spark, f"{path}/members")
        roots = saved(components(edges), "components", f"{path}/components")
    names = clusters.select("node", "digest")
    return roots.join(names, "node").select("digest", "root").join(names.select(F.col("node").alias("root"), F.col("digest").alias("first")), "root").select("digest", F.col("first").alias("root"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: the one with the smallest id.

    Of rows that agree in id and text one stays.
    """
    digest = F.md5(text_or_empty(text_col).cast("binary"))
    groups = near_groups(docs.select(text_col), text_col=text_col, similarity=similarity)
    rows = docs.select(digest.alias("digest"), F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id")).alias("id"))
    # one row for each text first: a group of copies shrinks in the tasks that read it
    counted = rows.groupBy("digest", "id").agg(F.count("*").alias("n"))
    texts = counted.groupBy("digest").agg(F.min(F.struct("id", "n")).alias("first"))
    texts = texts.join(groups, "digest", "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    kept = texts.groupBy("root").agg(F.min(F.struct("first.id", "digest", "first.n")).alias("kept"))
    kept = saved(kept.select(F.col("kept.digest").alias("_kept_digest"), F.col("kept.id.id").alias("_kept_id"), (F.col("kept.n") > 1).alias("_kept_again")), "kept")
    # dealt out by id too, so that the copies of a text don't meet in one task; a row goes as one column, whose names clash with none
    marked = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest"), F.col(id_col).alias("id"))
    found = marked.join(kept, (F.col("digest") == F.col("_kept_digest")) & F.col("id").eqNullSafe(F.col("_kept_id")))
    once, again = found.where(~F.col("_kept_again")), found.where("_kept_again").dropDuplicates(["_kept_digest"])
    return once.unionByName(again).select("row.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
