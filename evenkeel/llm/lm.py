"""LM scoring: smoothed n-grams as a weighted automaton with failure arcs.

The model is a trigram model over words. Its states are the root, the words, and the
word pairs seen in training. From the state of a pair uv an arc leads to the state of
vw for each triple uvw that was seen, from the state of a word u to the state of uv for
each pair, and from the root to every word. The failure arc of uv leads to v, that of a
word to the root. A text is read once from left to right: where the state has no arc for
the next word, failure arcs are taken, each adding its back-off weight, until one has;
the state that arc leads to is carried on to the next word.

Smoothing, with counts c, N training tokens, V distinct ones and concentrations K:
``p1(v) = (c(v) + 1) / (N + V + 1)``, ``p2(v | u) = (c(uv) + K2 p1(v)) / (c(u) + K2)``,
``p3(w | uv) = (c(uvw) + K3 p2(w | v)) / (c(uv) + K3)``. An arc weighs the log10 of its
probability, a failure arc log10 of ``K / (c + K)``, so an n-gram that was not seen has
the shorter one's probability times that share, and all probabilities after a state sum
to one. A text starts in the state of the end token, as if another text had just ended.

The model grows with the corpus and is never gathered in one place:

1. Tasks cut their rows into blocks of about ``BLOCK`` bytes and write, for each block,
   its texts as places in the block's own word list, its words with their training
   counts, and hashes of its word pairs with their training counts.
2. Words and pairs are dealt out by ranges of their hashes. There is a range for each
   ``RANGE`` bytes of text, so a range holds about as much at every size. It adds up the
   counts of all blocks and answers each block with the totals of what it asked for, and
   with whether another block has the pair too.
3. Each block meets its answers and asks in the same way for its triples. Left out are
   those that need no asking: if one of a triple's pairs was never trained on, its count
   is zero, and if no other block has that pair, it is the block's own.
4. Each block meets all answers and builds the part of the automaton that its own texts
   can reach, which is all that their traversal needs.

A block's answer from a range is one record, and there are fewer records than n-grams
that blocks ask for. Where executors have more memory, larger blocks and ranges make
them fewer by the square.

Words are told apart by their bytes, pairs and triples by 64-bit hashes of their words:
of n distinct ones about n^2 / 2^65 share a hash and count as one, under 300 of 10^11.

Defined cases: a null text has no words and is scored as its end token alone; a null id
is a training row; long texts are cut between words, and the two words before a cut go
with the next part, so they are scored whole; repeated rows each get a row; with no
training row every token is unknown, N and V are 0. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import crc_mod, frugal, in_small_batches, mix64, pieces, removed, scratch, shuffles_removed, text_or_empty

#: Bytes of text of a block, and of what a hash range counts.
BLOCK = RANGE = 6 << 20
#: Concentrations: how many observations of a word, and of a pair, outweigh the shorter context.
CONCENTRATIONS = (50.0, 10.0)
#: The end token; no word holds white space.
END = b"\n"
#: Words that a lane of the traversal reads.
LANE = 256
_CODEC = pa.Codec("zstd", compression_level=1)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + _CODEC.compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return _CODEC.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), asbytes=True)


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, as many as the largest needs, compressed."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(x).to_bytes(4, "little") + bytes([width]) + squeezed(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(unsqueezed(data[5:]), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def packed_ascending(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def gram_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The hash of a word or n-gram followed by a word, from theirs."""
    with np.errstate(over="ignore"):
        return mix64(mix64(before) * np.uint64(3) + after)


def _ranges(h: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of those of ``parts`` equal hash ranges that ascending ``h`` reaches."""
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
    return [(t, a, b) for t, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class Texts:
    """A block's texts: ``flat`` has for each row two words of context (-1: none) and its tokens."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, train: np.ndarray, size: int):
        self.flat, self.lengths, self.size = flat, lengths, size
        self.starts = np.cumsum(lengths + 2) - lengths
        self.token = np.ones(len(flat), bool)
        self.token[self.starts - 1] = self.token[self.starts - 2] = False
        self.train = np.repeat(train, lengths + 2) & self.token
        paired = self.token.copy()
        paired[self.starts - 1] = flat[self.starts - 2] >= 0
        at = np.flatnonzero(paired)
        self.pairs, which = np.unique(flat[at - 1] * size + flat[at], return_inverse=True)
        #: at each word, the pair that it ends; -1: none
        self.pair = np.full(len(flat), -1)
        self.pair[at] = which
        self.own = np.bincount(which, weights=self.train[at], minlength=len(self.pairs)).astype(np.uint64)

    def hashes(self, h: np.ndarray) -> np.ndarray:
        """Of the pairs, from the words'."""
        return gram_hash(h[self.pairs // self.size], h[self.pairs % self.size])

    def triples(self, seen: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Triples of trained pairs as pair * size + word, their counts in this block, and which of them to ask for."""
        at = np.flatnonzero(self.token)
        at = at[self.pair[at - 1] >= 0]
        at = at[(seen[self.pair[at - 1]] > 0) & (seen[self.pair[at]] > 0)]
        triples, which = np.unique(self.pair[at - 1] * self.size + self.flat[at], return_inverse=True)
        second = np.zeros(len(triples), np.int64)
        second[which] = self.pair[at]
        own = np.bincount(which, weights=self.train[at], minlength=len(triples))
        return triples, own, shared[triples // self.size] & shared[second]


class Block:
    """Texts by places in a word list of their own."""

    def __init__(self):
        self.words, self.rows, self.bytes = _Words(), [], 0
        self.words[END]

    def add(self, row: int, key, train: bool, before: list[bytes], data: bytes, last: bool) -> list[bytes]:
        """Add a piece that the words ``before`` go ahead of; returns the words ahead of the next one."""
        found = data.split()
        context = [self.words[w] for w in before]
        ids = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        self.rows.append((row, key, train, np.concatenate([[-1] * (2 - len(context)), context, ids, [0] * last]).astype(np.int64)))
        self.bytes += len(data)
        return (before + found[-2:])[-2:]

    def records(self, parts: int) -> Iterator[tuple]:
        """(kind, target, rows, keys, train, data, counts, lengths) of this block's texts, words and pairs."""
        words = list(self.words)
        h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        rows, keys, train, flat = zip(*self.rows, strict=True)
        lengths = np.array([len(x) - 2 for x in flat])
        texts = Texts(np.concatenate(flat), lengths, np.array(train), len(words))
        # the hashes in order of appearance, as the texts name the words
        yield "texts", 0, list(rows), list(keys), list(train), packed(texts.flat + 1), packed(h), packed(lengths)
        order = np.argsort(h, kind="stable")
        counts = np.bincount(texts.flat[texts.train], minlength=len(words))[order]
        for t, a, b in _ranges(h[order], parts):
            yield "words", t, None, None, None, squeezed(b" ".join(words[k] for k in order[a:b])), packed(counts[a:b]), None
        ph = texts.hashes(h)
        order = np.argsort(ph, kind="stable")
        ph, counts = ph[order], texts.own[order]
        for t, a, b in _ranges(ph, parts):
            yield "grams", t, None, None, None, packed_ascending(ph[a:b]), packed(counts[a:b]), None


_ROWS = "target int, block long, row array<long>, {key} train array<boolean>, data binary, counts binary, lengths binary, kind string"
_ASKED = "target int, block long, data binary, counts binary"
_ANSWERS = "block long, kind string, target int, counts binary, n long, v long"


def _blocks(parts: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        block, n_blocks, n_rows = Block(), 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for kind, target, rows, keys, train, data, counts, lengths in block.records(parts):
                held.append((target, base + n_blocks, rows, keys, train, data, counts, lengths, kind))
                size += len(data) + len(counts)
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            for key, text, train in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                before, n_rows = [END], n_rows + 1
                parts_of = list(pieces(text.encode().lower(), BLOCK))
                for k, data in enumerate(parts_of):
                    before = block.add(base + n_rows, key, train, before, data, k == len(parts_of) - 1)
                    if block.bytes >= BLOCK:
                        yield from out()
                        block, n_blocks = Block(), n_blocks + 1
        if block.rows:
            yield from out()

    return run


def _word_totals(rows: pa.Table) -> pa.Table:
    """Adds up the words of one hash range; answers each block; n and v of the range in a row of its own."""
    known, lists, blocks = _Words(), [], rows.column("block").to_pylist()
    for data in rows.column("data"):
        lists.append(np.fromiter(map(known.__getitem__, unsqueezed(data.as_py()).split(b" ")), np.int64))
    total = np.zeros(len(known), np.uint64)
    for ids, counts in zip(lists, rows.column("counts"), strict=True):
        total[ids] += unpacked(counts.as_py())
    target = rows.column("target")[0].as_py()
    m = len(blocks)
    return pa.table([
        pa.array([*blocks, None], pa.int64()), pa.array(["words"] * m + ["sums"]), pa.array([target] * (m + 1), pa.int32()),
        pa.array([*(packed(total[ids]) for ids in lists), None], pa.binary()), pa.array([None] * m + [int(total.sum())], pa.int64()), pa.array([None] * m + [int((total > 0).sum())], pa.int64()),
    ], ["block", "kind", "target", "counts", "n", "v"])


def _gram_totals(kind: str):
    def run(rows: pa.Table) -> pa.Table:
        """Adds up the n-grams of one hash range; answers twice the total, and one more where several blocks ask."""
        lists = [unpacked_ascending(x.as_py()) for x in rows.column("data")]
        cuts = np.cumsum([0, *map(len, lists)])
        distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
        del lists
        counts = np.concatenate([unpacked(x.as_py()) for x in rows.column("counts")])
        answer = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64) * np.uint64(2) + (np.bincount(place) > 1)
        m = rows.num_rows
        return pa.table([
            rows.column("block"), pa.array([kind] * m), rows.column("target"), pa.array([packed(answer[place[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
        ], ["block", "kind", "target", "counts", "n", "v"])

    return run


class Automaton:
    """States: words by their places, then the pairs, then the root. Arcs are sorted by state and word."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, seen: np.ndarray, triples: np.ndarray, found: np.ndarray, n: int, v: int, concentrations: tuple[float, float]):
        """``triples`` are place in ``pairs`` * words + word; ``seen`` and ``found`` count pairs and triples."""
        k2, k3 = concentrations
        self.size = size = len(counts)
        self.root_state = size + len(pairs)
        unigram = (counts + 1.0) / (n + v + 1)
        self.root = np.log10(unigram)
        first, second = pairs // size, pairs % size
        bigram = (seen + k2 * unigram[second]) / (counts[first] + k2)
        #: where the failure arc of a state leads, and its weight
        self.failure = np.concatenate([np.full(size, self.root_state), second])
        self.back_off = np.log10(np.concatenate([k2 / (counts + k2), k3 / (seen + k3)]))
        there, trained = seen > 0, found > 0
        context, word = triples[trained] // size, triples[trained] % size
        # the pair that a triple ends with
        after = np.searchsorted(pairs, second[context] * size + word)
        trigram = (found[trained] + k3 * bigram[after]) / (seen[context] + k3)
        self.pairs, self.there = pairs, there
        self.arcs = np.concatenate([pairs[there], (size + context) * size + word])
        self.weights = np.log10(np.concatenate([bigram[there], trigram]))
        self.targets = size + np.concatenate([np.flatnonzero(there), after])

    def state_after(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The states that words u, v lead to, u -1 where there is none: that of the pair if trained, else of v."""
        if not len(self.pairs):
            return v
        key = np.maximum(u, 0) * self.size + v
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((u >= 0) & (self.pairs[at] == key) & self.there[at], self.size + at, v)

    def read(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state read a word; the states then, and the weights of the arcs on the way."""
        weights, after = np.zeros(len(words)), np.empty(len(words), np.int64)
        open_, state, word = np.arange(len(words)), states, words
        while len(open_):
            if len(self.arcs):
                key = state * self.size + word
                at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = self.arcs[at] == key
                weights[open_[hit]] += self.weights[at[hit]]
                after[open_[hit]] = self.targets[at[hit]]
                miss = ~hit
                open_, state, word = open_[miss], state[miss], word[miss]
            weights[open_] += self.back_off[state]
            state = self.failure[state]
            at_root = state == self.root_state
            weights[open_[at_root]] += self.root[word[at_root]]
            after[open_[at_root]] = word[at_root]
            open_, state, word = open_[~at_root], state[~at_root], word[~at_root]
        return after, weights

    def scores(self, texts: Texts) -> np.ndarray:
        """For each row the sum of the weights on its way. Rows are read side by side, long ones in lanes of ``LANE`` words."""
        lanes = -(-texts.lengths // LANE)
        row = np.repeat(np.arange(len(lanes)), lanes)
        offset = LANE * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        begin, length = texts.starts[row] + offset, np.minimum(LANE, texts.lengths[row] - offset)
        order = np.argsort(-length, kind="stable")
        row, begin, length = row[order], begin[order], length[order]
        state = self.state_after(texts.flat[begin - 2], texts.flat[begin - 1])
        total = np.zeros(len(row))
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, side="left"))
            state, weights = self.read(state[:n], texts.flat[begin[:n] + k])
            total[:n] += weights
        return np.bincount(row, weights=total, minlength=len(texts.lengths))


class _Met:
    """A block's texts, with what the ranges have answered so far."""

    def __init__(self, left: pa.Table, right: pa.Table):
        record = left.to_pylist()[0]
        self.rows, self.keys, self.train = record["row"], left.column("key").combine_chunks().flatten(), record["train"]
        self.h = unpacked(record["counts"])
        self.texts = Texts(unpacked(record["data"]).astype(np.int64) - 1, unpacked(record["lengths"]).astype(np.int64), np.array(self.train), len(self.h))
        got: dict[str, list] = {"words": [], "pairs": [], "triples": []}
        for kind, target, counts in zip(*(right.column(c).to_pylist() for c in ("kind", "target", "counts")), strict=True):
            got[kind].append((target, counts))
        # answers come in the order of the hashes
        self._answers = {k: np.concatenate([np.zeros(0, np.uint64), *(unpacked(c) for _, c in sorted(x))]) for k, x in got.items()}
        self.counts = self._placed("words", self.h).astype(np.float64)
        self.pair_hashes = self.texts.hashes(self.h)
        pairs = self._placed("pairs", self.pair_hashes)
        self.seen = (pairs >> np.uint64(1)).astype(np.float64)
        self.triples, self.found, self.asked = self.texts.triples(self.seen, (pairs & np.uint64(1)) > 0)
        wanted = self.triples[self.asked]
        self.triple_hashes = gram_hash(self.pair_hashes[wanted // len(self.h)], self.h[wanted % len(self.h)])

    def _placed(self, kind: str, hashes: np.ndarray) -> np.ndarray:
        out = np.empty(len(hashes), np.uint64)
        out[np.argsort(hashes, kind="stable")] = self._answers[kind]
        return out

    def with_triples(self) -> _Met:
        self.found[self.asked] = self._placed("triples", self.triple_hashes) >> np.uint64(1)
        return self


def _ask_triples(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        met, block = _Met(left, right), left.column("block")[0].as_py()
        order = np.argsort(met.triple_hashes, kind="stable")
        h, own = met.triple_hashes[order], met.found[met.asked][order].astype(np.uint64)
        asked = [(t, block, packed_ascending(h[a:b]), packed(own[a:b])) for t, a, b in _ranges(h, parts)]
        return pa.table([pa.array([x[k] for x in asked], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["target", "block", "data", "counts"])

    return run


def _score_block(n: int, v: int, concentrations: tuple[float, float]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        met = _Met(left, right).with_triples()
        texts = met.texts
        automaton = Automaton(met.counts, texts.pairs, met.seen, met.triples, met.found, n, v, concentrations)
        row_of = np.repeat(np.arange(len(texts.lengths)), texts.lengths)
        tokens = texts.flat[texts.token]
        base = np.bincount(row_of, weights=automaton.root[tokens], minlength=len(texts.lengths))
        known = np.bincount(row_of, weights=met.counts[tokens] > 0, minlength=len(texts.lengths)).astype(np.int64)
        return pa.table([pa.array(met.rows, pa.int64()), met.keys, pa.array(met.train), pa.array(texts.lengths), pa.array(known), pa.array(base), pa.array(automaton.scores(texts))], ["row", "key", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", concentrations: tuple[float, float] = CONCENTRATIONS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from the rows where ``train`` holds and scores all rows.
    """
    spark = docs.sparkSession
    wide = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = wide.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = -(-size // RANGE) + 1
    key = wide.schema["key"].dataType
    schema = spark.createDataFrame([], _ROWS.format(key=f"key array<{key.simpleString()}>,")).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    path = scratch(spark, "lm-blocks")
    asked = path + "-answers"
    with shuffles_removed(spark):
        in_small_batches(wide).mapInArrow(frugal(_blocks(parts, to_arrow_schema(schema))), schema).write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
        stored = spark.read.schema(schema).parquet(path)
        of = lambda kind: stored.where(F.col("kind") == kind).select("target", "block", "data", "counts").groupBy("target")
        of("words").applyInArrow(_word_totals, _ANSWERS).write.parquet(asked)
        # what is answered is needed no more
        removed(spark, f"{path}/kind=words")
        of("grams").applyInArrow(_gram_totals("pairs"), _ANSWERS).write.mode("append").parquet(asked)
        removed(spark, f"{path}/kind=grams")
        texts = spark.read.schema(schema).parquet(path).where("kind = 'texts'").drop("kind", "target").groupBy("block")
        read = lambda: spark.read.schema(_ANSWERS).parquet(asked).where("kind <> 'sums'").drop("n", "v").groupBy("block")
        triples = texts.cogroup(read()).applyInArrow(_ask_triples(parts), _ASKED)
        triples.groupBy("target").applyInArrow(_gram_totals("triples"), _ANSWERS).write.parquet(asked + "-triples")
    answers = spark.read.schema(_ANSWERS).parquet(asked, asked + "-triples")
    sums = answers.where("kind = 'sums'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    long, double = F.lit(0).cast("long"), F.lit(0.0)
    out = wide.select(long.alias("row"), "key", "train", long.alias("n_tokens"), long.alias("n_known"), double.alias("base_score"), double.alias("score")).schema
    scored = texts.cogroup(answers.where("kind <> 'sums'").drop("n", "v").groupBy("block")).applyInArrow(_score_block(sums["n"], sums["v"], concentrations), out)
    # the parts of a long text
    whole = scored.groupBy("row").agg(F.first("key").alias(id_col), F.first("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select(id_col, "train", "n_tokens", "n_known", F.lit(sums["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = crc_mod("doc_id", 7, 2)
    scored = score_texts(docs, ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
