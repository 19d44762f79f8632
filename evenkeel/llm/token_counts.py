"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie over symbols: bytes, and a word's last byte as a symbol of its
own, since pieces with a word-end mark only end words and the others never do. Each node carries a failure link, the node that
is left when the pieces that can no longer grow have been cut off, and the number of
pieces cut off on the way. Reading a word then takes one step for each byte and never
goes back, and no piece is built: the counts on the failure links add up.

The pieces are the strings of a byte-level vocabulary with word-end marks. Since every
byte is a piece, within words and as their end, every word has a segmentation.

Words are those of the tokenizer that the vocabulary comes from: contractions, runs of
letters, single digits, and runs of other characters that are not white space, of the
text in Unicode's composed form, each character in lower case.

Defined cases: null and empty texts count 0 words and 0 tokens; texts of any length
are counted whole; repeated rows each get a row; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import frugal, in_small_batches, portions, text_or_empty

#: Words whose counts a worker remembers.
REMEMBERED = 200_000
#: Bytes of text that are counted at once.
HELD_BYTES = 4 << 20
#: A closing mark after a digit or a Latin-1 letter, whose lower-case forms are letters too.
_CLOSED = "[0-9A-Za-zÀ-ÖØ-öø-ÿ][.,]$"

# fixed values: the word pattern of the public tokenizer file
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes in order for
    the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


#: What a word's last byte has on top.
LAST = 256


def symbols(word: bytes) -> list[int]:
    return [*word[:-1], word[-1] | LAST] if word else []


def read_pieces(path: str) -> set[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file as symbols, single ones always among them."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    table = byte_of_symbol()
    pieces = {(k,) for k in range(2 * LAST)}
    for t in tokens:
        string = t.removesuffix(WORD_END)
        if string and all(c in table for c in string):
            data = bytes(table[c] for c in string)
            pieces.add(tuple(symbols(data) if t.endswith(WORD_END) else data))
    return pieces


class LongestMatch:
    """Counts the greedy longest-match pieces of words in one pass; every symbol has to be a piece."""

    def __init__(self, pieces: Iterable[Sequence[int]]):
        child: dict[int, int] = {}
        whole = [False]
        order: list[tuple[int, int, int]] = []  # node, parent, symbol
        for piece in sorted(set(map(tuple, pieces))):
            node = 0
            for b in piece:
                nxt = child.get(node << 9 | b)
                if nxt is None:
                    nxt = child[node << 9 | b] = len(whole)
                    whole.append(False)
                    order.append((nxt, node, b))
                node = nxt
            whole[node] = bool(node)
        depth = [0] * len(whole)
        for node, parent, _ in order:
            depth[node] = depth[parent] + 1
        # links lead from longer strings to shorter ones, so shallow nodes come first
        order.sort(key=lambda x: depth[x[0]])
        link, popped = [-1] * len(whole), [0] * len(whole)
        for node, parent, b in order:
            if whole[node]:
                link[node], popped[node] = 0, 1
                continue
            at, count = link[parent], popped[parent]
            while at >= 0 and (at << 9 | b) not in child:
                count += popped[at]
                at = link[at]
            if at >= 0:
                link[node], popped[node] = child[at << 9 | b], count
        self._link, self._popped = np.array(link), np.array(popped)
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        self._keys, self._nodes = keys[order], np.fromiter(child.values(), np.int64, len(child))[order]

    def count(self, words: list[bytes]) -> np.ndarray:
        """How many pieces each word has. All words are read side by side, a symbol at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        total = np.zeros(len(words), np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        data[ends[lengths > 0] - 1] |= LAST
        begin, falling = (ends - lengths)[order], -lengths[order]
        node = np.zeros(len(words), np.int64)
        for k in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(falling, -k, side="left"))
            lane, now, symbol = np.arange(n), node[:n].copy(), data[begin[:n] + k]
            while len(lane):
                key = now << 9 | symbol
                at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
                hit = self._keys[at] == key
                node[lane[hit]] = self._nodes[at[hit]]
                lane, now, symbol = lane[~hit], now[~hit], symbol[~hit]
                total[lane] += self._popped[now]
                now = self._link[now]
        lane = np.flatnonzero(node)
        while len(lane):
            total[lane] += self._popped[node[lane]]
            node[lane] = self._link[node[lane]]
            lane = lane[node[lane] > 0]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


class TokenCounter:
    """Words and tokens of texts; words between white space are counted once and remembered.

    Arrow splits the texts and finds the distinct chunks. A closing mark after a digit or
    a Latin-1 letter is a word of its own, of one piece.
    """

    def __init__(self, path: str):
        self._automaton = LongestMatch(read_pieces(path))
        #: words times 2**32 plus tokens
        self._known: dict[str, int] = {}

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(chunks.flatten())
        upto = chunks.offsets.to_numpy().astype(np.int64)
        summed = np.concatenate([[0], np.cumsum(self._of(coded.dictionary)[coded.indices.to_numpy()])])
        total = np.diff(summed[upto - upto[0]])
        return total >> 32, total & 0xFFFFFFFF

    def _of(self, chunks: pa.Array) -> np.ndarray:
        marked = pc.match_substring_regex(chunks, _CLOSED)
        words = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        coded = pc.dictionary_encode(pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words))
        found = self._counts(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return found + marked.to_numpy(zero_copy_only=False) * ((1 << 32) + 1)

    def _counts(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > REMEMBERED:
            # the half that was learned first goes, and what of it is met again is learned again
            known = self._known = dict(islice(known.items(), len(known) // 2, None))
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn([words[k] for k in new.tolist()])
        return found

    def _learn(self, chunks: list[str]) -> np.ndarray:
        owners, words = [], []
        for k, chunk in enumerate(chunks):
            if chunk.isascii() and chunk.isalpha():
                owners.append(k)
                words.append(chunk.encode())
            else:
                found = WORDS.findall("".join(map(str.lower, unicodedata.normalize("NFC", chunk))))
                owners += [k] * len(found)
                words += [w.encode() for w in found]
        out = np.zeros(len(chunks), np.int64)
        np.add.at(out, np.array(owners, np.int64), self._automaton.count(words) + (1 << 32))
        self._known.update(zip(chunks, out.tolist(), strict=True))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """This worker's counter for a vocabulary file."""
    return TokenCounter(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: the columns in ``keep`` (the id if not given), ``n_words``, ``n_tokens``.

    Kept columns of these two names give way.
    """
    keep, path = [c for c in ([id_col] if keep is None else keep) if c not in ("n_words", "n_tokens")], path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(path)
        for batch in batches:
            found = [mine.count(texts) for texts in portions(batch.column(0), HELD_BYTES)]
            counts = [pa.array(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts], [*batch.schema.names[1:], "n_words", "n_tokens"])

    wide = docs.select(text_or_empty(text_col).alias("_counted_text"), *keep)
    schema = wide.select(*keep, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens")).schema
    return in_small_batches(wide).mapInArrow(frugal(run), schema)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs.select("doc_id", "text"))
