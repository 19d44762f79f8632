"""Language ID: nearest of several TF-IDF n-gram centroids per language, by cosine.

A text becomes a vector of its letter n-grams (one to three bytes of the lower-case
text, everything but letters folded to one space), hashed to ``2**BITS`` places,
weighted ``log(1 + count) * idf`` and scaled to length one. Spherical k-means over a
bounded sample of each language gives ``CENTROIDS`` centroids per language. A text
takes the language of the nearest centroid; the cosine is its score. A text further
from its centroid than nearly all training texts of that language is marked rejected.

Defined cases: a null text, and a text without any letter, give ``und`` and score 0;
texts of any length are counted whole, in segments; rows with a null language are not
learned from; without any training row every text is ``und``; repeated rows each get a
row; ties go to the language that sorts first. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import byte_ngrams, crc_mod, frugal, hashed_share, in_small_batches, segments, text_or_empty

SIZES = (1, 2, 3)
BITS = 12
#: Training texts of each language, chosen by a hash of their ids and texts.
SAMPLE_ROWS = 400
CENTROIDS = 4
#: Share of a language's training texts that its own rejection distance leaves out.
REJECTED_SHARE = 0.005
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts by place of all letter n-grams of a whole text; None without a letter."""
    counts = np.zeros(1 << BITS, np.float32)
    found = False
    for part in segments(text or ""):
        letters = _NOT_LETTERS.sub(" ", part.lower()).strip()
        # marks and other word characters that are no letters don't make a language
        if not any(map(str.isalpha, letters[:64])) and not any(map(str.isalpha, letters)):
            continue
        found = True
        counts += np.bincount(byte_ngrams(f" {letters} ".encode(), SIZES, BITS), minlength=1 << BITS)
    return counts if found else None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row for each centroid
    owner: np.ndarray  # the place of a centroid's language
    radius: np.ndarray  # by language: the least cosine that is not rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the cosine (0 to 1), and whether the text lies too far from it."""
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0, True
        near = self.centroids @ _unit(np.log1p(counts) * self.idf)
        best = int(near.argmax())
        cosine = float(min(1.0, max(0.0, near[best])))
        return self.languages[self.owner[best]], cosine, bool(near[best] < self.radius[self.owner[best]])


def fit(counts: dict[str, np.ndarray], centroids: int = CENTROIDS, rounds: int = 12) -> LanguageModel:
    """Fit on count vectors by language; the same input gives the same model."""
    languages = sorted(k for k, v in counts.items() if len(v))
    size = 1 << BITS
    if not languages:
        return LanguageModel([], np.zeros(size, np.float32), np.zeros((0, size), np.float32), np.zeros(0, int), np.zeros(0))
    total = sum(len(counts[k]) for k in languages)
    seen = sum((counts[k] > 0).sum(0) for k in languages)
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + 1
    found, owner, radius = [], [], []
    for place, language in enumerate(languages):
        x = _unit(np.log1p(counts[language]) * idf)
        # the first centre is the mean, each further one the text that is least like all before
        centres = _unit(x.mean(0, keepdims=True))
        while len(centres) < min(centroids, len(x)):
            centres = np.vstack([centres, x[(x @ centres.T).max(1).argmin()]])
        for _ in range(rounds):
            nearest = (x @ centres.T).argmax(1)
            centres = np.vstack([_unit(x[nearest == k].mean(0)) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        found.append(centres)
        owner += [place] * len(centres)
        radius.append(np.quantile((x @ centres.T).max(1), REJECTED_SHARE))
    return LanguageModel(languages, idf, np.vstack(found).astype(np.float32), np.array(owner), np.array(radius))


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(x, c) for x, c in zip(batch.column("lang").to_pylist(), map(ngram_counts, batch.column("text").to_pylist()), strict=True) if c is not None]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([c.astype(np.float32).tobytes() for _, c in rows], pa.binary())], ["lang", "counts"])


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on the documents that have a language; ``usable`` limits them."""
    known = docs.where(F.col(lang_col).isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("id", "text")).alias("n")).collect()}
    counts: dict[str, np.ndarray] = {}
    chosen = F.lit(False)
    for language, n in sorted(rows.items()):
        chosen = chosen | ((F.col("lang") == language) & hashed_share(n, sample_rows, "id", "text"))
    # rows that agree in id and text count once, so about sample_rows of each language are drawn
    drawn = known.where(chosen).dropDuplicates(["lang", "id", "text"]).select("lang", "text")
    sample = drawn.mapInArrow(_with_counts, "lang string, counts binary")
    by: dict[str, list[bytes]] = {}
    for r in sample.collect():
        by.setdefault(r["lang"], []).append(bytes(r["counts"]))
    for language, vectors in by.items():
        counts[language] = np.vstack([np.frombuffer(v, np.float32) for v in sorted(vectors)])
    return fit(counts)


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``lang_pred``, ``score``, ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            found = [mine.predict(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [batch.schema.names[0], "lang_pred", "score", "rejected"])

    wide = docs.select(id_col, text_or_empty(text_col).alias("_predicted_text"))
    schema = wide.select(id_col, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema
    return in_small_batches(wide).mapInArrow(frugal(run), schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang"), usable=~crc_mod("doc_id", 4, 2))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", crc_mod("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
