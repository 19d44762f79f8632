"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Training: labels of at most ``SAMPLE_ROWS`` rows of each class are drawn by a hash
of their ids. Each text becomes the set of its byte n-grams (white space folded,
ASCII lower case), hashed to ``2**BITS`` features. A feature's value is its log-count
ratio, the logarithm of how much more often toxic documents have it; a logistic
regression over these values gives the weights. A score is the sum of the weights of
the n-grams that a text has, through the logistic function.

Defined cases: a null text counts as empty and gets the score of the intercept; texts
of any length are scored whole, in segments; repeated rows each get a row; labels with
a null id or null label are not used, and of contradicting labels of an id the larger
one counts; without any usable label all scores are 0. An empty table gives an empty
result. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import byte_ngrams, crc_mod, frugal, hashed_share, in_small_batches, segments, text_or_empty

SIZES = (3, 4, 5, 6)
BITS = 18
#: Labelled rows of each class that training reads, chosen by a hash of their ids.
SAMPLE_ROWS = 2000
#: Standard deviations by which an n-gram's toxic count must leave its expectation.
SURPRISE = 6.0


def features(text: str | None) -> np.ndarray:
    """The sorted distinct feature indices of a whole text."""
    data = b" " + b" ".join((text or "").encode().lower().split()) + b" "
    seen = np.zeros(1 << BITS, bool)
    for part in segments(data, overlap=max(SIZES) - 1):
        seen[byte_ngrams(part, SIZES, BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


class PackedSets:
    """Feature sets that are unpacked one by one, as often as they are gone through."""

    def __init__(self, blobs: list[bytes]):
        self._blobs = blobs

    def __len__(self) -> int:
        return len(self._blobs)

    def __iter__(self) -> Iterator[np.ndarray]:
        for blob in self._blobs:
            planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
            yield np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.int64)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = float(self.weights[features(text)].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: PackedSets | list[np.ndarray], labels: np.ndarray, alpha: float = 0.5, decay: float = 1e-3, steps: int = 200) -> ToxicityModel:
    """Fit on feature sets and 0/1 labels. Without both classes the score is constant."""
    labels = np.asarray(labels, np.float64)
    size, positive = 1 << BITS, labels.sum()
    if not len(rows) or positive in (0, len(labels)):  # a constant score
        return ToxicityModel(np.zeros(size, np.float32), 40.0 if len(rows) and positive else -40.0)
    in_toxic, in_clean = np.zeros(size), np.zeros(size)
    for r, y in zip(rows, labels, strict=True):
        (in_toxic if y else in_clean)[r] += 1
    ratio = np.log((in_toxic + alpha) / (positive + 2 * alpha)) - np.log((in_clean + alpha) / (len(labels) - positive + 2 * alpha))
    # only n-grams whose toxic count is beyond what chance makes of so many features say
    # something about other documents
    share = positive / len(labels)
    expected = (in_toxic + in_clean) * share
    surprise = (in_toxic - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    ratio[(np.abs(surprise) < SURPRISE) | (np.maximum(in_toxic, in_clean) < 4)] = 0
    used = np.flatnonzero(ratio)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = [p[p >= 0] for p in (place[r] for r in rows)]
    column = np.concatenate(kept)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in kept])
    value = ratio[used][column]
    # of each class half the weight, so that the threshold does not follow the labels' share
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (len(labels) - positive))
    norm = max(1e-9, float((np.bincount(row, weights=value * value, minlength=len(rows)) * weight).sum()))
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[column] * value, minlength=len(rows)) + b
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        grad = np.append(np.bincount(column, weights=slope[row] * value, minlength=len(used)) + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1.0 / np.sqrt(norm))
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size, np.float32)
    weights[used] = w * ratio[used]
    return ToxicityModel(weights, float(b))


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [packed(features(x)) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sets, pa.binary())], ["toxic", "features"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Train on the labelled documents; ``usable`` limits the rows of ``labels``."""
    known = labels.where(usable) if usable is not None else labels
    known = known.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # ids are distinct here, so the share is about sample_rows, and the limit only bounds what is broadcast
    parts = [known.where((F.col("toxic") == c) & hashed_share(counts.get(c, 0), sample_rows, "id")).orderBy(F.xxhash64("id"), "id").limit(2 * sample_rows) for c in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(sample, "id")
    # an id that several texts have is learned by one of them, whichever way they are dealt out
    once = texts.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    got = once.select(F.col("first.text").alias("text"), "toxic").mapInArrow(_with_features, "toxic int, features binary").collect()
    got.sort(key=lambda r: (r["toxic"], bytes(r["features"])))
    return fit(PackedSets([bytes(r["features"]) for r in got]), np.array([r["toxic"] for r in got]))


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: the columns in ``keep`` (the id if not given), ``score``, ``predicted``.

    Kept columns of these two names give way.
    """
    keep = [c for c in ([id_col] if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = ToxicityModel(*shared.value)
        for batch in batches:
            scores = pa.array([mine.score(x) for x in batch.column(0).to_pylist()], pa.float64())
            predicted = pa.array([int(x >= 0.5) for x in scores.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores, predicted], [*batch.schema.names[1:], "score", "predicted"])

    wide = docs.select(text_or_empty(text_col).alias("_scored_text"), *keep)
    schema = wide.select(*keep, F.lit(0.0).alias("score"), F.lit(0).cast("int").alias("predicted")).schema
    return in_small_batches(wide).mapInArrow(frugal(run), schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, usable=~crc_mod("doc_id", 5, 0))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", crc_mod("doc_id", 5, 0).alias("held_out"), "score", "predicted")
