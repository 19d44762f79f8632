"""Secret scans: known formats, and strings that pass a battery of randomness tests.

Known formats are three patterns: assignments to a secret's name, access keys, and long
hexadecimal runs. The method adds further spans of kind ``random``: runs of at least
``SHORTEST`` characters of an encoding's alphabet that mix letters with digits, or both
cases, as encoded keys do, and of which a random string would hold ``LEAST_BITS`` bits.
For each run the encoding is inferred from its characters (``ALPHABETS``), and a battery
of tests asks two questions of it.

* *Could it be text-like?* Under this hypothesis its characters are independent draws
  with the frequencies of names and words in that encoding (``LIKE_TEXT``). Three tests
  reject it in favour of randomness: chi-squared, the counts are more even than such
  draws make them; runs, the sequence of "above" and "below" the alphabet's middle
  changes more often; and letters, equal frequencies explain them better than those of
  ``LETTERS`` (by Markov's inequality the likelihood ratio bounds the p-value). The first
  two are combined by Fisher's method, and with the third by Bonferroni's. Real names
  repeat letters more and change less often than independent draws, so these are upper bounds.
* *Could it be uniformly random?* Chi-squared against equal frequencies, runs against
  independent draws, and the serial correlation of ranks, all two-sided or in the
  direction of order, combined in the same way. A run that fails at ``ORDERLY``, such as
  an alphabet written out, is no candidate.

Spans are the runs whose text-likeness is rejected by a weighted Benjamini-Hochberg
procedure over the candidates of the document, at level ``LEVEL``: what is controlled is
the expected share of text-like runs among the reported ones. Weights rise with length,
since the tests have more power over long runs. Digits alone are an encoding of their
own, for which ordinary numbers and random ones are alike, and never reported.

Defined cases: a null text counts as empty and has no spans; texts of any length are
scanned whole; repeated rows each get a row; an empty table gives an empty result; only
the named columns are read. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import frugal, in_small_batches, text_or_empty

KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20
LEAST_BITS = 80
LEVEL = 0.01
ORDERLY = 0.001
REDACTED = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
_DIGIT, _LOWER, _UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")

#: Alphabets in the order of their values, the narrowest that holds a run is its encoding.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_RANKS = {name: {c: k for k, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
#: Shares of digits and upper-case letters among the characters of text-like runs, by encoding; the rest is lower case.
LIKE_TEXT = {
    "digits": (1.0, 0.0), "hex": (0.9, 0.0), "HEX": (0.9, 0.1), "base32": (0.15, 0.85), "upper": (0.15, 0.85),
    "lower": (0.15, 0.0), "base62": (0.15, 0.15), "base64": (0.15, 0.15), "base64url": (0.15, 0.15),
}
# fixed values: letters of English text, in percent
LETTERS = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}


def text_frequencies(encoding: str) -> list[float]:
    """How often each character of the alphabet is met in text-like runs."""
    digits, upper = LIKE_TEXT[encoding]
    chars = ALPHABETS[encoding]

    def share(c: str) -> float:
        if c.isdigit():
            return digits / sum(x.isdigit() for x in chars)
        kind, part = (str.isupper, upper) if c.isupper() else (str.islower, 1 - digits - upper)
        return part * LETTERS.get(c.lower(), 0.0) / sum(LETTERS[x.lower()] for x in chars if kind(x)) if c.isalpha() else 0.0

    return [share(c) for c in chars]


def _moments(encoding: str) -> tuple[float, float, float]:
    """Of text-like characters: the chances that two agree, that three agree, that neighbours are on two sides of the middle."""
    q = text_frequencies(encoding)
    above = sum(p for k, p in enumerate(q) if 2 * k >= len(q))
    return sum(p * p for p in q), sum(p**3 for p in q), 2 * above * (1 - above)


def _letter_ratios(encoding: str) -> dict[str, float]:
    """For each letter the log of its share among equally frequent letters of its case by that in text."""
    out = {}
    for kind in (str.isupper, str.islower):
        case = [c for c in ALPHABETS[encoding] if kind(c)]
        total = sum(LETTERS[c.lower()] for c in case)
        out |= {c: math.log(total / len(case) / LETTERS[c.lower()]) for c in case}
    return out


_UNIFORM_TO_TEXT = {name: _letter_ratios(name) for name in ALPHABETS}
_MOMENTS = {name: _moments(name) for name in ALPHABETS}


def encoding_of(run: str) -> str | None:
    """The narrowest alphabet that holds every character of ``run``."""
    used = set(run)
    return next((name for name, ranks in _RANKS.items() if used <= ranks.keys()), None)


def chi_squared_tail(x: float, k: int) -> float:
    """P(X >= x) for a chi-squared variable of k degrees, by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _fisher(p_values: list[float]) -> float:
    """The combined p-value: with an even number of degrees of freedom the tail is a finite sum."""
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)
    term = total = 1.0
    for k in range(1, len(p_values)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def _sides(x: list[int], size: int) -> tuple[int, int]:
    """How many ranks are above the middle, and how often neighbours are on two sides."""
    above = [2 * v >= size for v in x]
    return sum(above), sum(map(operator.ne, above, above[1:]))


def _evenness(x: list[int], size: int) -> float:
    """The chi-squared statistic against equal frequencies."""
    return sum(c * c for c in Counter(x).values()) * size / len(x) - len(x)


def randomness(run: str, encoding: str) -> float:
    """The combined p-value of the hypothesis that ``run`` is uniformly random."""
    ranks, n = _RANKS[encoding], len(run)
    x = [ranks[c] for c in run]
    size = len(ranks)
    uniform = chi_squared_tail(_evenness(x, size), size - 1)
    n1, switches = _sides(x, size)
    n0 = n - n1
    if n1 and n0:
        mean = 1 + 2 * n0 * n1 / n
        spread = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        changes = _two_sided((1 + switches - mean) / math.sqrt(spread))
    else:
        changes = 2.0 ** (1 - n)
    middle = sum(x) / n
    var = sum((v - middle) ** 2 for v in x)
    if var:
        r = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False)) / var
        serial = _two_sided((r + 1 / n) * math.sqrt(n))
    else:
        serial = 2.0 ** (1 - n)
    return _fisher([uniform, changes, serial])


def text_likeness(run: str, encoding: str) -> float:
    """The combined p-value of the hypothesis that ``run`` is text-like, against more even and more changing ones."""
    if encoding == "digits":
        return 1.0
    ranks, n = _RANKS[encoding], len(run)
    x = [ranks[c] for c in run]
    size = len(ranks)
    two, three, side = _MOMENTS[encoding]
    # the statistic counts agreeing pairs, whose mean and variance under independent draws are known
    agreeing = sum(c * (c - 1) for c in Counter(x).values())
    spread = 2 * n * (n - 1) * (two - two * two) + 4 * n * (n - 1) * (n - 2) * (three - two * two)
    even = 0.5 * math.erfc(-(agreeing - n * (n - 1) * two) / math.sqrt(2 * spread))
    switches = _sides(x, size)[1]
    changing = sum(math.comb(n - 1, k) * side**k * (1 - side) ** (n - 1 - k) for k in range(switches, n)) if n < 400 else 0.5 * math.erfc((switches - 0.5 - (n - 1) * side) / math.sqrt(2 * (n - 1) * side * (1 - side)))
    ratio = sum(_UNIFORM_TO_TEXT[encoding].get(c, 0.0) for c in run)
    return min(1.0, 2 * min(_fisher([even, changing]), math.exp(min(0.0, -ratio))))


def rejected(p_values: list[float], lengths: list[int], level: float = LEVEL) -> list[bool]:
    """Weighted Benjamini-Hochberg; weights of mean one, in proportion to length."""
    if not p_values:
        return []
    scale = len(lengths) / sum(lengths)
    weighted = [p / (n * scale) for p, n in zip(p_values, lengths, strict=True)]
    cut, m = -1.0, len(weighted)
    for k, q in enumerate(sorted(weighted), 1):
        if q <= level * k / m:
            cut = q
    return [q <= cut for q in weighted]


def _base(text: str, longest: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known formats."""
    spans = []
    folded = text.lower() if longest >= 6 else ""
    if any(w in folded for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if longest >= 20 and "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if longest >= 24:
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return spans


def parts(run: str) -> list[tuple[int, str]]:
    """(offset, part) of a run: itself, or where no alphabet holds it what ``-_`` or what ``+/`` separate.

    The separators are those that leave the longer part, ``-_`` where both do.
    """
    if encoding_of(run):
        return [(0, run)]
    cuts = [[(m.start(), m[0]) for m in re.finditer(p, run)] for p in (r"[^-_]+", r"[^+/]+")]
    return max(cuts, key=lambda found: max((len(x) for _, x in found), default=0))


def _random(text: str) -> list[tuple[int, int, int]]:
    runs = []
    for start, run in ((m.start() + k, part) for m in _RUN.finditer(text) for k, part in parts(m[0]) if len(part) >= SHORTEST):
        if not _DIGIT.search(run) and not (_LOWER.search(run) and _UPPER.search(run)):
            continue
        encoding = encoding_of(run)
        if encoding and len(run) * math.log2(len(ALPHABETS[encoding])) >= LEAST_BITS and randomness(run, encoding) >= ORDERLY:
            runs.append((start, start + len(run), text_likeness(run, encoding)))
    found = rejected([r[2] for r in runs], [r[1] - r[0] for r in runs])
    return [(start, 3, end) for (start, end, _), yes in zip(runs, found, strict=True) if yes]


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans of a whole text, each (start, kind's place, end), in order."""
    text = text or ""
    longest = max(map(len, text.split()), default=0)
    base = sorted(_base(text, longest))
    return base, sorted(base + _random(text)) if longest >= SHORTEST else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str | None) -> str | None:
    """The text with every span replaced; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in scan(text)[1]:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, counts by known format, digest of the base spans, all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x) for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found])
            spans = pa.array([written(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], [batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    wide = docs.select(id_col, text_or_empty(text_col).alias("_scanned_text"))
    long = F.lit(0).cast("long")
    schema = wide.select(id_col, long.alias("n_assign"), long.alias("n_access"), long.alias("n_hex"), F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema
    return in_small_batches(wide).mapInArrow(frugal(run), schema)


def redact_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text_col`` replaced; nulls stay null, all columns and rows stay."""

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array(map(redact, batch.column(place).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], clean, *batch.columns[place + 1 :]], batch.schema.names)

    texts = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return in_small_batches(texts).mapInArrow(frugal(run), texts.schema)


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs.select("doc_id", "text"))
