"""Text quality by a regularised quadratic discriminant.

Every document is described by transformed statistics of its whole text. Each class gets a mean
and a covariance, shrunk towards the covariance of both classes and towards its diagonal. A score is the
difference of the classes' log densities, from Mahalanobis distances by Cholesky factors that
are computed once, through a logistic function. Labels enter the fit alone; language, source and
id are no statistics. Fitting adds up moments of all training rows in one aggregation of
two result rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import fresh, map_arrow, utf8

#: Weights of the pooled covariance and of the diagonal, and the least variance of a standardised statistic.
POOLED, DIAGONAL, RIDGE = 0.15, 0.1, 1e-3
#: Log densities are divided by this before the logistic function.
TEMPERATURE = 8.0
CUT = 0.3
#: Labelled rows that ``labelled`` chooses at most, about.
FIT_ROWS = 100_000
FOLDS, HELD_OUT = 5, 0

_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:?'\"()-"
_ENDS = (".", ",", ";", ":", "?")
NAMES = ("words", "word_length", "word_spread", "distinct", "letters", "upper", "digits", "symbols",
         "ends", "top_word", "pairs", "neighbours", "lines", "line_length", "long_words", "top_length")


#: Words, and characters, of usual text that every document is taken to have besides its own, so that
#: shares of very short texts stay near usual ones.
PRIOR_WORDS, PRIOR_CHARS = 12, 72


def _logit(count: float, of: float, usual: float, prior: float = PRIOR_WORDS) -> float:
    x = (count + usual * prior) / (of + prior)
    return math.log((x + 0.002) / (1.002 - x))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of ``NAMES``; all defined for an empty one."""
    whole = text.decode("utf-8", "replace")
    words = whole.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(words)
    lengths = Counter(map(len, words))
    mean = sum(k * c for k, c in lengths.items()) / n
    spread = math.sqrt(sum(c * (k - mean) ** 2 for k, c in lengths.items()) / n)
    letters = size - len(text.translate(None, _LETTERS))
    upper = size - len(text.translate(None, _UPPER))
    digits = size - len(text.translate(None, _DIGITS))
    symbols = len(text.translate(None, _LETTERS + _DIGITS + _SPACE + _STOPS))
    ends = sum(c for w, c in counts.items() if w.endswith(_ENDS))
    pairs = Counter(pairwise(words))
    same = sum(c for (a, b), c in pairs.items() if a == b)
    lines = [x for x in whole.splitlines() if x.strip()]
    prior = PRIOR_WORDS / (n + PRIOR_WORDS)
    smooth = lambda value, usual: value * (1 - prior) + usual * prior
    return [
        math.log1p(n), math.log(smooth(mean, 5.5)), math.log1p(smooth(spread, 3.0)),
        smooth(math.log(len(counts)) / math.log(n + 1), 0.95),
        _logit(letters, size, 0.82, PRIOR_CHARS), _logit(min(upper, letters), letters, 0.03, PRIOR_CHARS),
        _logit(digits, size, 0.0, PRIOR_CHARS), _logit(symbols, size, 0.0, PRIOR_CHARS), _logit(ends, n, 0.12),
        _logit(max(counts.values()), n, 0.05), _logit(n - 1 - len(pairs) if n > 1 else 0, n, 0.02), _logit(same, n, 0.0),
        _logit(len(lines) - len(set(lines)), len(lines), 0.0), math.log1p(n / max(1, len(lines))),
        _logit(sum(c for k, c in lengths.items() if k > 20), n, 0.0), _logit(max(lengths.values()), n, 0.1)]


def described(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, x) with the statistics of each whole text; null texts are empty."""
    def work(batches):
        out = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], schema=out)

    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), utf8(text_column).alias("t")),
                     work, "doc_id long, x array<double>")


def fold(id_column: str = "doc_id", folds: int = FOLDS):
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, and mean, inverse Cholesky factor and half log determinant of each class."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    whiten: tuple[np.ndarray, ...]
    half_log_det: tuple[float, ...]
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of label 1 from 0 to 1, for rows of statistics."""
        if not self.means:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ w.T) ** 2).sum(1) - h for m, w, h in zip(self.means, self.whiten, self.half_log_det)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -500, 500)))


def fit(statistics_table: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on labelled rows outside the held-out fold. Null labels and ids are left out; an id that is
    labelled twice counts twice. If a class has no rows, every score is the share of label 1
    (one half without any)."""
    given = (labels.where(F.col("quality").isin(0, 1) & (fold() != HELD_OUT))
             .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")))
    d = len(NAMES)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    rows = statistics_table.join(given, "doc_id").groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in upper]).alias("p")).collect()
    by = {r.label: r for r in rows}
    if set(by) != {0, 1}:
        total = sum(r.n for r in rows)
        return Discriminant(np.zeros(d), np.ones(d), (), (), (), by[1].n / total if 1 in by else (0.0 if total else 0.5))
    count, means, covariances = [], [], []
    for label in (0, 1):
        r = by[label]
        mean, second = np.array(r.s) / r.n, np.zeros((d, d))
        for (i, j), v in zip(upper, r.p):
            second[i, j] = second[j, i] = v / r.n
        count.append(r.n), means.append(mean), covariances.append(second - np.outer(mean, mean))
    pooled = sum(n * c for n, c in zip(count, covariances)) / sum(count)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    centre = means[1]
    pooled = pooled / np.outer(scale, scale)
    whiten, half = [], []
    for c in covariances:
        c = c / np.outer(scale, scale)
        shrunk = (1 - POOLED - DIAGONAL) * c + POOLED * pooled + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor)), half.append(float(np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, tuple((m - centre) / scale for m in means), tuple(whiten), tuple(half), 0.5)


def labelled(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """The documents of at most about ``most`` labelled ids outside the held-out fold, chosen by the hash of the id: all, if
    they are no more. ``fit`` needs no others."""
    given = labels.where(F.col("quality").isin(0, 1) & (fold() != HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    share = most / max(1, given.count())
    if share < 1:
        given = given.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The chosen ids are few by their bound; one long each.
    own = fresh("labelled id", docs)
    return docs.join(F.broadcast(given.withColumnRenamed("doc_id", own)), F.col("doc_id").cast("long") == F.col(own), "left_semi")


def scored(statistics_table: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, held_out, score, predicted). A null id is in no fold."""
    def work(batches):
        out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x))], schema=out)

    return map_arrow(statistics_table.select("doc_id", "x"), work, "doc_id long, score double").select(
        "doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Discriminant, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model accepts."""
    names, kinds = docs.columns, docs.schema
    text = utf8(text_column)

    def work(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1, len(NAMES))
            keep = pa.array(model.scores(x) >= CUT)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(len(names))], names=names)

    mark = fresh("statistics of", docs)
    return map_arrow(docs.withColumn(mark, text), work, kinds)
