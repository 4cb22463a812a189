"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 6).

``P(grade <= j) = sigmoid(threshold_j - w . x)`` with one weight vector shared by all grades
and ordered thresholds.  ``x`` holds a text's features, hashed into ``BUCKETS`` and divided
by their number: each word, its beginning and end, and its shape (letters, capitals, digits,
runs shortened, other characters as they are), shapes also by pairs of neighbours, and
how many words back it stood before, if at most ``LAGS``.  The
expected grade and the tail probability of a grade select documents.

The model is fitted on a bounded sample of the rated rows (``SAMPLE``, by hash of the id);
every text is scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kerbflow.llm import _text
from kerbflow.llm._cluster import bounded_batches, give_back

BUCKETS = 1 << 15
#: Features of a word, and the words back in which it is looked for.
FEATURES, LAGS = 6, 8
#: Rated rows that the fit takes at most.
SAMPLE = 4000
STEPS = 300
PENALTY = 2e-5
#: Least tail probability of a document that is kept.  Grades weigh alike in the fit, so 0.5 is the even
#: odds of a rare grade; below that, doubtful documents stay.
KEEP = 0.25
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")


def _shape(word: str) -> str:
    return _DIGIT.sub("9", _UPPER.sub("A", _LOWER.sub("a", word)))


def _bucket(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\x00{value}") % BUCKETS


@dataclass
class Features:
    """The buckets of all words of some texts: by distinct word, and by place."""

    codes: np.ndarray
    off: np.ndarray
    own: np.ndarray  # four buckets a distinct word
    pair: np.ndarray  # one bucket a place: the shapes of the word and the next
    again: np.ndarray  # one bucket a place: how many words back the word stood before

    def of(self, text: int) -> np.ndarray:
        """All buckets of a text."""
        z = slice(self.off[text], self.off[text + 1])
        return np.concatenate([self.own[self.codes[z]].ravel(), self.pair[z], self.again[z]])


def text_features(texts: pa.Array) -> Features:
    codes, off, vocabulary = _text.words(texts, lower=False)
    names = vocabulary.to_pylist()
    shapes = [_shape(w) for w in names]
    kinds = {s: k for k, s in enumerate(dict.fromkeys(shapes))}
    listed = list(kinds)
    shape_bucket = [_bucket("s", s) for s in listed]
    shape_of = np.array([kinds[s] for s in shapes], np.int64)
    lows = [w.lower() for w in names]
    own = np.array([(_bucket("w", w), _bucket("b", w[:3]), _bucket("e", w[-3:]), shape_bucket[k]) for w, k in zip(lows, shape_of)], np.int32).reshape(-1, 4)
    n = len(codes)
    if not n:
        return Features(codes, off, own, np.zeros(0, np.int32), np.zeros(0, np.int32))
    s = shape_of[codes]
    pair = s * len(listed) + np.append(s[1:], 0)
    pair[off[1:][np.diff(off) > 0] - 1] = -1  # the last word has no next one
    distinct, back = np.unique(pair, return_inverse=True)
    made = [_bucket("p", "" if p < 0 else f"{listed[p // len(listed)]} {listed[p % len(listed)]}") for p in distinct]
    again = np.zeros(n, np.int8)
    inside = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    for lag in range(LAGS, 0, -1):
        again[lag:][(codes[lag:] == codes[:-lag]) & (inside[lag:] >= lag)] = lag
    lags = np.array([_bucket("r", str(k)) for k in range(LAGS + 1)], np.int32)
    return Features(codes, off, own, np.array(made, np.int32)[back], lags[again])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= j) for each j below the highest grade, one row a text."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds, -500, 500)))

    def tail(self, score: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= ``grade``)."""
        return np.ones(len(score)) if grade <= 0 else 1 - self.at_most(score)[:, grade - 1]

    def expected(self, score: np.ndarray) -> np.ndarray:
        return (1 - self.at_most(score)).sum(axis=1)

    def scores(self, f: Features) -> np.ndarray:
        """The mean weight of each text's features."""
        each = self.weights[f.own].sum(axis=1)[f.codes] + self.weights[f.pair] + self.weights[f.again]
        total = np.concatenate([[0.0], np.cumsum(each)])[f.off]
        return np.diff(total) / np.maximum(FEATURES * np.diff(f.off), 1)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam on all rows.

    ``rows`` holds (buckets, shares) of each text.  Thresholds are kept in order by fitting
    the first and the logarithms of the gaps.  Grades are 0..K; with one grade only, every
    text is expected to have it.
    """
    top = int(grades.max(initial=0))
    if not len(rows) or top == 0:
        return OrdinalModel(np.zeros(BUCKETS), np.full(top, -50.0))
    col, val = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    weight = 1 / np.bincount(grades, minlength=top + 1).clip(1)[grades]  # grades weigh alike
    weight /= weight.sum()
    share = np.cumsum(np.bincount(grades, weights=weight, minlength=top + 1))[:-1].clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(BUCKETS), start[:1], np.log(np.diff(start).clip(1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    at = np.arange(len(grades))
    for step in range(1, steps + 1):
        w, gaps = theta[:BUCKETS], np.exp(theta[BUCKETS + 1 :])
        cuts = np.concatenate([[-np.inf], theta[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(row, weights=w[col] * val, minlength=len(rows))
        hi, lo = sig(cuts[grades + 1] - s), sig(cuts[grades] - s)
        p = (hi - lo).clip(1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_s = weight * (dhi - dlo)
        g_cut = np.zeros((len(rows), top + 2))
        g_cut[at, grades + 1] -= weight * dhi
        g_cut[at, grades] += weight * dlo
        g_cut = g_cut.sum(axis=0)[1:-1]
        g_gap = np.cumsum(g_cut[::-1])[::-1][1:] * gaps
        grad = np.concatenate([np.bincount(col, weights=g_s[row] * val, minlength=BUCKETS) + penalty * w, [g_cut.sum()], g_gap])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(theta[BUCKETS + 1 :])
    return OrdinalModel(theta[:BUCKETS], theta[BUCKETS] + np.concatenate([[0], np.cumsum(gaps)]))


def _sampled_features(batches):
    for batch in batches:
        for part in _text.slices(batch):
            features = text_features(part.column("text"))
            cols, vals = [], []
            for k in range(part.num_rows):
                found, count = np.unique(features.of(k), return_counts=True)
                cols.append(found.astype("<i4").tobytes())
                vals.append((count / max(count.sum(), 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("grade").cast(pa.int64()), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], ["grade", "cols", "vals"])


def fit_quality(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most about ``sample`` rows of ``docs`` with a rating (doc_id, grade >= 0).

    The sample is chosen by hash of doc_id among all rated ids.  Null ids and grades take no
    part; of several ratings of an id the lowest counts, of several rows the text with the least hash.
    """
    bounded_batches(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("long").alias("grade"))
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded sample, small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))  # one row an id, whatever repeats
    rows = rows.select("grade", "text").mapInArrow(_sampled_features, "grade long, cols binary, vals binary").collect()
    rows.sort(key=lambda r: (r.grade, r.cols, r.vals))  # the fit does not depend on the order of arrival
    parts = [(np.frombuffer(r.cols, "<i4"), np.frombuffer(r.vals, "<f4")) for r in rows]
    model = fit_ordinal(parts, np.array([r.grade for r in rows], np.int64))
    del rows, parts
    give_back()  # the driver, too, keeps no more than the model
    return model


def score_quality(docs: DataFrame, model: OrdinalModel, grade: int = 1) -> DataFrame:
    """The rows of ``docs`` with ``expected_grade`` and ``tail`` = P(grade >= ``grade``).

    Columns of these names are replaced.  Null and empty texts hold no features; they are
    scored by the thresholds alone.  All columns and rows stay.
    """
    docs = docs.drop("expected_grade", "tail")
    model = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail", DoubleType())])
    bounded_batches(docs.sparkSession)
    named = "text" if dict(docs.dtypes)["text"] == "string" else "__text"
    whole = docs if named == "text" else docs.withColumn(named, F.col("text").cast("string"))

    def run(batches):
        m = model.value
        for batch in batches:
            for part in _text.slices(batch, named):
                score = m.scores(text_features(part.column(named)))
                columns = [c for k, c in enumerate(part.columns) if part.schema.names[k] != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(m.expected(score)), pa.array(m.tail(score, grade))], [*[n for n in part.schema.names if n != "__text"], "expected_grade", "tail"])

    return whole.mapInArrow(run, kind)
