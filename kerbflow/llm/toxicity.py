"""Toxic passages by maximum-scoring segments (operator 5).

*Token scores.*  Tokens are words and, for words with other endings, their beginnings of
``STEMS`` characters.  A token's score is the difference of its log-odds in toxic and in
clean training texts under a Dirichlet prior in proportion to its count in both, of either
sign, if it is ``Z`` standard deviations from 0, and for toxicity at least ``LEAST``; else 0.
Every token that is not positive costs ``DRIFT`` besides, so that chance hits do not grow into
passages.

*Passages.*  A linear scan finds the maximal scoring segments of a text, each disjoint from
the others and not extendable.

*Calibration.*  The best segment of a clean text grows with the logarithm of its length; its
excess follows an extreme-value law, whose location and scale come from the clean training
texts by moments.  Segments with a small tail probability are the significant passages.  A
text's evidence is the sum of the surprises of its significant passages, over the best
one's; a logistic curve fitted on the training texts turns it into the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbflow.llm import _text
from kerbflow.llm._cluster import bounded_batches, written

STEMS = (4, 5, 6)
#: Standard deviations from 0 of a score that counts, and the least one that speaks for toxicity; chosen by four folds of training rows.
Z, LEAST = 3.5, 2.5
PRIOR = 2000.0
#: Uses in toxic or in clean texts under which a token is too rare to be scored.
RARE = 5
#: Tokens that a model holds at most, those furthest from 0 by their deviations; it goes to all tasks.
TOKENS = 500_000
#: What a token that does not point to toxicity costs.
DRIFT = -0.25
#: Training texts of each label that the calibration takes at most, by hash of the id.
SAMPLE = 4000
TAIL = 0.01


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    codes, off, vocabulary = _text.words(texts)
    return codes, off, [w.strip(".,;:!?\"'()[]*#$%&|") for w in vocabulary.to_pylist()]


def _variants(word: str) -> list[str]:
    """A word's tokens: itself, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)] if word else []


def _count(batches):
    """Partial counts (token, label, uses) of a task, handed on whenever they grow large."""
    have: dict[tuple[str, int], int] = {}

    def out():
        keys = list(have)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(have.values()), pa.int64())], ["token", "label", "uses"])

    for batch in batches:
        for part in _text.slices(batch):
            codes, off, names = _tokens(part.column("text"))
            label = np.repeat(part.column("toxic").to_numpy(), np.diff(off))
            for value in np.unique(label):
                found, count = np.unique(codes[label == value], return_counts=True)
                for c, n in zip(found, count):
                    for token in _variants(names[c]):
                        key = (token, int(value))
                        have[key] = have.get(key, 0) + int(n)
            if len(have) > 500_000:
                yield out()
                have.clear()
    yield out()


def token_scores(training: DataFrame, z: float = Z, least: float = LEAST, prior: float = PRIOR) -> dict[str, float]:
    """Scores of the tokens that tell toxic from clean ``training`` texts (text, toxic).

    Counts and the prior cover all training rows.  Tokens with fewer than ``RARE`` uses on both
    sides have no score.  Only tokens with a score reach the driver, at most ``TOKENS``.
    """
    counts = training.mapInArrow(_count, "token string, label int, uses long").groupBy("token").agg(
        F.sum(F.when(F.col("label") == 1, F.col("uses")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("uses")).otherwise(0)).alias("good")
    )
    counts = written(counts.where((F.col("bad") >= RARE) | (F.col("good") >= RARE)), "counts")
    size = counts.where("not endswith(token, '*')").agg(F.sum("bad"), F.sum("good")).first()
    n_bad, n_good = (float(x or 0) for x in size)
    if not n_bad or not n_good:
        return {}
    # the prior: the token's share of all words that are counted
    share = (F.col("bad") + F.col("good") + 1) / F.lit(n_bad + n_good)
    a = F.lit(prior) * share
    odds = lambda y, n: F.log((y + a) / F.greatest(F.lit(n + prior) - y - a, F.lit(1e-9)))
    delta = odds(F.col("bad"), n_bad) - odds(F.col("good"), n_good)
    spread = F.sqrt(1 / (F.col("bad") + a) + 1 / (F.col("good") + a))
    far = F.col("delta") / spread
    kept = counts.withColumn("delta", delta).where(((far >= z) & (F.col("delta") >= least)) | (far <= -z))
    kept = kept.orderBy(F.desc(F.abs(far)), "token").limit(TOKENS)
    return {r.token: float(r.delta) for r in kept.select("token", "delta").collect()}


def segments(scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Scores that are not positive cost ``drift`` besides.  Only positive ones can begin or end a
    segment, so the scan steps from one to the next.  Each open segment knows the last one
    before it that begins lower, so that those between are passed over at once; a segment that
    begins lower than all closes them.
    """
    upto = np.concatenate([[0.0], np.cumsum(np.where(scores > 0, scores, scores + drift))])
    closed: list[tuple] = []
    opened: list[tuple] = []  # start, end, sum before, sum after, place of the last one that begins lower
    for p in np.flatnonzero(scores > 0).tolist():
        start, before, after = p, float(upto[p]), float(upto[p + 1])
        while True:
            j = len(opened) - 1
            while j >= 0 and opened[j][2] >= before:
                j = opened[j][4]
            if j < 0:
                closed += opened
                opened = [(start, p + 1, before, after, -1)]
                break
            if opened[j][3] >= after:
                opened.append((start, p + 1, before, after, j))
                break
            start, before = opened[j][0], opened[j][2]
            del opened[j:]
    return [(a, b, after - before) for a, b, before, after, _ in [*closed, *opened]]


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    location: float = 0.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = -4.0

    def word_score(self, word: str) -> float:
        """The score furthest from 0 among a word's tokens; 0 if none is known."""
        return max((self.scores[t] for t in _variants(word) if t in self.scores), key=abs, default=0.0)

    def surprise(self, score: float, words: int) -> float:
        """-log of the chance that a clean text of that length holds such a segment."""
        x = (score - self.location - self.scale * np.log(max(words, 1))) / self.scale
        return float(-np.log(-np.expm1(-np.exp(-x)) + 1e-300)) if x > -30 else 0.0

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(start, end, score, surprise) of the significant passages."""
        found = [(a, b, s, self.surprise(s, len(scores))) for a, b, s in segments(scores)]
        return [f for f in found if f[3] >= -np.log(TAIL)]

    def evidence(self, scores: np.ndarray) -> float:
        every = [self.surprise(s, len(scores)) for _, _, s in segments(scores)]
        if not every:
            return 0.0
        return float(np.log1p(max(max(every), sum(e for e in every if e >= -np.log(TAIL)))))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + self.slope * evidence)))

    def text_scores(self, texts: pa.Array) -> list[np.ndarray]:
        codes, off, names = _tokens(texts)
        own = np.array([self.word_score(w) for w in names] or [0.0])
        flat = own[codes] if len(codes) else np.zeros(0)
        return [flat[a:b] for a, b in zip(off[:-1], off[1:])]


def _mapped(model, kind: str):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in _text.slices(batch):
                scored = m.text_scores(part.column("text"))
                if kind == "best":
                    best = [max((s for _, _, s in segments(x)), default=0.0) for x in scored]
                    yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(best), pa.array([len(x) for x in scored], pa.int64())], ["toxic", "best", "words"])
                elif kind == "evidence":
                    yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array([m.evidence(x) for x in scored])], ["toxic", "evidence"])
                elif kind == "passages":
                    found = [[{"start": a, "end": b, "score": s, "surprise": u} for a, b, s, u in m.passages(x)] for x in scored]
                    p = m.probability(np.array([m.evidence(x) for x in scored]))
                    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("surprise", pa.float64())]))
                    yield pa.RecordBatch.from_arrays([_text.long_column(part, "doc_id"), pa.array(p), pa.array(found, shape)], ["doc_id", "score", "passages"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a weak prior."""
    t = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ t, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * t
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def fit_toxicity(training: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fits on ``training`` (doc_id, text, toxic 0/1): token counts on all rows, the two
    calibration curves on at most ``sample`` ids of each label, by hash of doc_id.

    Rows without an id or a label take no part.  Of rows that share an id the one with the least hash calibrates.
    """
    bounded_batches(training.sparkSession)
    training = training.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    model = ToxicityModel(token_scores(training.select("text", "toxic")))
    if not model.scores:
        return model
    spark = training.sparkSession
    picked = [training.where(F.col("toxic") == k).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    # a bounded sample, small enough to broadcast
    rows = training.join(F.broadcast(picked[0].union(picked[1]).distinct()), "doc_id", "left_semi").select("doc_id", "text", "toxic")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text", "toxic")).alias("r")).select("r.text", "r.toxic")
    best = rows.mapInArrow(_mapped(spark.sparkContext.broadcast(model), "best"), "toxic int, best double, words long").toPandas()
    clean = best[best.toxic == 0]
    excess = clean.best.to_numpy()
    model.scale = max(float(excess.std()) * np.sqrt(6) / np.pi, 0.5)
    model.location = float((excess - model.scale * np.log(clean.words.clip(lower=1))).mean()) - np.euler_gamma * model.scale
    seen = rows.mapInArrow(_mapped(spark.sparkContext.broadcast(model), "evidence"), "toxic int, evidence double").toPandas()
    model.slope, model.offset = _logistic(seen.evidence.to_numpy(), seen.toxic.to_numpy(float))
    return model


def toxic_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, passages) for each row of ``docs`` (doc_id, text).

    ``passages`` are word ranges with their scores.  Null and empty texts have none and the
    score of a text without evidence.  Repeated rows are scored alike; further columns are
    ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, score double, passages array<struct<start:long,end:long,score:double,surprise:double>>"
    return rows.mapInArrow(_mapped(docs.sparkSession.sparkContext.broadcast(model), "passages"), kind)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id's digits is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
