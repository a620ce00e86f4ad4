"""Quality classifier by ordinal cumulative-link regression.

Ratings are graded 0 to K-1.  One weight vector over hashed text features is
shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - w.x).  The expected grade and the tail
probability P(grade >= ``tail``) select documents.

Features: the distinct letter runs and symbol runs of the lower-cased text and
the beginnings of longer runs (inflected forms share them), hashed, plus a few
marks of form (repetition, capitals, length), each with value 1.  No feature looks at the id or the source.

Weights go only to slots whose presence in the rated sample departs from
chance (``Fit.least_z`` standard deviations at some cut of the grades, seen
``Fit.least_seen`` times), so the many rare words add no noise.

The fit takes at most ``Fit.rows`` rated documents (by hash of the id, the
same in every run) and is full-batch gradient descent in one task.  Every
document is scored; the weights have the fixed size of the hash space.

Defined results: null and empty texts have only marks of form and still get a
score; ratings of a document given more than once are averaged and rounded;
ratings without a document and nulls are left out; without any rating every
grade is equally likely; rows are scored one by one, repeated rows alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import bounded_sample, id_text, map_batches

BITS = 18
STEM = 4
LEAST_TAIL = 0.6
GRADES = 3
_RUNS = re.compile(r"[^\W_]+|[^\w\s]+").findall
_MEMO_ROWS = 400_000


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit."""

    rows: int = 20_000
    steps: int = 400
    rate: float = 0.05
    decay: float = 3e-5
    least_seen: int = 5
    least_z: float = 4.5


def tokens(text: str | None) -> set[str]:
    text = text or ""
    runs = _RUNS(text.lower())
    kinds = set(runs)
    n = len(runs)
    words = text.split()
    capitals = 8 * sum(map(str.isupper, words)) // len(words) if words else 0
    marks = {f"\0new{10 * len(kinds) // n if n else -1}" if n < 200 else f"\0New{20 * len(kinds) // n}",
             f"\0size{n.bit_length()}", f"\0caps{capitals}"}
    return kinds | {f"\1{w[:STEM]}" for w in kinds if len(w) > STEM} | marks


def _slot(token: str) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray      # of every slot
    thresholds: np.ndarray   # ascending, grades - 1 of them

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= K-1)."""
        return _sigmoid(score - self.thresholds)


def telling(flat: np.ndarray, counts: np.ndarray, grades: np.ndarray, settings: Fit, n_grades: int) -> np.ndarray:
    """Slots whose presence departs from chance at some cut of the grades."""
    n, size = len(grades), 1 << BITS
    seen = np.bincount(flat, minlength=size)
    z = np.zeros(size)
    for cut in range(1, n_grades):
        low = (grades < cut).astype(float)
        share = min(max(low.mean(), 0.5 / n), 1 - 0.5 / n)
        hits = np.bincount(flat, weights=np.repeat(low, counts), minlength=size)
        z = np.maximum(z, np.abs(hits - share * seen) / np.sqrt(np.maximum(seen, 1) * share * (1 - share)))
    return (seen >= settings.least_seen) & (z >= settings.least_z)


def train(slots: list[np.ndarray], grades: np.ndarray, fit: Fit = Fit(), n_grades: int = GRADES) -> Ordinal:
    """Maximises the penalised likelihood with Adam; thresholds stay ordered
    as a first one plus positive steps."""
    size = 1 << BITS
    w, cut = np.zeros(size), np.concatenate([[-0.5], np.zeros(n_grades - 2)])
    if not len(grades):
        even = np.arange(1, n_grades) / n_grades
        return Ordinal(w.astype(np.float32), np.log(even / (1 - even)))
    flat, counts = np.concatenate(slots), np.array([len(s) for s in slots])
    keep = telling(flat, counts, grades, fit, n_grades)
    slots = [np.append(s[keep[s]], size) for s in slots]  # one slot past the end: no text is left without any
    flat, counts = np.concatenate(slots), np.array([len(s) for s in slots])
    used, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    v, n = np.zeros(len(used)), len(grades)
    moments = [(np.zeros(len(used)), np.zeros(len(used))), (np.zeros(n_grades - 1), np.zeros(n_grades - 1))]
    for step in range(1, fit.steps + 1):
        gaps = np.exp(cut[1:])
        t = np.concatenate([cut[:1], cut[0] + np.cumsum(gaps)])
        score = np.add.reduceat(v[flat], starts)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(t[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        hi, lo = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = -(d_hi - d_lo) / n
        g_v = np.bincount(flat, weights=np.repeat(g_score, counts), minlength=len(used)) - fit.decay * v
        g_t = np.array([(d_hi[grades == k].sum() - d_lo[grades == k + 1].sum()) / n for k in range(n_grades - 1)])
        g_cut = np.concatenate([[g_t.sum()], g_t[::-1].cumsum()[::-1][1:] * gaps])
        for x, g, (m1, m2) in ((v, g_v, moments[0]), (cut, g_cut, moments[1])):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            x += fit.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    w[used[:-1]] = v[:-1]
    cut[0] -= v[-1]  # the slot that all share is a shift of the thresholds
    return Ordinal(w.astype(np.float32), np.concatenate([cut[:1], cut[0] + np.cumsum(np.exp(cut[1:]))]))


def graded(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> Column:
    """Grade of a rating row: 0 poor, 1 well formed but toxic, 2 good."""
    quality, toxic = F.col(quality_col).cast("double"), F.coalesce(F.col(toxic_col).cast("double"), F.lit(0.0))
    return F.when(quality.isNull(), None).when(quality < 0.5, 0.0).when(toxic >= 0.5, 1.0).otherwise(2.0)


def fit(docs: DataFrame, ratings: DataFrame, settings: Fit = Fit(), n_grades: int = GRADES) -> Ordinal:
    """Fits on documents (doc_id, text) and ratings (doc_id, grade)."""
    schema = pa.schema([("slot", pa.int64()), ("weight", pa.float64())])
    chosen = bounded_sample(ratings.groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade")), settings.rows, "doc_id")
    rated = docs.join(F.broadcast(chosen), "doc_id").select("grade", "text")  # at most settings.rows rows

    def features(batch):
        return {"grade": batch.column(0), "slots": [np.unique([_slot(t) for t in tokens(x)]) for x in batch.column(1).to_pylist()]}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades, slots = [], []
        for b in batches:
            grades += b.column(0).to_pylist()
            slots += [s.values.to_numpy() for s in b.column(1)]
        order = sorted(range(len(grades)), key=lambda i: (len(slots[i]), grades[i], slots[i].tobytes()))[:settings.rows]
        m = train([slots[i] for i in order], np.array([grades[i] for i in order], dtype=np.int64), settings, n_grades)
        some = np.flatnonzero(m.weights)
        yield pa.RecordBatch.from_pydict({"slot": np.concatenate([some, -1 - np.arange(n_grades - 1)]),
                                          "weight": np.concatenate([m.weights[some].astype(float), m.thresholds])}, schema=schema)

    rows = map_batches(rated, features, "grade int,slots array<bigint>")
    got = rows.repartition(1).mapInArrow(learn, "slot bigint,weight double").toArrow()
    slot, weight = got["slot"].to_numpy(), got["weight"].to_numpy()
    w = np.zeros(1 << BITS, dtype=np.float32)
    w[slot[slot >= 0]] = weight[slot >= 0]
    cut = slot < 0
    if not cut.any():
        return train([], np.zeros(0, dtype=np.int64), settings, n_grades)
    return Ordinal(w, weight[cut][np.argsort(-slot[cut])])


class Scorer:
    """Scores texts; weights of words seen before are remembered."""

    def __init__(self, model: Ordinal):
        self.model, self.memo = model, {}

    def __call__(self, text: str | None) -> np.ndarray:
        total, memo = 0.0, self.memo
        for t in tokens(text):
            x = memo.get(t)
            if x is None:
                if len(memo) >= _MEMO_ROWS:
                    memo.clear()
                x = memo[t] = float(self.model.weights[_slot(t)])
            total += x
        return self.model.tails(total)


def classify(docs: DataFrame, model: Ordinal, tail: int = GRADES - 1, least: float = LEAST_TAIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    def judge(batch):
        if not scorers:
            scorers.append(Scorer(shared.value))
        tails = [scorers[0](t) for t in batch.column(1).to_pylist()]
        p = [float(t[tail - 1]) for t in tails]
        return {"doc_id": batch.column(0), "expected_grade": [float(t.sum()) for t in tails], "tail_probability": p, "kept": [x >= least for x in p]}

    return map_batches(id_text(docs, id_col, text_col), judge, "doc_id bigint,expected_grade double,tail_probability double,kept boolean")


def rate_documents(docs: DataFrame, labels: DataFrame, settings: Fit = Fit(), tail: int = GRADES - 1, least: float = LEAST_TAIL) -> DataFrame:
    """Fits on the labels and scores every document."""
    ratings = labels.select(F.col("doc_id").cast("long").alias("doc_id"), graded(labels).alias("grade")).filter("doc_id is not null and grade is not null")
    return classify(docs, fit(id_text(docs), ratings, settings), tail, least)
