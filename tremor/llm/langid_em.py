"""Language identification by multilingual mixture inference.

Training counts hashed letter trigrams (word edges count as blanks) per
language over all training texts: each task sums its own table, Spark adds
them up.  The model is languages x ``BUCKETS`` log-probabilities, a fixed size
per language, shared with the executors as a broadcast variable.

A text is a bag of words; each word has a likelihood under each language.
Expectation-maximisation estimates the languages' shares, and the set of
languages grows while the log-likelihood gains more than ``PENALTY`` half
logarithms of the number of words (a BIC).  The prediction is the language
with the largest share in the chosen set, the score is that share.

Defined results: null texts and texts without a letter are ``und`` with score
0; equal shares go to the smaller language name; rows are judged one by one,
repeated rows alike; without any training row every text is ``und``; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import id_text, map_batches

BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 30
UNKNOWN = "und"
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Lower-case letter of every code point, 0 where it is no letter."""
    if not _FOLD:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around every letter, first letter of each word)."""
    letters = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    a = np.zeros(len(letters) + 2, dtype=np.uint32)
    a[1:-1] = letters
    at = np.flatnonzero(a)
    h = a[at - 1] * np.uint32(0x9E3779B1) ^ a[at] * np.uint32(0x85EBCA6B) ^ a[at + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)).astype(np.int64), np.flatnonzero(a[at - 1] == 0)


def held_out(doc_id) -> F.Column:
    """Every fifth document by checksum of its id is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = tables.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            np.add.at(own, trigrams(text)[0], 1)
    for lang, own in tables.items():
        b = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(b), "bucket": b, "n": own[b]}, schema=schema)


class Model:
    """Languages in order of name and their trigram log-probabilities."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logs = np.ascontiguousarray(np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        buckets, words = trigrams(text)
        if not len(buckets):
            return UNKNOWN, 0.0
        shares = mixture(np.add.reduceat(self.logs[buckets], words, axis=0).astype(np.float64))
        best = int(np.argmax(shares))  # the first of equal ones
        return self.langs[best], float(min(1.0, shares[best]))


def _shares(like: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over the columns of ``like``: (shares, log-likelihood)."""
    pi = np.full(like.shape[1], 1.0 / like.shape[1])
    for _ in range(ROUNDS):
        mix = like @ pi
        new = pi * ((1.0 / mix) @ like) / len(like)
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, float(np.log(like @ pi).sum() + shift.sum())


def mixture(logs: np.ndarray) -> np.ndarray:
    """Shares of all languages, 0 outside the chosen set.  ``logs``: words x languages."""
    words, langs = logs.shape
    shift = logs.max(axis=1)
    like = np.exp(np.maximum(logs - shift[:, None], -60.0))
    cost = PENALTY * 0.5 * np.log(words + 1)
    single = logs.sum(axis=0)
    chosen = [int(np.argmax(single))]
    score, pi = float(single[chosen[0]]), np.ones(1)
    # no set can gain more than every word taking its best language
    while len(chosen) < langs and float(shift.sum()) - score > cost:
        tried = []
        for k in range(langs):
            if k not in chosen:
                p, s = _shares(like[:, [*chosen, k]], shift)
                tried.append((s, -k, p))
        s, k, p = max(tried, key=lambda x: x[:2])
        if s - score <= cost:
            break
        chosen, score, pi = [*chosen, -k], s, p
    out = np.zeros(langs)
    out[chosen] = pi
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and language of the documents not held out."""
    rows = (docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    table = rows.mapInArrow(_count, "lang string,bucket bigint,n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS), dtype=np.int64)
    counts[[place[x] for x in names], table["bucket"].to_numpy()] = table["n"].to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col) if model is None else model)

    def predict(batch):
        got = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    found = map_batches(id_text(docs, id_col, text_col), predict, "doc_id bigint,lang_pred string,score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
