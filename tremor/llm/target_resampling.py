"""Importance resampling towards a target corpus, on hashed n-grams.

Features come from bytes: one 256-byte table lower-cases A-Z and blanks every
separator in a text's UTF-8, ``bytes.split`` gives the words, and the CRC-32 of
a longer n-gram continues from that of the shorter one (``crc32(b" " + next,
seed)``), so no n-gram is ever built.  Counters reduce the words of a stretch
before anything is hashed.  A feature's bucket is its CRC-32 modulo the number
of buckets.

Two passes read the texts.  The first sums buckets per task, at most
``buckets`` rows each, for the corpus and for the target; the gains of all
buckets follow from the two totals.  The second weighs each document and draws
its score: weight plus Gumbel noise from a SHA-256 of its id, so that the
highest scores are a sample without replacement by weight, the same in every
run.

The draw needs places among all eligible documents.  They are dealt by ranges
of (score, id, row), numbered as a stream within each range, and the ranges'
sizes, one row per range, shift those numbers: no task sorts the corpus, and a
score or an id that many rows share is divided by the row number.

Bounds: the gains are ``buckets`` longs, on the driver and in every task; long
texts are read in stretches of ``STRETCH`` bytes.

Defined results: null, empty and wordless texts have no features, weight 0 and
no rank.  A null id draws the noise of the word ``null`` and comes after equal
scores with ids.  Repeated rows are ranked one by one.  An empty corpus gives an
empty result; with an empty target every bucket counts as unseen there.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import id_text, map_batches, schema_of
from tremor.session import materialize

BUCKETS = 10_000
STRETCH = 1 << 20
#: digits, letters (lower-cased) and all bytes beyond ASCII stay; the rest is blank
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_stretches(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, some per stretch."""
    raw = text.encode() if text else b""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > STRETCH:
            stretch = raw[at:at + STRETCH].translate(TABLE)
            cut = stretch.rfind(b" ")
            while cut < 0 and at + len(stretch) < len(raw):  # a word longer than a stretch
                more = raw[at + len(stretch):at + 2 * len(stretch)].translate(TABLE)
                found = more.find(b" ")
                cut = len(stretch) + found if found >= 0 else -1
                stretch += more
            end = at + (cut if cut >= 0 else len(stretch))
            yield stretch[:end - at].split()
            at = end + 1
        else:
            yield raw[at:].translate(TABLE).split()
            return


def buckets_of(text: str | None, n: int = 1, buckets: int = BUCKETS) -> tuple[int, Counter]:
    """(words, times of each bucket) over runs of 1 to ``n`` words."""
    crc, n_words, counts, carry = zlib.crc32, 0, Counter(), []
    for words in word_stretches(text):
        n_words += len(words)
        for w, times in Counter(words).items():
            counts[crc(w) % buckets] += times
        if n > 1:
            run = carry + words
            ends = [crc(w) for w in run]
            for k in range(1, n):
                ends = [crc(b" " + w, seed) for seed, w in zip(ends, run[k:])]
                # runs that end in the carried words were counted with them
                counts.update(e % buckets for e in ends[max(0, len(carry) - k):])
            carry = run[-(n - 1):]
    return n_words, counts


def bucket_sums(docs: DataFrame, n: int, buckets: int, text_col: str) -> np.ndarray:
    """Times of each bucket over all texts, summed per task first."""
    arrow = schema_of("bucket bigint,times bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if counts := buckets_of(text.as_py(), n, buckets)[1]:
                    sums[list(counts)] += list(counts.values())
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], schema=arrow)

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket bigint, times bigint")
    total = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("times").alias("times")).collect():  # at most `buckets` rows
        total[r.bucket] = r.times
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    own = f"{seed}:{'null' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(own.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def places(rows: DataFrame, order: list[Column], limit: Column) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in ``order`` where it is at most
    ``limit``, an expression over ``n`` (all rows); null behind it.  ``order``
    must tell all rows apart."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = dealt.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = pa.array(np.arange(seen + 1, seen + 1 + batch.num_rows))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*batch.schema.names, "place"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    # written, so that a row keeps its range whatever is computed again
    placed = materialize(dealt.mapInArrow(run, f"{kinds}, place bigint").withColumn("part", F.spark_partition_id()), "draw")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"),
                         F.sum("size").over(Window.partitionBy()).alias("n"))
    at = F.col("before") + F.col("place")
    return placed.join(sizes, "part").select(*schema.names, F.when(at <= limit, at).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20,
             seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row per document; ``rank``
    is null for documents that are not drawn."""
    gain = gains(bucket_sums(docs, n, buckets, text_col), bucket_sums(target, n, buckets, target_text_col))

    def weigh(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_words", "n_features", "weight", "score")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words, counts = buckets_of(text.as_py(), n, buckets)
            times = np.fromiter(counts.values(), np.int64, len(counts))
            weight = int(gain[list(counts)] @ times) if counts else 0
            for c, x in zip(out, (doc_id, words, int(times.sum()), weight, weight + noise(doc_id, seed))):
                out[c].append(x)
        return out

    kinds = "doc_id bigint,n_words bigint,n_features bigint,weight bigint,score bigint"
    scored = materialize(map_batches(id_text(docs, id_col, text_col), weigh, kinds).withColumn("row", F.monotonically_increasing_id()),
                         "resample-scores")
    enough = F.col("n_words") >= min_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    drawn = places(scored.where(enough), order, F.floor(F.col("n") * percent / 100))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*names).unionByName(scored.where(~enough).select(*names[:-1], F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents themselves (every column), for ids that are unique."""
    chosen = resample(docs, target, **settings).where(F.col("rank").isNotNull())
    key = settings.get("id_col", "doc_id")
    return docs.join(chosen.select(F.col("doc_id").alias(key)), key, "left_semi")
