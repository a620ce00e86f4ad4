"""Stupid-backoff language model scores, computed relationally.

Words and pairs of words are keyed by 64-bit hashes; the vocabulary is as
large as the corpus makes it.  Each document is scored by the counts of all
*other* documents (its own are subtracted), word after word:

    count(v w) / count(v)            if the pair occurs elsewhere,
    BACKOFF * count(w) / total       else, if the word does,
    BACKOFF ** 2 / total             else,

and by the last two without the first factor for the first word.  The score is
the mean logarithm per word.

Count tables.  A task cuts its documents into bundles of about ``BUNDLE_BYTES``
of text.  The distinct keys of a bundle, with their counts in it, are dealt by
key range: one row per bundle and range holds them as packed arrays, so a pair
costs about 8 bytes of shuffle once per bundle and not once per document.  Each
range is one part of the count table: it sums the bundles' counts and answers
each bundle with what the others hold, in the order of the keys asked for.  The
answers meet the bundle's texts, where every document is scored.  The number of
ranges follows the words of the corpus, so neither a range nor a bundle grows
with it, and a key has at most one row per bundle: there is no hot key.

The texts are read twice and must be cut alike: a bundle's name holds a hash of
its texts, and one without its answers is an error, not a wrong score.

Frequent keys.  Words and pairs found in at least ``HOT_SHARE`` of ``HOT_SAMPLE``
sampled documents (a bounded set) are summed per task instead, exactly, and
broadcast; the sample decides where a key is counted, never what its count is.

Defined results: null and empty texts have no words and a null score; repeated
rows are scored one by one and count as other documents to each other; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import bounded_sample, id_text, map_batches, schema_of

#: bits of a word's key
CLASS_BITS = 64
BACKOFF = 0.4
HOT_SAMPLE = 4096
HOT_SHARE = 0.01
BUNDLE_BYTES = 5 << 20
#: words of the corpus for each range of the count table
RANGE_WORDS = 1 << 20


def word_keys(text: str | None) -> np.ndarray:
    """Key of every word, in order."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


def pairs(c: np.ndarray) -> np.ndarray:
    v, w = c[:-1].view(np.uint64), c[1:].view(np.uint64)
    x = v * np.uint64(0x9E3779B97F4A7C15) + ((w << np.uint64(31)) | (w >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def hot_keys(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words and of the pairs common enough to be a hot key.
    At most 1 / HOT_SHARE times the distinct ones of a document."""
    sample = bounded_sample(docs, HOT_SAMPLE, "doc_id", "text")

    def own(batch):
        keys = [word_keys(t) for t in batch.column(1).to_pylist()]
        kinds = [[np.unique(c) for c in keys], [np.unique(pairs(c)) for c in keys]]
        sizes = [sum(map(len, k)) for k in kinds]
        return {"kind": np.repeat(np.arange(2, dtype=np.int32), sizes), "key": np.concatenate(kinds[0] + kinds[1])}

    seen = map_batches(sample, own, "kind int,key bigint", slice_on=1).groupBy("kind", "key").count()
    least = max(2, int(HOT_SHARE * sample.count()))
    found = seen.filter(F.col("count") >= least).select("kind", "key").toArrow()
    kind, key = found["kind"].to_numpy(), found["key"].to_numpy().astype(np.int64)
    return np.sort(key[kind == 0]), np.sort(key[kind == 1])


@dataclass
class Counts:
    """Counts of the hot words and pairs, and of all words together."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    total: int


def _among(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of keys in a sorted run."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _count_task(words: np.ndarray, hot: np.ndarray):
    schema = pa.schema([("place", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + len(words) + len(hot), dtype=np.int64)  # the first for all words
        for batch in batches:
            for text in batch.column(1).to_pylist():
                c = word_keys(text)
                sums[0] += len(c)
                for known, keys, base in ((words, c, 1), (hot, pairs(c), 1 + len(words))):
                    at, there = _among(known, keys)
                    np.add.at(sums, base + at[there], 1)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"place": used, "n": sums[used]}, schema=schema)

    return run


def count(docs: DataFrame) -> Counts:
    """Sums the tasks' tables; the driver gets a row per hot word and pair."""
    words, hot = hot_keys(docs)
    rows = docs.mapInArrow(_count_task(words, hot), "place bigint,n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(1 + len(words) + len(hot), dtype=np.int64)
    sums[rows["place"].to_numpy().astype(np.int64)] = rows["n"].to_numpy()
    return Counts(words, sums[1:1 + len(words)], hot, sums[1 + len(words):], int(sums[0]))


def packed(counts: np.ndarray) -> bytes:
    """Counts as planes of equal bytes: small numbers leave runs of zeros."""
    return counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def bundles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list]]:
    """(name, ids, texts) of the bundles of a task's rows (doc_id, text), cut
    at ``size`` bytes of text."""
    task, number, ids, texts, held, mark = TaskContext.get().partitionId(), 0, [], [], 0, xxhash.xxh64()

    def named() -> int:
        return int(np.array([xxhash.xxh64_intdigest(f"{task},{number},{len(ids)},{mark.intdigest()}")], np.uint64).view(np.int64)[0])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            ids.append(doc_id)
            texts.append(text)
            mark.update(b"%d," % len(raw))
            mark.update(raw)
            held += len(raw)
            if held >= size:
                yield named(), ids, texts
                number, ids, texts, held, mark = number + 1, [], [], 0, xxhash.xxh64()
    if ids:
        yield named(), ids, texts


@dataclass
class Bundle:
    """Keys of a bundle's words and then its pairs, and the counts of the hot
    ones; which are cold, the distinct cold ones and their counts in the bundle."""

    words: list[np.ndarray]
    flat: np.ndarray
    counts: np.ndarray
    cold: np.ndarray
    keys: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], k: Counts) -> Bundle:
        words = [word_keys(t) for t in texts]
        parts = []
        for keys, known, sums in ((words, k.words, k.word_counts), ([pairs(c) for c in words], k.pairs, k.pair_counts)):
            flat = np.concatenate(keys)
            place, hot = _among(known, flat)
            parts.append((flat, hot, np.where(hot, sums[place] if len(known) else 0, 0)))
        flat, hot, counts = (np.concatenate(x) for x in zip(*parts))
        keys, own = np.unique(flat[~hot].view(np.uint64), return_counts=True)
        return cls(words, flat, counts, ~hot, keys, own)

    def cuts(self, ranges: int) -> np.ndarray:
        """Where the sorted keys pass from one range to the next."""
        borders = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
        return np.concatenate([[0], np.searchsorted(self.keys, borders), [len(self.keys)]]).astype(np.int64)


_ASKED = "part int,bundle bigint,keys binary,own binary"
_MET = "bundle bigint,part int,doc_id bigint,text string,elsewhere binary"
_SCORES = "doc_id bigint,n_words bigint,log_prob double,lm_score double"


def _asked_task(shared, ranges: int, size: int):
    """A row per bundle and key range: its distinct cold keys and their counts."""
    schema = schema_of(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, texts in bundles(batches, size):
            b = Bundle.of(texts, shared.value)
            cuts = b.cuts(ranges)
            full = np.flatnonzero(np.diff(cuts))
            for some in np.array_split(full, 1 + len(full) // 4096):
                yield pa.RecordBatch.from_pydict({
                    "part": some, "bundle": [name] * len(some), "keys": [b.keys[cuts[i]:cuts[i + 1]].tobytes() for i in some],
                    "own": [packed(b.own[cuts[i]:cuts[i + 1]]) for i in some]}, schema=schema)

    return run


def _range_counts(rows: pa.Table) -> pa.Table:
    """One range of the count table, answered to each bundle that asked."""
    asked = [np.frombuffer(x, np.uint64) for x in rows["keys"].to_pylist()]
    own = np.concatenate([unpacked(x) for x in rows["own"].to_pylist()])
    _, at = np.unique(np.concatenate(asked), return_inverse=True)
    sums = np.zeros(int(at.max()) + 1, dtype=np.int64)
    np.add.at(sums, at, own)
    ends = np.cumsum([len(x) for x in asked])[:-1]
    n = rows.num_rows
    return pa.Table.from_pydict({"bundle": rows["bundle"], "part": rows["part"], "doc_id": [None] * n, "text": [None] * n,
                                 "elsewhere": [packed(x) for x in np.split(sums[at] - own, ends)]}, schema=schema_of(_MET))


def _texts_task(size: int):
    schema = schema_of(_MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, texts in bundles(batches, size):
            n = len(ids)
            yield pa.RecordBatch.from_pydict({"bundle": [name] * n, "part": [-1] * n, "doc_id": ids, "text": texts, "elsewhere": [None] * n}, schema=schema)

    return run


def log_prob(c: np.ndarray, word_counts: np.ndarray, pair_counts: np.ndarray, total: int) -> float:
    """Of a document's words, given the counts of each word and pair in all
    documents."""
    _, at, own = np.unique(c, return_inverse=True, return_counts=True)
    other = word_counts - own[at]
    back = np.log(np.where(other > 0, other, BACKOFF) / max(1, total - len(c)))
    if len(c) == 1:
        return float(back[0])
    _, at, own = np.unique(pairs(c), return_inverse=True, return_counts=True)
    others = pair_counts - own[at]
    found = others > 0
    seen = np.log(np.where(found, others, 1)) - np.log(np.where(found, other[:-1], 1))
    return float(back[0] + np.where(found, seen, np.log(BACKOFF) + back[1:]).sum())


def _score_bundle(shared, name: int, rows: pa.Table) -> pa.Table:
    """Scores of a bundle's documents: its texts and the answers of all ranges."""
    part = rows["part"].to_numpy()
    texts, ids = (rows[x].filter(pa.array(part < 0)).to_pylist() for x in ("text", "doc_id"))
    told = rows.filter(pa.array(part >= 0)).sort_by("part")["elsewhere"].to_pylist()
    b = Bundle.of(texts, shared.value) if texts else None
    elsewhere = np.concatenate([unpacked(x) for x in told]) if told else np.zeros(0, np.int64)
    if b is None or len(elsewhere) != len(b.keys):
        raise RuntimeError(f"bundle {name}: the documents were not read alike in both passes; store them first")
    b.counts[b.cold] = (elsewhere + b.own)[np.searchsorted(b.keys, b.flat[b.cold].view(np.uint64))]
    sizes = [len(c) for c in b.words]
    word_counts = np.split(b.counts[:sum(sizes)], np.cumsum(sizes)[:-1])
    pair_counts = np.split(b.counts[sum(sizes):], np.cumsum([max(0, n - 1) for n in sizes])[:-1])
    logs = [log_prob(c, w, p, shared.value.total) if len(c) else None for c, w, p in zip(b.words, word_counts, pair_counts)]
    return pa.Table.from_pydict({"doc_id": ids, "n_words": sizes, "log_prob": logs,
                                 "lm_score": [x / n if n else None for x, n in zip(logs, sizes)]}, schema=schema_of(_SCORES))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, lm_score), one row per document."""
    own = id_text(docs, id_col, text_col)
    counts = count(own)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    ranges = 1 + counts.total // RANGE_WORDS
    asked = own.mapInArrow(_asked_task(shared, ranges, BUNDLE_BYTES), _ASKED)
    answers = asked.groupBy("part").applyInArrow(_range_counts, _MET)
    met = own.mapInArrow(_texts_task(BUNDLE_BYTES), _MET).unionByName(answers)
    return met.groupBy("bundle").applyInArrow(lambda key, rows: _score_bundle(shared, key[0].as_py(), rows), _SCORES)
