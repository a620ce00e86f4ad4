"""Best-two-fit packing of token sequences.

Documents become token ids plus an end id.  Longer ones are cut into pieces of
the sequence length, the first piece taking the rest.  Pieces are packed by
*length*: there are at most ``length`` different ones, so the whole packing
problem is a histogram of that many numbers, whatever the size of the corpus.

On the histogram: fill a bin greedily with the largest length that fits; then
replace its smallest piece by the two unpacked lengths that fill the expanded
gap best, if they fill it better.  The same bin is repeated while its lengths
last, in one step, so the number of steps depends on the number of lengths
only.  The result is a table of slots: pieces of length L ranked from ``lo``
to ``hi`` go to sequence ``first + rank - lo`` at ``offset``.

Spark does the rest: each task numbers its own pieces of each length, offsets
per (length, task) turn that into ranks, and a join with the slots places each
piece.  No group is larger than what one task has read, so documents of one
common length do not meet in one place.

Bounds: the histogram has at most ``length`` rows.  Each step uses up a length
or halves its remainder, so there are at most 2.5 * ``length`` steps and 64
slots a step: the slot table is a fixed size, and safe to broadcast.

Defined results: null and empty texts are a single end id; repeated rows are
packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.llm.common import id_text
from tremor.session import materialize

LENGTH = 2048
END_ID = 0
SPECIAL = {"<|endoftext|>": 50256}
_LOADED: dict[str, object] = {}


def vocabulary() -> str:
    """Path of the rank file of the byte-level vocabulary (same ids as
    ``byte_bpe_50k.json``)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _LOADED[path]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, the first may be shorter."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


_PIECES = "doc_id bigint,piece int,start bigint,length bigint,ids_crc32 bigint,place bigint"


def token_pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, keep_ids: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per piece; ``place`` counts the pieces of equal length that its
    task made before it.  ``keep_ids`` adds the token ids themselves."""
    path = path or vocabulary()
    schema = _PIECES + (",ids array<int>" if keep_ids else "")
    from tremor.llm.common import schema_of

    arrow = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        counts: dict[int, int] = {}
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text, allowed_special="all") if text else []
                ids.append(END_ID)
                raw = np.array(ids, dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    place = counts.get(n, 0)
                    counts[n] = place + 1
                    row = (doc_id, k, start, n, zlib.crc32(raw[start:start + n].tobytes()), place)
                    for name, x in zip(out, row):
                        out[name].append(x)
                    if keep_ids:
                        out["ids"].append(raw[start:start + n].astype(np.int32))
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


# ---------------------------------------------------------------- the histogram

def _largest(lengths: list[int], limit: int) -> int:
    """Index of the largest length up to ``limit``, or -1."""
    return bisect_right(lengths, limit) - 1


def _two(lengths: list[int], counts: dict[int, int], limit: int, floor: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (floor, limit]."""
    best, pair, lo = floor, None, 0
    hi = _largest(lengths, limit - 1)
    while 0 <= lo <= hi:
        a, b = lengths[lo], lengths[hi]
        if lo == hi and counts[a] < 2:
            break
        if a + b > limit:
            hi -= 1
            continue
        if a + b > best:
            best, pair = a + b, (b, a)
        lo += 1
    return pair


def _bin(lengths: list[int], counts: dict[int, int], size: int) -> list[int]:
    """The next bin's pieces, largest first.  ``lengths`` is sorted and holds
    every length with a positive count."""
    used: dict[int, int] = {}
    out, gap = [], size

    def left(i: int) -> bool:
        return counts[lengths[i]] > used.get(lengths[i], 0)

    while gap > 0:
        i = _largest(lengths, gap)
        while i >= 0 and not left(i):
            i -= 1
        if i < 0:
            break
        out.append(lengths[i])
        used[lengths[i]] = used.get(lengths[i], 0) + 1
        gap -= lengths[i]
    if gap > 0 and len(out) > 1:
        small = out[-1]
        rest = {n: counts[n] - used.get(n, 0) for n in lengths}
        free = [n for n in lengths if rest[n] > 0]
        if pair := _two(free, rest, small + gap, small):
            out = [*out[:-1], *pair]
    return sorted(out, reverse=True)


def best_two_fit(histogram: dict[int, int], size: int = LENGTH) -> list[tuple[list[int], int]]:
    """(pieces of a bin, how many such bins): packs every counted length."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts)
    plan = []
    while lengths:
        pattern = _bin(lengths, counts, size)
        use = {n: pattern.count(n) for n in pattern}
        times = min(counts[n] // u for n, u in use.items())
        plan.append((pattern, times))
        for n, u in use.items():
            counts[n] -= u * times
            if not counts[n]:
                lengths.remove(n)
                del counts[n]
    return plan


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, first sequence, offset): where ranks lo..hi-1 of a length go."""
    out, rank, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            lo = rank.get(n, 0)
            out.append((n, lo, lo + times, sequence, offset))
            rank[n] = lo + times
            offset += n
        sequence += times
    return out


# ---------------------------------------------------------------- placement

def place(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark: SparkSession = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(by_task.withColumn("before", F.coalesce(before, F.lit(0))), "pack-starts")
    histogram = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = spark.createDataFrame(slots(best_two_fit(histogram, size)) or [(0, 0, 0, 0, 0)],
                                  "length bigint, lo bigint, hi bigint, first bigint, offset bigint")
    ranked = (pieces.join(starts.select("length", "task", "before"), ["length", "task"])
              .withColumn("rank", F.col("before") + F.col("place")))
    at = F.broadcast(table.withColumnRenamed("length", "slot_length"))  # bounded, see the module's text
    placed = ranked.join(at, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("lo")).drop(
        "slot_length", "lo", "hi", "first", "rank", "before", "place", "task")


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None, keep_ids: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset (and ids, if asked for)."""
    pieces = materialize(token_pieces(docs, length, path, keep_ids, id_col, text_col), "pack-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(pieces, length).select(*names, *(["ids"] if keep_ids else []))
