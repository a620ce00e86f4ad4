"""Near duplicates by SimHash and a binary trie self-join.

Fingerprints.  64 bits from XXH64 (seed 42) of the word shingles; a bit is set
if it is set in over half of them.

Join.  A sorted run of distinct fingerprints is a binary trie: a node is a
range of the run, its children are found by searching the next bit.  The join
walks *pairs of nodes* downwards, adds the differing bits, and drops a pair
once it exceeds the error budget.  A pair whose two ranges already lie in one
component is dropped too (only components are asked for), which keeps a dense
cluster of near copies from being enumerated pair by pair.

Distribution.  The 64 bits are cut into 4 blocks.  Two fingerprints that
differ in at most 2 bits agree on 2 whole blocks, so each of the 6 choices of
2 blocks gives a trie whose upper 32 levels allow no error: subtries with
different 32-bit prefixes never meet, and Spark deals them by that prefix.
Every link inside the budget is met in at least one of the six.  Wider budgets
(``blocks`` = 8: the 28 choices of 2 of 8 blocks) meet every pair of up to 6
differing bits, and beyond that the pairs that agree on two blocks.  A task
returns, for each subtrie, one link per fingerprint and component (at most as
many rows as it read), never all pairs.

Components.  Links are joined by alternating star contraction; each round is
aggregates and joins on DataFrames, its table is written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows keep one output row each; null ids never name a component
(a component of null ids only has a null id); an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import columns, fresh, id_text, map_batches, quoted
from tremor.llm.key_bitmaps import bitmaps, sifted
from tremor.session import discard, materialize

SEED = 42
BITS = 64
BLOCKS = 4
CHUNK = 1 << 17


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of every shingle of a text, in order, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1:].tolist())], dtype="<u8")


def folded(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; none give zero."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    return folded(shingle_hashes(text, shingle))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    return map_batches(
        id_text(docs, id_col, text_col),
        lambda b: {"doc_id": b.column(0), "fp": [_signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()]},
        "doc_id bigint,fp bigint")


# ---------------------------------------------------------------- trie self-join

def _choices(blocks: int = BLOCKS) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), 2))


def _permuted(fp: np.ndarray, choice: tuple[int, ...], blocks: int = BLOCKS) -> np.ndarray:
    """The chosen blocks first, the others after them."""
    width = np.uint64(BITS // blocks)
    mask = (np.uint64(1) << width) - np.uint64(1)
    out = np.zeros(len(fp), dtype=np.uint64)
    for block in [*choice, *(b for b in range(blocks) if b not in choice)]:
        out = (out << width) | ((fp >> np.uint64(int(width) * block)) & mask)
    return out


class _Labels:
    """Component of every leaf of a sorted run, and the end of each stretch of
    leaves of one component."""

    def __init__(self, n: int):
        self.of = np.arange(n, dtype=np.int64)
        self._runs()

    def _runs(self) -> None:
        n = len(self.of)
        ends = np.append(np.flatnonzero(self.of[1:] != self.of[:-1]) + 1, n)
        self.until = ends[np.searchsorted(ends, np.arange(n), side="right")]

    def same(self, lo, hi, lo2, hi2) -> np.ndarray:
        return (self.of[lo] == self.of[lo2]) & (self.until[lo] >= hi) & (self.until[lo2] >= hi2)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.of[a], self.of[b]
        while len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            differ = low != high
            if not differ.any():
                break
            a, b, low, high = a[differ], b[differ], low[differ], high[differ]
            parent = np.arange(len(self.of))
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.of = parent[self.of]
            a, b = parent[a], parent[b]
        self._runs()


def trie_components(keys: np.ndarray, free: int, budget: int) -> np.ndarray:
    """Component (index of its first leaf) of every key of a sorted run of
    distinct keys.  Keys may differ in the lowest ``free`` bits only: the
    levels above allow no error.  Any tie of two keys is within ``budget``."""
    n = len(keys)
    labels = _Labels(n)
    prefix = keys >> np.uint64(free)
    cuts = np.append(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, n)
    lo = np.concatenate([[0], cuts[:-1]])
    many = cuts - lo > 1
    lo, hi = lo[many], cuts[many]
    # a stack of blocks of node pairs of one level: (bit, lo, hi, lo2, hi2, differing bits)
    stack = [(free - 1, a, b, a, b, np.zeros(len(a), dtype=np.int8)) for a, b in _pieces(lo, hi)]
    while stack:
        bit, lo, hi, lo2, hi2, diff = stack.pop()
        live = ~labels.same(lo, hi, lo2, hi2)
        single = live & (hi - lo == 1) & (hi2 - lo2 == 1)
        a, b = lo[single], lo2[single]
        near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
        if near.any():
            labels.link(a[near], b[near])
        live &= ~single
        if bit < 0 or not live.any():
            continue
        lo, hi, lo2, hi2, diff = (x[live] for x in (lo, hi, lo2, hi2, diff))
        own = lo == lo2
        mid, mid2 = _split(keys, lo, hi, bit), _split(keys, lo2, hi2, bit)
        parts = [(lo, mid, lo2, mid2, diff), (mid, hi, mid2, hi2, diff), (lo, mid, mid2, hi2, diff + 1),
                 (mid[~own], hi[~own], lo2[~own], mid2[~own], diff[~own] + 1)]
        lo, hi, lo2, hi2, diff = (np.concatenate(x) for x in zip(*parts))
        full = (hi > lo) & (hi2 > lo2) & (diff <= budget)
        lo, hi, lo2, hi2, diff = (x[full] for x in (lo, hi, lo2, hi2, diff))
        # pairs of equal prefixes come last in the stack, so that clusters join up early
        order = np.argsort(-diff, kind="stable")
        for i in range(0, len(order), CHUNK):
            o = order[i:i + CHUNK]
            stack.append((bit - 1, lo[o], hi[o], lo2[o], hi2[o], diff[o]))
    return labels.of


def _pieces(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(lo), CHUNK):
        yield lo[i:i + CHUNK], hi[i:i + CHUNK]


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index of each range whose key has the bit set."""
    b = np.uint64(bit)
    border = ((keys[lo] >> b) | np.uint64(1)) << b
    return np.clip(np.searchsorted(keys, border), lo, hi)


def _join_task(budget: int, free: int):
    schema = pa.schema([("fp", pa.int64()), ("root", pa.int64())])

    def links(trie: int, keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        comp = trie_components(keys, free, budget)
        tied = np.flatnonzero(comp != np.arange(len(comp)))
        return pa.RecordBatch.from_pydict({"fp": fps[tied], "root": fps[comp[tied]]}, schema=schema) if len(tied) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (trie, key).  A block ends where the prefix
        changes, so a subtrie is never torn."""
        trie, keys, fps = -1, [], []
        held = 0
        for batch in batches:
            t, k, f = (batch.column(i).to_numpy() for i in range(3))
            edges = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
            for s, e in zip(edges[:-1], edges[1:]):
                if e == s:
                    continue
                part, own = (k[s:e].view(np.uint64) ^ np.uint64(1 << 63)), f[s:e]
                if t[s] != trie:
                    if held and (out := links(trie, np.concatenate(keys), np.concatenate(fps))):
                        yield out
                    trie, keys, fps, held = t[s], [], [], 0
                keys, fps, held = [*keys, part], [*fps, own], held + e - s
                if held >= CHUNK:
                    a, b = np.concatenate(keys), np.concatenate(fps)
                    top = a >> np.uint64(free)
                    cut = int(np.searchsorted(top, top[-1]))  # the last subtrie may go on
                    if cut:
                        if out := links(trie, a[:cut], b[:cut]):
                            yield out
                        keys, fps, held = [a[cut:]], [b[cut:]], len(a) - cut
        if held and (out := links(trie, np.concatenate(keys), np.concatenate(fps))):
            yield out

    return run


def near_links(distinct: DataFrame, budget: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root): links between distinct fingerprints within the budget, as
    stars; together they connect what any pair connects that is within the
    budget and agrees on two blocks, as any does within ``blocks`` - 2 bits."""
    assert BITS % blocks == 0 and budget >= blocks - 2
    free = BITS - 2 * (BITS // blocks)
    schema = "trie int,key bigint,fp bigint"

    def spread(batch):
        fp = batch.column(0).to_numpy()
        keys = [(_permuted(fp.view(np.uint64), c, blocks) ^ np.uint64(1 << 63)).view(np.int64) for c in _choices(blocks)]
        return {"trie": np.repeat(np.arange(len(keys), dtype=np.int32), len(fp)), "key": np.concatenate(keys),
                "fp": np.tile(fp, len(keys))}

    rows = map_batches(distinct.select("fp"), spread, schema)
    subtrie = F.shiftright("key", free)
    return (rows.repartition("trie", subtrie).sortWithinPartitions("trie", "key")
            .mapInArrow(_join_task(budget, free), "fp bigint,root bigint"))


# ---------------------------------------------------------------- components

def connected(links: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint of the component of each linked one.

    Alternating large-star and small-star steps until no link changes.  A step
    is one aggregate with partial sums and one join on the node; a node with
    very many links is a skewed join key, which adaptive execution splits.
    """
    edges = materialize(links.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b"))
                        .filter("a <> b").distinct(), "simhash-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low2.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        done, edges = edges, materialize(small, "simhash-links")
        discard(done)
        # equal sums of the same number of links mark the fixed point
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = now


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 2, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, fp, root): every document's fingerprint and the fingerprint
    that stands for its component."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    roots = connected(near_links(prints.select("fp").distinct(), budget))
    return prints.join(roots, "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def simhash_classes(docs: DataFrame, shingle: int = 3, budget: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    by_print = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = connected(near_links(by_print, budget))
    # only linked fingerprints need their component's id; they are joined back per fingerprint
    linked = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    tied = linked.join(by_print, "fp")
    ids = tied.groupBy("root").agg(F.min("low").alias("component"))
    per_print = (by_print.join(tied.select("fp", "root").join(ids, "root").select("fp", "component"), "fp", "left")
                 .select("fp", F.coalesce("component", "low").alias("component_id")))
    return prints.join(per_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _order_and_tie(docs: DataFrame, id_col: str) -> tuple:
    row = F.xxhash64(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("\0")) for c in docs.columns])
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), row


def narrow_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(order, tie, text): ids, nulls last, and hashes of whole rows."""
    order, row = _order_and_tie(docs, id_col)
    return docs.select(order.alias("order"), row.alias("tie"), F.col(text_col).cast("string").alias("text"))


def first_rows(prints: DataFrame) -> DataFrame:
    """(fp, first): the first (order, tie) of every fingerprint."""
    return materialize(prints.groupBy("fp").agg(F.min(F.struct("order", "tie")).alias("first")), "simhash-distinct")


def keep_first(docs: DataFrame, prints: DataFrame, by_print: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """The first document of each component; n counts rows equal to it.  What
    bitmaps of the keys tell apart is not dealt out: only rows whose bit both
    kept and other rows have are joined."""
    mark_o, mark_t = fresh(docs, "row_order"), fresh(docs, "row_tie")
    order, row = _order_and_tie(docs, id_col)
    best = (by_print.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
            .select(F.col("first.order").alias("order"), F.col("first.tie").alias("tie"), F.lit(True).alias("kept")))
    counts = prints.groupBy("order", "tie").agg(F.count("*").alias("n"))
    known = materialize(counts.join(best, ["order", "tie"], "left"), "simhash-winners")
    once, more = known.filter("kept and n = 1"), known.filter("kept and n > 1")
    is_once, is_more = F.coalesce("kept", F.lit(False)) & (F.col("n") == 1), F.coalesce("kept", F.lit(False)) & (F.col("n") > 1)
    words = materialize(bitmaps(known, ["order", "tie"], once=is_once, more=is_more, other=~is_once), "simhash-bitmaps")
    key = docs.select(*columns(docs), order.alias(mark_o), row.alias(mark_t))
    of = lambda **groups: sifted(key, [mark_o, mark_t], words, **groups)
    on = lambda w: (F.col(mark_o) == w["order"]) & (F.col(mark_t) == w["tie"])
    sure = of(once=True, other=False).select(columns(docs))
    single = sure.unionByName(of(once=True, other=True).join(once, on(once), "left_semi").select(columns(docs)))
    if more.isEmpty():
        return single
    repeated = of(more=True).join(more, on(more), "left_semi").dropDuplicates([mark_o, mark_t]).select(columns(docs))
    return single.unionByName(repeated)


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One document of each component, every column kept: the smallest id
    (nulls last), then the smallest hash of the whole row.  Rows that are equal
    in every column count as one document."""
    prints = materialize(map_batches(
        narrow_rows(docs, id_col, text_col), lambda b: {"order": b.column(0), "tie": b.column(1),
                                                        "fp": [_signed(fingerprint(t, shingle)) for t in b.column(2).to_pylist()]},
        "order bigint,tie bigint,fp bigint"), "simhash")
    by_print = first_rows(prints)
    return keep_first(docs, prints, by_print, connected(near_links(by_print.select("fp"), budget)), id_col)
