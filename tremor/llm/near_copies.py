"""Near copies by SimHash and the trie join, completed to exact Jaccard similarity.

Sets.  A text is the set of its shingles of ``SHINGLE`` words (a shorter text
is one shingle, a text without words the empty set), each a 62-bit token of
XXH64.  Two sets tie if their Jaccard similarity is ``SIMILAR`` (4/5) or more;
the groups are the components of that graph.  Equal sets always tie.

SimHash.  Texts get 64-bit fingerprints of their shingles, and the trie join of
``simhash_trie`` links those within ``BUDGET`` bits, about the distance at 4/5.
Every set is verified against one set of its fingerprint component, and groups
are formed of the ties.  That melts large groups of near copies at one pair per
set.  A distance of 64 random bits is a matter of chance, so what follows finds
the ties between the groups that fingerprints miss, exactly.

Prefixes.  In any fixed order of the tokens, two sets that tie share a token
among the first ``n - ceil(0.8 n) + 1`` of each.  Only these prefixes are dealt,
by token, so every tie is met, at any number of texts (no recall loss).  Tokens
found in several texts of a bounded sample come last in the order; the sample
decides where a pair is met, never whether.

Positions.  At the first token that two prefixes share, nothing before it is
common, so the overlap is at most what each set has from there on.  A pair is
given out only at tokens where that much is enough for a tie; at later shared
tokens less is left, so a pair that fails at its first one is never given out.
That is what parts copies edited too far from each other: their own words come
first in the order, and what they have in common begins too late.

Parities.  A set's shingles, dealt to 256 slots, leave each slot an odd or even
number.  Two sets differ in at least as many shingles as slots, so more than a
ninth of their sizes together in differing slots rules a tie out: that parts
texts that share a passage, without a look at them.

Rounds.  Tokens at which many groups still meet get rounds: some sets of the
token are paired with the sets of other components, the pairs are verified on
their texts, and components formed; each round takes other centres per token.
So what fingerprints leave of a group of n near copies costs about n pairs a
round, where all its pairs would be n squared.  The rounds end when few of their pairs tie.  They only save
work: last, every pair of *different* components that positions and parities
allow is verified.

Disk.  Tables are deleted once nothing reads them, shuffle files as the action
that made them ends; at most one action's shuffle lies on disk.

Defined results: a null text has no shingles, as an empty one; all texts without
words are one set; letter case of A-Z and white space do not tell texts apart;
repeated rows are one document; rows without an id come last in the choice of
the one that stays; extra columns are kept, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import bounded_sample, map_batches
from tremor.llm.key_bitmaps import bitmaps, sifted
from tremor.llm.simhash_trie import _signed, connected, folded, keep_first, narrow_rows, near_links, shingle_hashes
from tremor.session import brief_shuffles, discard, materialize

SHINGLE = 5
SEED = 42
SAMPLE = 4096
#: differing bits of fingerprints that are looked at, and the blocks of which two must agree
BUDGET, BLOCKS = 10, 8
#: rows a task gives out at a time
CHUNK = 1 << 18
#: components at a token from which on it takes part in further rounds, and how many rounds there are at most
MANY, TURNS = 8, 8
#: sets of a token that a further round pairs with the others
CENTRES = 8
PARITIES = ["p0", "p1", "p2", "p3"]
_TOKEN = np.uint64(1) << np.uint64(62)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text, k))


def parities(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four longs: whether an odd number of shingles falls to a slot."""
    odd = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """The same over one to two slots per shingle (a power of two, 256 at least)."""
    bits = max(8, len(hashes).bit_length())
    odd = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Slots in which two sketches differ, the longer folded to the shorter: no
    more than the shingles in which their sets differ."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(n, -1), axis=1) for s in (x, y))
    return int(np.count_nonzero(x != y))


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set; all texts without words share one."""
    x = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def ties(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 4/5 or more, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def prefix_length(n):
    """n - ceil(4 n / 5) + 1"""
    return n - (4 * n + 4) // 5 + 1


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of what several texts of a sample hold."""
    sample = bounded_sample(docs, SAMPLE, "order", "text")

    def own(batch):
        return {"h": np.concatenate([shingles(t) for t in batch.column(1).to_pylist()]).view(np.int64)}

    rows = map_batches(sample.select("order", "text"), own, "h bigint", slice_on=1).groupBy("h").count().filter("count > 1").toArrow()
    h, n = rows["h"].to_numpy().astype(np.int64).view(np.uint64), rows["count"].to_numpy().astype(np.uint64)
    by = np.argsort(h)
    return h[by], n[by]


def tokens(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tokens in the order of the prefixes: those of the sample last, by count."""
    out = hashes >> np.uint64(2)
    known, n = common
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        is_in = known[at] == hashes
        out[is_in] = _TOKEN | (n[at[is_in]] << np.uint64(48)) | (hashes[is_in] >> np.uint64(16))
    return np.sort(out).view(np.int64)


def _runs(sorted_on: int, batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of keys; rows come sorted by the key column.  Parts
    of a long run are joined once, when it ends."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        if not batch.num_rows:
            continue
        part = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        key = part[sorted_on]
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if cut or (held and held[-1][sorted_on][-1] != key[0]):
            held.append([x[:cut] for x in part])
            yield joined()
            held = [[x[cut:] for x in part]]
        else:
            held.append(part)
    if held:
        yield joined()


_SHARED = pa.schema([("token", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR)


def _shared_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, fp, size, pos), sorted: each set once, tokens of one set
    dropped."""
    for token, fp, size, pos in _runs(0, batches):
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
        token, fp, size, pos = token[new], fp[new], size[new], pos[new]
        first = np.append(0, np.flatnonzero(token[1:] != token[:-1]) + 1)
        length = np.diff(np.append(first, len(token)))
        keep = np.repeat(length > 1, length)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, fp, size, pos)], schema=_SHARED)


def _can_tie(size_a, pos_a, size_b, pos_b):
    """Whether what both sets have from a shared token on is enough for a tie."""
    return 9 * np.minimum(size_a - pos_a, size_b - pos_b) >= 4 * (size_a + size_b)


def _star_task(turn: int, many: int, centres: int):
    """Rows (token, root, fp, size, pos), sorted: where ``many`` components or
    more meet at a token, some of its sets with the sets of other components
    that may tie with them.  Centres are the sets with the least before the
    token, the next ones each turn: they have the fewest words of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, root, fp, size, pos in _runs(0, batches):
            new_token = np.append(True, token[1:] != token[:-1])
            starts = np.flatnonzero(new_token)
            lengths = np.diff(np.append(starts, len(token)))
            new_root = new_token | np.append(True, root[1:] != root[:-1])
            crowded = np.add.reduceat(new_root.astype(np.int64), starts) >= many
            by = np.lexsort((fp, pos, np.repeat(np.arange(len(starts)), lengths)))
            root, fp, size, pos = root[by], fp[by], size[by].astype(np.int64), pos[by].astype(np.int64)
            for rank in range(turn * centres, (turn + 1) * centres):
                centre = np.repeat(starts + np.minimum(rank, lengths - 1), lengths)
                here = np.repeat(crowded & (rank < lengths), lengths)
                keep = here & (root != root[centre]) & _can_tie(size, pos, size[centre], pos[centre])
                yield _pairs(fp[centre][keep], fp[keep])

    return run


def _pair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, size, fp, root, pos, four parities), sorted: pairs of a
    token's sets that lie in different components and may tie."""
    out, held = [], 0

    def flush():
        return _pairs(*(np.concatenate(x) for x in zip(*out)))

    for token, size, fp, root, pos, *bits in _runs(0, batches):
        n = len(token)
        size, pos = size.astype(np.int64), pos.astype(np.int64)
        ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, n)
        until = ends[np.searchsorted(ends, np.arange(n), side="right")]
        starts = np.append(0, ends[:-1])
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        live = np.arange(n)[np.repeat(mixed, np.diff(np.append(starts, n)))]
        step = 1
        while len(live):
            live = live[live + step < until[live]]
            # sizes ascend within a token: where what is left of a set is too little for one, it is for all after it
            live = live[9 * (size[live] - pos[live]) >= 4 * (size[live] + size[live + step])]
            cross = live[(root[live] != root[live + step]) & _can_tie(size[live], pos[live], size[live + step], pos[live + step])]
            if len(cross):
                apart = sum(np.bitwise_count((x[cross] ^ x[cross + step]).view(np.uint64)).astype(np.int64) for x in bits)
                cross = cross[9 * apart <= size[cross] + size[cross + step]]
            if len(cross):
                out.append((fp[cross], fp[cross + step]))
                held += len(cross)
                if held >= CHUNK:
                    yield flush()
                    out, held = [], 0
            step += 1
    if held:
        yield flush()


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that sketches of their sets do not rule out."""
    of = lambda s: sketches.select(F.col("fp").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))

    def check(batch):
        sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
        n = np.array([apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(5))], dtype=np.int64)
        ok = 9 * n <= sizes
        return {"a": batch.column(0).to_numpy()[ok], "b": batch.column(1).to_numpy()[ok]}

    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
    return map_batches(dealt, check, "a bigint,b bigint")


def _verified(pairs: DataFrame, texts) -> DataFrame:
    """(fp, root) of the pairs, a stored table, whose texts tie; stored."""
    wanted = materialize(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct(), "copies-wanted")
    text = materialize(texts(wanted), "copies-texts")
    of = lambda s: text.select(F.col("fp").alias(s), F.col("text").alias(f"text_{s}"))

    def check(batch):
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        known: dict[int, np.ndarray] = {}
        for ids, col in ((a, 2), (b, 3)):
            for i, x in enumerate(ids.tolist()):
                if x not in known:
                    known[x] = shingles(batch.column(col)[i].as_py())
        ok = np.array([ties(known[x], known[y]) for x, y in zip(a.tolist(), b.tolist())], dtype=bool)
        return {"fp": a[ok], "root": b[ok]}

    dealt = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    links = materialize(map_batches(dealt, check, "fp bigint,root bigint", slice_on=2), "copies-links")
    discard(wanted, text)
    return links


def fingerprint_pairs(sketches: DataFrame) -> DataFrame:
    """(a, b): each set with the smallest one of its fingerprint component."""
    roots = connected(near_links(sketches.select(F.col("sim").alias("fp")).distinct(), BUDGET, BLOCKS))
    sets = (sketches.select("fp", "sim").join(roots.select(F.col("fp").alias("sim"), "root"), "sim", "left")
            .select("fp", F.coalesce("root", "sim").alias("root")))
    low = sets.groupBy("root").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("root", "a")
    return sets.join(low, "root").where("a < fp").select("a", F.col("fp").alias("b"))


def near_copy_links(narrow: DataFrame, sketches: DataFrame, common, texts) -> DataFrame:
    """(fp, root) of every linked set: the smallest of its component.
    ``narrow`` has a text column; ``sketches`` fingerprint, parities, size and sketch
    of each fp; ``texts`` gives (fp, text) for a stored table of fp."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of the task; spares the rows of exact copies
        for batch in batches:
            parts = []
            for t in batch.column(0).to_pylist():
                h = shingles(t)
                name = set_id(h)
                if len(h) and name not in seen:
                    seen.add(name)
                    parts.append((tokens(h, common.value)[:prefix_length(len(h))], name, len(h)))
            if parts:
                lengths = [len(p[0]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), lengths)),
                     pa.array(np.repeat(np.array([p[2] for p in parts], np.int32), lengths)),
                     pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]))], schema=_SHARED)

    kinds = "token bigint,fp bigint,size int,pos int"
    rows = narrow.select("text").mapInArrow(prefixes, kinds)
    shared = materialize(rows.repartition("token").sortWithinPartitions("token", "fp").mapInArrow(_shared_task, kinds), "copies-shared")

    def labelled(of: DataFrame, roots: DataFrame) -> DataFrame:
        return of.join(roots, "fp", "left").select("token", F.coalesce("root", "fp").alias("root"), "fp", "size", "pos")

    def stars(of: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
        dealt = labelled(of, roots).repartition("token").sortWithinPartitions("token", "root", "fp")
        return dealt.mapInArrow(_star_task(turn, MANY, CENTRES), "a bigint,b bigint").distinct()

    def crossing(roots: DataFrame) -> DataFrame:
        rows = labelled(shared, roots)
        mixed = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
        rows = rows.join(mixed, "token", "left_semi").join(sketches.select("fp", *PARITIES), "fp").select("token", "size", "fp", "root", "pos", *PARITIES)
        dealt = rows.repartition("token").sortWithinPartitions("token", "size", "fp")
        return dealt.mapInArrow(_pair_task, "a bigint,b bigint").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        left = materialize(_possible(pairs, sketches), "copies-possible")
        links = _verified(left, texts)
        discard(left)
        return links

    tested = [materialize(fingerprint_pairs(sketches), "copies-fingerprints")]
    links = [verified(tested[0])]
    new = lambda pairs: pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
    roots = connected(links[0])
    many = labelled(shared, roots).groupBy("token").agg(F.count_distinct("root").alias("n")).where(F.col("n") >= MANY)
    crowded = materialize(shared.join(many, "token", "left_semi"), "copies-crowded")
    for turn in range(TURNS):
        pairs = materialize(new(stars(crowded, roots, turn)), "copies-stars")
        found = verified(pairs)
        n, n_ties = pairs.count(), found.count()
        links.append(found)
        tested.append(pairs)
        if n_ties:
            roots = connected(reduce(DataFrame.unionByName, links))
        if n_ties * 20 <= n:
            break
    pairs = materialize(new(crossing(roots)), "copies-pairs")
    discard(shared, crowded, *tested)
    links.append(verified(pairs))
    roots = connected(reduce(DataFrame.unionByName, links))
    discard(pairs, *links)
    return roots


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, every column kept: the smallest id (nulls
    last), then the smallest hash of the whole row.  Rows that are equal in
    every column count as one document."""
    with brief_shuffles(docs.sparkSession):
        return _drop_near_copies(docs, id_col, text_col)


def _drop_near_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = narrow_rows(docs, id_col, text_col)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(narrow.select("order", "text")))

    def own(batch):
        hashes = [shingle_hashes(t, SHINGLE) for t in batch.column(2).to_pylist()]
        sets = [np.unique(h) for h in hashes]
        bits = np.stack([parities(h) for h in sets])
        return {"order": batch.column(0), "tie": batch.column(1), "fp": [set_id(h) for h in sets], "sim": [_signed(folded(h)) for h in hashes],
                **{p: bits[:, i] for i, p in enumerate(PARITIES)}, "size": [len(h) for h in sets], "sketch": [sketch(h) for h in sets]}

    kinds = "order bigint,tie bigint,fp bigint,sim bigint,p0 bigint,p1 bigint,p2 bigint,p3 bigint,size int,sketch binary"
    prints = materialize(map_batches(narrow, own, kinds), "copies")
    # equal sets have equal parities and sketches; their fingerprints may differ by repeats, one will do
    sets = materialize(prints.groupBy("fp").agg(F.min(F.struct("order", "tie")).alias("first"), *[F.min(p).alias(p) for p in ("sim", *PARITIES, "size", "sketch")]),
                       "copies-sets")

    def texts(wanted: DataFrame) -> DataFrame:
        rows = materialize(sets.join(wanted, "fp", "left_semi").select("fp", F.col("first.order").alias("order"), F.col("first.tie").alias("tie")), "copies-rows")
        words = bitmaps(rows, ["order", "tie"], wanted=F.lit(True))
        some = sifted(narrow, ["order", "tie"], words, wanted=True)
        return some.join(rows, ["order", "tie"]).groupBy("order", "tie").agg(F.first("fp").alias("fp"), F.first("text").alias("text")).select("fp", "text")

    kept = keep_first(docs, prints, sets.select("fp", "first"), near_copy_links(narrow, sets, common, texts), id_col)
    discard(prints, sets)  # what is kept reads the stored keys of keep_first only
    return kept
