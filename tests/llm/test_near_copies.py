"""The pipeline's near copies against all pairs of real shingle sets."""

import random

import pytest

import corpus_pipeline
from tremor.llm import near_copies

SF = "/root/testdata/sf0.001"


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(rows):
    """Smallest id of every component of pairs at Jaccard 0.8 or more, and the
    number of pairs of different sets."""
    sets, root, pairs = [five(t) for _, t in rows], list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                pairs += a != b
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return sorted(low.values()), pairs


def near_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    shared = " ".join(rng.choices(words, k=60))  # a passage that most texts hold
    texts = []
    for _ in range(30):
        base = (" ".join(rng.choices(words, k=rng.randint(60, 400))) + (" " + shared if rng.random() < 0.7 else "")).split()
        texts.append(" ".join(base))
        for _ in range(6):  # from far over to just under the border
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[:rng.randint(int(0.92 * len(copy)), len(copy))]))
    texts += ["a b", "A  b", "a b c", "", " ", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    rows = near_texts()
    want, pairs = slow_kept(rows)
    assert pairs > 100 and len(want) < len(rows) - 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == want


def test_one_of_each_group_stays(odd_documents, no_documents):
    kept = near_copies.drop_near_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert near_copies.drop_near_copies(no_documents).count() == 0


def test_pairs_of_one_large_group_stay_few(spark, monkeypatch):
    """Two thousand copies of one text, edited from a little to too much: the
    pairs verified stay few per set, and the groups are those of all pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=140)
    texts = []
    for i in range(2000):
        copy = list(base)
        for j in range(rng.choice([1, 1, 2, 4, 6, 9])):
            copy[rng.randrange(len(copy))] = f"own{i}x{j}"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(words, k=100)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    pairs, verified = [], near_copies._verified

    def counted(rows, texts_of):
        pairs.append(rows.count())
        return verified(rows, texts_of)

    monkeypatch.setattr(near_copies, "_verified", counted)
    got = sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect())
    assert sum(pairs) < 20 * len(texts)

    # all pairs, over copies whose sets differ from the base's by their edits
    sets = [five(t) for t in texts]
    inverted = {}
    for i, s in enumerate(sets):
        for g in s:
            inverted.setdefault(g, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in inverted[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == sorted({find(i) for i in range(len(sets))})
    assert len(got) < 2000


def test_parities_never_exceed_the_difference():
    rng = random.Random(5)
    for _ in range(300):
        a = [f"w{rng.randrange(60)}" for _ in range(rng.randint(5, 200))]
        b = a[:rng.randint(0, len(a))] + [f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 40))]
        x, y = near_copies.shingles(" ".join(a)), near_copies.shingles(" ".join(b))
        apart = sum(int(v).bit_count() for v in (near_copies.parities(x) ^ near_copies.parities(y)).view("uint64"))
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))


def test_fingerprints_meet_most_light_copies_through_the_trie(spark):
    """One pair per set of a fingerprint component, from the trie join; wider
    budgets than op8's meet what any two blocks in common allow."""
    from tremor.llm import simhash_trie

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(20):
        base = rng.choices(words, k=300)
        for i in range(10):
            copy = list(base)
            copy[rng.randrange(300)] = f"own{g}x{i}"
            h = near_copies.shingle_hashes(" ".join(copy), 5)
            rows.append((10 * g + i, simhash_trie._signed(simhash_trie.folded(h))))
    sketches = spark.createDataFrame(rows, "fp bigint, sim bigint")
    pairs = [(r.a, r.b) for r in near_copies.fingerprint_pairs(sketches).collect()]
    assert all(a // 10 == b // 10 and a < b for a, b in pairs) and len(set(pairs)) == len(pairs)
    assert 0.9 * 180 <= len(pairs) <= 180

    fps = {s for _, s in rows}
    apart = lambda x, y: ((x ^ y) & (2 ** 64 - 1)).bit_count()
    root = {s: s for s in fps}
    for r in simhash_trie.connected(simhash_trie.near_links(sketches.selectExpr("sim fp").distinct(), 10, 8)).collect():
        root[r.fp] = r.root
    assert all(root[x] == root[y] for x in fps for y in fps if apart(x, y) <= 6)


def shuffled_bytes(spark):
    """Bytes that the session's stages have written for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def shuffle_files(spark):
    """Bytes of shuffle files on the local disk."""
    import os

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(os.path.join(d, f)) for top in dirs for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_"))


def long_texts():
    """Long texts of which twelve have a near copy, and two each share a passage."""
    rng = random.Random(11)
    words = lambda n: [f"{rng.getrandbits(48):x}" for _ in range(n)]
    texts = []
    for g in range(110):
        passage = words(30)
        for _ in range(2):
            texts.append(" ".join(words(450) + passage + words(450)))
        if g < 12:
            texts.append(texts[-1] + " own")
    return list(enumerate(texts))


@pytest.fixture()
def no_broadcasts(spark):
    """Joins as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_dealt_for_pairs_only_and_disk_is_given_back(spark, no_broadcasts):
    """The texts used to be dealt out whole in each round and for the result,
    and all shuffle files and tables stayed."""
    from tremor import session

    rows = long_texts()
    docs = session.materialize(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "texts")
    size = sum(len(t) for _, t in rows)
    written, on_disk, tables = shuffled_bytes(spark), shuffle_files(spark), len(session._WRITTEN[spark])
    kept = near_copies.drop_near_copies(docs)
    got = sorted(r.doc_id for r in kept.collect())
    assert got == slow_kept(rows)[0] and len(got) == len(rows) - 12
    shuffled, left = sum(v for k, v in shuffled_bytes(spark).items() if k not in written), shuffle_files(spark) - on_disk
    assert shuffled < 3 * size and left < size // 10, (shuffled, left, size)  # the bounded sample holds all texts here: one time their size
    assert len(session._WRITTEN[spark]) - tables < 20


def test_wide_sketches_rule_out_long_texts_that_share_a_passage(spark, monkeypatch):
    rows = long_texts()
    pairs, verified = [], near_copies._verified

    def counted(of, texts):
        pairs.append(of.count())
        return verified(of, texts)

    monkeypatch.setattr(near_copies, "_verified", counted)
    monkeypatch.setattr(near_copies, "SAMPLE", 4)  # passages that the sample does not know
    near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert 12 <= sum(pairs) < 40, pairs


def test_sketches_never_differ_by_more_than_the_sets():
    rng = random.Random(6)
    for _ in range(300):
        a = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(0, 2500))]
        b = a[:rng.randint(0, len(a))] + [f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 40))]
        x, y = near_copies.shingles(" ".join(a)), near_copies.shingles(" ".join(b))
        n = near_copies.apart(near_copies.sketch(x), near_copies.sketch(y))
        assert n <= len(set(x.tolist()) ^ set(y.tolist())) and n == near_copies.apart(near_copies.sketch(y), near_copies.sketch(x))
        assert near_copies.apart(near_copies.sketch(x), near_copies.sketch(x)) == 0


def test_shared_bits_change_no_row(spark, odd_documents, monkeypatch):
    """One word of 64 bits for all keys: nearly every row is in doubt and joined on its key."""
    from tremor.llm import key_bitmaps

    monkeypatch.setattr(key_bitmaps, "WORDS", 1)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(odd_documents).collect()) == [1, 2, 4, 5]
    rows = near_texts(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == slow_kept(rows)[0]
