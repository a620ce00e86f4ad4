"""SimHash, packing, mixing, pages, vector search and the pipeline."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import cover_tree, html_consensus, mixing, packing, simhash_trie
from tremor.llm.common import bounded_sample

SF = "/root/testdata/sf0.001"


def components(fps, ids, budget=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(fps)
    for members in groups.values():
        known = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            out[i] = min(known) if known else None
    return out


def slow_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


# ------------------------------------------------------------------ SimHash

@pytest.mark.parametrize("seed", range(4))
def test_trie_join_links_all_near_pairs(spark, seed):
    """Random clusters, dense and sparse, against all pairs."""
    rng = np.random.default_rng(seed)
    fps = set()
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(int(rng.integers(1, 40))):
            f = centre
            for b in rng.integers(0, 64 if seed % 2 else 10, rng.integers(0, 5)).tolist():
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash_trie._signed(f),) for f in fps], "fp bigint")
    roots = {r.fp: r.root for r in simhash_trie.connected(simhash_trie.near_links(df)).collect()}
    want = components(fps, list(range(len(fps))))
    got = [roots.get(simhash_trie._signed(f), simhash_trie._signed(f)) for f in fps]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_dense_cluster_is_not_enumerated():
    """Every subset of 15 bits: the pairs within budget are many millions."""
    keys = np.arange(1 << 15, dtype=np.uint64)
    assert set(simhash_trie.trie_components(keys, 32, 2).tolist()) == {0}


def test_simhash_classes(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text"))
    rows = docs.collect()
    fps = [slow_print(r.text) for r in rows]
    want = sorted(zip([str(r.doc_id) for r in rows], [format(f, "016x") for f in fps], map(str, components(fps, [r.doc_id for r in rows]))))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_trie.simhash_classes(docs).collect())
    assert got == want
    assert simhash_trie.simhash_classes(no_documents).count() == 0


def test_one_of_each_group_stays(odd_documents, no_documents):
    kept = simhash_trie.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    # equal texts; all texts without a word; one of the two equal rows
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert simhash_trie.drop_near_duplicates(no_documents).count() == 0


# ------------------------------------------------------------------ packing

def test_best_two_fit():
    # greedy takes 6 + 3 and leaves 1 free; 2 + 2 fill the gap that the 3 leaves
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ([6, 2, 2], 1)
    rng = np.random.default_rng(3)
    for _ in range(50):
        h = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 30), rng.integers(1, 500, 30))}
        plan = packing.best_two_fit(h, 64)
        used = {}
        for pattern, times in plan:
            assert sum(pattern) <= 64
            for n in pattern:
                used[n] = used.get(n, 0) + times
        assert used == h
        total = sum(n * c for n, c in h.items())
        assert sum(t for _, t in plan) <= 1.25 * (total // 64 + 1)


def test_cuts():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_ids_equal_the_public_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a <|endoftext|> b", "don't  stop\n\n1234 éß あ\U0001f600\t x" * 3, "\r\n   x", "'S 'll"]
    for t in texts:
        assert packing.encoder(packing.vocabulary()).encode(t, allowed_special="all") == own.encode(t, add_special_tokens=False).ids


def check_packed(rows, texts, size=packing.LENGTH):
    """Pieces rebuild every document, sequences have neither gaps nor overlaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in texts:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % size or min(size, len(ids))
        starts = [0, *range(first, len(ids), size)]
        for k, s in enumerate(starts):
            part = np.array(ids[s:first if k == 0 else s + size], dtype="<u4")
            want.append((str(doc_id), k, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by_sequence)


def test_packing(spark, odd_documents, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.03 * (sum(r.length for r in rows) / packing.LENGTH) + 1
    check_packed(packing.pack_documents(odd_documents).collect(), [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert packing.pack_documents(no_documents).count() == 0
    ids = packing.pack_documents(odd_documents, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in ids)


# ------------------------------------------------------------------ mixing

def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        left, open_ = total - sum(cap * sizes[s] for s in full), [s for s in names if s not in full]
        out = {s: cap * sizes[s] if s in full else left * w[s] / sum(w[o] for o in open_) for s in names}
        over = {s for s in open_ if out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(x) for i, x in enumerate((10 ** rng.uniform(0, 5, 9)).astype(int))} | {None: 50, "\U0001f600": 3, "～": 70, "zero": 0}
    df = spark.createDataFrame([(s, x) for s, x in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = slow_targets(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix(spark, odd_documents, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = mixing.mixed_counts(docs)
    by = counts.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.taken - r.target) < 0.08 * r.target for r in by)
    assert counts.filter("taken > 3 * size or copies < floor(target / source_size)").count() == 0
    again = mixing.mixed_counts(docs.repartition(7))
    assert again.exceptAll(counts).count() == 0
    mixed = mixing.mix(odd_documents)
    assert mixed.columns == odd_documents.columns
    n = mixing.mixed_counts(odd_documents).agg(F.sum("copies")).first()[0]
    assert mixed.count() == n and mixing.mixed_counts(odd_documents).count() == 8
    assert mixing.mixed_counts(no_documents).count() == 0 and mixing.mix(no_documents).count() == 0


# ------------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body class=x><header><h2>Site</h2></header><nav><ul><li><a href="/a">menu<li>menu 2</ul></nav>
<div class="cookie-notice">We use cookies</div><div class="row"><div class="post-{n} content"><h1>Head &amp; line</h1>
<p>First <b>bold</b>ly said,&nbsp;{body}<p>second&#33; <i>in<i></p><form><input value="x">go</form><ul><li>one<li>two</ul>
<div class="ad">buy</div></div><aside>side {body}</aside><section id="comments"><p>reader says {body}</p></section></div><footer>foot</footer>"""


def test_extraction_leaves_only_the_article(spark):
    body = "some running words of the article, " * 12
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", PAGE.format(n=i, body=body)) for i in range(5)], "page_id bigint, url string, html string")
    want = " ".join(f"Head & line First boldly said, {body} second! in one two".split())
    rows = html_consensus.extract_pages(pages).collect()
    assert {r.text for r in rows} == {want} and {r.n_chars for r in rows} == {len(want)}


@pytest.mark.parametrize("page, want", [
    ("<body><div class='site-header'>Site</div><div id='main'><div class='entry-header'><h1>T</h1></div><p>one two three four</p></div><ol class='commentlist'><li>no</ol></body>", "T one two three four"),
    ("<main><article><p>one two three four five</p></article><article class='comment'><p>no no no</p></article></main>", "one two three four five"),
    ("<body><p>one <a href=x>linked</a> two</p><p style='display: none'>no</p><p hidden>no</p><ins class=adsbygoogle>no</ins></body>", "one linked two"),
    ("<div role=navigation>no</div><div role=main><p>yes it is</p></div><div role=contentinfo>no</div>", "yes it is"),
    ("<article>a<span>b</span><b>c</b> d<br>e<table><tr><td>1<td>2</table></article><![CDATA[no]]>", "abc d e 1 2"),
    ("<p>1 &lt; 2 &amp;&nbsp;3<p>4<script>no<p>no</script><!-- no --><p>5", "1 < 2 & 3 4 5"),
])
def test_layouts(page, want):
    assert html_consensus.extract(page, [html_consensus.vote(page)[0]]) == want


def test_the_host_decides_for_an_odd_page(spark):
    """A page whose sidebar is larger than its article follows its host."""
    even = '<div class="main-col">{}</div><div class="extra">{}</div>'
    pages = [(i, "http://h.example/x", even.format("article words, here " * 40, "short")) for i in range(6)]
    pages.append((9, "http://h.example/y", even.format("tiny article", "long list of things, " * 60)))
    got = {r.page_id: r.text for r in html_consensus.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[0] == " ".join("article words, here".split() * 40)


@pytest.mark.parametrize("html", ["", "<", "<a", "<a href='x", "</", "<!--", "<p>", "x", "<![foo[", "<div" * 999, "<a \"" * 999, "<b><p></b></p>" * 99,
                                  "<div>" * 3000 + "deep", "&#xfffffff;&bogus;", "<script>", "<textarea>a<p>b"])
def test_bad_markup_is_borne(html):
    assert isinstance(html_consensus.extract(html, [html_consensus.vote(html)[0]]), str)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, None, "<p>a&lt;b</p>", "x"), (1, None, "<p>a&lt;b</p>", "x"), (2, "http://u", "", "x")],
                                  "page_id bigint, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_consensus.extract_pages(pages).collect())
    assert got == [("1", "a<b", 3), ("1", "a<b", 3), ("2", "", 0), ("None", "", 0)]
    assert html_consensus.extract_pages(pages.filter("false")).count() == 0


# ------------------------------------------------------------------ vectors

def slow_top(rows, k, every):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [40, 10_000])
def test_top_k(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, [0.5] * 6) for i in range(300)]  # one vector many times: ties by id
    rows += [(0, [0.5] * 6), (7, None), (50, [None] * 6), (100, [float("nan")] * 6), (150, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (200, [1.0, 2.0]), (250, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in cover_tree.top_k(df, block_rows=block).collect())
    assert got == slow_top(rows, 5, 50)
    assert cover_tree.top_k(df.filter("false")).count() == 0


# ------------------------------------------------------------------ helpers, pipeline

def test_bounded_sample(spark):
    df = spark.range(5000).withColumn("order", F.lit(1))
    a, b = bounded_sample(df, 300, "id"), bounded_sample(df.repartition(9), 300, "id")
    assert a.count() == 300 and a.columns == df.columns and a.exceptAll(b).count() == 0


def test_pipeline(spark, odd_documents, no_documents):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_documents, no_documents):
        columns, counts = docs.columns, []
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
            counts.append(docs.count())
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        assert counts[0] >= counts[1] == counts[2]
    assert corpus_pipeline.run(spark, SF).count() > 100
