"""Importance resampling against a plain version, and its odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tremor.llm import target_resampling as tr

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n, buckets):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def plain_resample(rows, target, n, buckets, percent, min_words, seed):
    own = [(i, *plain_features(t, n, buckets)) for i, t in rows]
    s, t = sum((c for *_, c in own), Counter()), sum((plain_features(x, n, buckets)[1] for x in target), Counter())
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, words, counts in own:
        weight = sum(gain[b] * k for b, k in counts.items())
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(counts.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    ranked = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(ranked, 1) if k <= percent * len(ranked) // 100}
    return sorted(([*r[:4], rank.get(id(r))] for r in out), key=str)


@pytest.mark.parametrize("n,percent,min_words", [(1, 10, 20), (3, 60, 2)])
def test_against_plain(spark, odd_documents, n, percent, min_words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text"))
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = sorted((list(r) for r in tr.resample(docs, target, n, 500, percent, min_words, 7).collect()), key=str)
    want = plain_resample([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], n, 500, percent, min_words, 7)
    assert got == want
    assert any(r[4] for r in got)


def test_stretches_do_not_change_counts(monkeypatch):
    text = "One two\tTHREE 4four é-ß one two " + "x" * 300 + " two one " * 20
    want = [plain_features(text, n, 1000) for n in (1, 2, 4)]
    for stretch in (3, 17, 64, 1 << 20):
        monkeypatch.setattr(tr, "STRETCH", stretch)
        assert [tr.buckets_of(text, n, 1000) for n in (1, 2, 4)] == want


def test_empty_tables(spark, no_documents, odd_documents):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    assert tr.resample(no_documents, target).count() == 0
    rows = tr.resample(odd_documents, target.limit(0), percent=50).collect()
    assert len(rows) == 8 and sorted(r.rank for r in rows if r.rank) == [1]


def test_ties_take_the_smaller_id_and_places_are_whole(spark):
    """One score for all rows: places follow ids, equal ids are told apart by row."""
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 1000).alias("doc_id"), F.lit(3).alias("score"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    got = tr.places(rows, order, F.col("n")).collect()
    assert sorted(r.rank for r in got) == list(range(1, 5001))
    assert all(r.doc_id == (r.rank - 1) // 5 for r in got)


def test_draw_keeps_columns(spark, odd_documents):
    docs = odd_documents.where("doc_id in (1, 5)").dropDuplicates(["doc_id"])
    got = tr.draw(docs, spark.createDataFrame([("alpha",)], "text string"), percent=100)
    assert got.columns == docs.columns and got.count() == 2
