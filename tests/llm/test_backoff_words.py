"""Backoff scores against counts of the words themselves, where words collide
in a hash of 20 bits."""

import math
import zlib
from collections import Counter

import pytest

from tremor.llm import lm_backoff


def slow_scores(texts):
    docs = [t.lower().split() for t in texts]
    words, pairs = Counter(), Counter()
    for d in docs:
        words.update(d)
        pairs.update(zip(d, d[1:]))
    total, out = sum(words.values()), []
    for d in docs:
        own, own2, rest, s = Counter(d), Counter(zip(d, d[1:])), max(1, total - len(d)), 0.0
        for i, w in enumerate(d):
            p = (d[i - 1], w)
            n = pairs[p] - own2[p] if i else 0
            back = ((words[w] - own[w]) or 0.4) / rest * (0.4 if i else 1)
            s += math.log(n / (words[p[0]] - own[p[0]]) if n else back)
        out.append(s / len(d))
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9])
def test_words_that_share_a_class_are_two_words(spark, share, monkeypatch):
    monkeypatch.setattr(lm_backoff, "HOT_SHARE", share)
    seen, twins, i = {}, [], 0
    while len(twins) < 12:
        w = f"word{i}"
        c = zlib.crc32(w.encode()) & 0xFFFFF
        if c in seen:
            twins.append((seen[c], w))
        seen[c], i = w, i + 1
    texts = [f"the {a} sat on the mat {k % 3}" for k, (a, _) in enumerate(twins)] + [f"the {b} lay {b} on it" for _, b in twins]
    got = {r.doc_id: r.lm_score for r in lm_backoff.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for k, want in enumerate(slow_scores(texts)):
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_a_pair_costs_one_key_per_bundle_and_counts_meet_across_ranges(spark, monkeypatch):
    """Many copies of one text in several bundles and key ranges: scores are
    those of brute force, and rows are dealt per bundle, not per document."""
    monkeypatch.setattr(lm_backoff, "BUNDLE_BYTES", 2000)
    monkeypatch.setattr(lm_backoff, "RANGE_WORDS", 500)
    monkeypatch.setattr(lm_backoff, "HOT_SHARE", 2.0)  # nothing is broadcast
    texts = ["one two three four five six seven"] * 200 + [f"own{i} words{i} of one two" for i in range(60)] + ["", "single"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    counts = lm_backoff.count(docs)
    assert len(counts.words) == len(counts.pairs) == 0
    got = {r.doc_id: r.lm_score for r in lm_backoff.score(docs).collect()}
    for k, want in enumerate(slow_scores([t for t in texts if t])):
        assert got[k if k < 260 else 261] == pytest.approx(want, abs=1e-9)
    assert got[260] is None
    asked = docs.mapInArrow(lm_backoff._asked_task(spark.sparkContext.broadcast(counts), 4, 2000), lm_backoff._ASKED).toPandas()
    assert asked.bundle.nunique() > 3
    assert asked["keys"].map(len).sum() / 8 < 1200  # 2,300 (document, key) rows before
