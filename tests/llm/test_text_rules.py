"""Repetition rules, PII, language, quality and backoff scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremor.llm import langid_em, lm_backoff, pii_crf, quality_ordinal, repetition

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
small_text = st.text(alphabet="ab \n#|é.", max_size=80)


def slow_measure(text, lengths):
    w = WORDS.findall(text)

    def cover(n, weigh):
        at = {}
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i:i + n]), []).append(i)
        first = weigh == "later"
        inside = {j for v in at.values() if len(v) > 1 for i in (v[1:] if first else v) for j in range(i, i + n)}
        return sum(len(w[j]) if weigh else 1 for j in inside)

    seen, lines, chars = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            if line in seen:
                lines += 1
                chars += sum(map(len, WORDS.findall(line)))
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, cover(3, ""), chars, *[cover(n, "later") for n in lengths]]


@settings(max_examples=300, deadline=None)
@given(small_text)
def test_repetition_measures(text):
    assert repetition.measure(text, [5, 6, 8]) == slow_measure(text, [5, 6, 8])


def test_repetition_rules(odd_documents, no_documents):
    got = repetition.repetition_rules(odd_documents).toPandas()
    assert len(got) == 8 and got[got.doc_id == 2].base_failed.all() and not got[got.doc_id == 1].kept.any()
    assert repetition.repetition_rules(no_documents).count() == 0
    kept = repetition.filter_repetition(odd_documents)
    assert kept.columns == odd_documents.columns
    assert repetition.filter_repetition(no_documents).count() == 0


def test_a_repeated_heading_is_no_repetition():
    body = " ".join(f"w{i}" for i in range(70))
    m = repetition.measure(f"a heading of nine words which comes back later\n{body}\na heading of nine words which comes back later", repetition.Rules().lengths)
    assert repetition.verdict(m, repetition.Rules()) == (False, True)
    assert not repetition.verdict(repetition.measure("spam ham " * 60, repetition.Rules().lengths), repetition.Rules())[1]


# ------------------------------------------------------------------ PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def slow_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and slow_luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet="ab1.@-+ ", max_size=40), st.text(alphabet="012345678 9.-+()", max_size=60),
                 st.lists(st.sampled_from(["4539 1488 0343 6467", "10.0.0.255", "256.1.1.1", "a@b.co", "+1 (555) 010-9999", "x", " ", "@", ".", "1"]), max_size=8).map("".join)))
def test_base_spans(text):
    assert pii_crf.base_spans(text) == slow_spans(text)


def test_long_runs_stay_linear():
    text = "1" * 200_000 + " " + "a" * 200_000 + " " + "@" * 1000 + "1.2." * 50_000
    pii_crf.all_spans(text, {"bias": [-2.0] * len(pii_crf.KINDS)})


def brute_decode(w, lat):
    """Best score over all segmentations."""
    n = len(lat.atoms)

    def best(j):
        if j == 0:
            return 0.0
        own = [best(j - 1)]
        for i, f in lat.ending[j]:
            own.append(best(i) + max(pii_crf._scores(w, f)))
        return max(own)

    return best(n)


def test_decoding_is_the_best_segmentation():
    rng = np.random.default_rng(1)
    text = 'call (017) 555-7713 or 12-34 at a.b@c and "9f8e7d6c" now'
    for s, e in pii_crf.stretches(text, []):
        lat = pii_crf.lattice(text, s, e)
        names = sorted({f for end in lat.ending for _, fs in end for f in fs})
        w = {f: list(rng.normal(0, 0.4, len(pii_crf.KINDS))) for f in names}
        place = {a[0]: i for i, a in enumerate(lat.atoms)}
        ends = {a[1]: i + 1 for i, a in enumerate(lat.atoms)}
        score = 0.0
        for kind, a, b in pii_crf.decode(w, lat):
            f = next(f for i, f in lat.ending[ends[b]] if i == place[a])
            score += pii_crf._scores(w, f)[pii_crf.KINDS.index(kind)]
        assert score == pytest.approx(brute_decode(w, lat))


def test_pii_learns_and_redacts(spark, odd_documents, no_documents):
    rows = [(i, f"word here +1 (555) 010-{1000 + i} and token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" then page {i} of 20 in 1999") for i in range(150)]
    w = pii_crf.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))
    new = 'write +1 (555) 011-2222 or token = "0123456789abcdef0123456789abcdef01234567" on page 7 of 20 in 1999'
    base, added = pii_crf.all_spans(new, w)
    assert [new[a:b] for _, a, b in base] == ["+1 (555) 011-2222"]
    assert [(k, new[a:b]) for k, a, b in added] == [("secret", "0123456789abcdef0123456789abcdef01234567")]
    assert pii_crf.redacted(new, w) == 'write [PHONE] or token = "[SECRET]" on page 7 of 20 in 1999'
    got = pii_crf.find_pii(odd_documents).toPandas()
    assert len(got) == 8 and set(got.base_sha256) == {hashlib.sha256(b"").hexdigest()}
    assert pii_crf.find_pii(no_documents).count() == 0
    assert odd_documents.select(pii_crf.redact(F.col("text"), w).alias("t")).filter("t is null").count() == 1


# ------------------------------------------------------------------ language

def test_mixture_shares():
    rng = np.random.default_rng(0)
    logs = rng.normal(-20, 0.5, (200, 3))
    logs[:140, 0] += 9
    logs[140:, 2] += 9
    shares = langid_em.mixture(logs)
    assert shares.argmax() == 0 and shares[1] == 0 and shares[0] == pytest.approx(0.7, abs=0.02)
    assert langid_em.mixture(logs[:140]).tolist() == [1.0, 0.0, 0.0]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid_em.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]


def test_language_of_odd_rows(odd_documents, no_documents):
    got = langid_em.identify(odd_documents).toPandas()
    assert len(got) == 8
    assert set(got[got.doc_id.isin([2, 3, 6])].lang_pred) == {"und"}
    assert langid_em.identify(no_documents).count() == 0


# ------------------------------------------------------------------ quality

def test_ordinal_gradient_orders_grades():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 600)
    slots = [np.unique(np.concatenate([rng.integers(100, 400, 10), [int(g)] * (rng.random() < 0.95)]).astype(np.int64)) for g in grades]
    m = quality_ordinal.train(slots, grades)
    assert m.weights[0] < m.weights[1] < m.weights[2] and (np.diff(m.thresholds) > 0).all()
    tails = m.tails(float(m.weights[2]))
    assert tails[0] > tails[1] > 0.5


def test_quality_on_tables(spark, odd_documents, no_documents):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.filter("doc_id % 10 < 7")
    got = quality_ordinal.rate_documents(docs, seen).join(labels.filter("doc_id % 10 >= 7"), "doc_id").toPandas()
    assert got[(got.quality == 1) & (got.toxic == 0)].kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.1
    assert got[got.toxic == 1].kept.mean() < 0.45
    assert got.expected_grade.between(0, 2).all()
    none = labels.filter("false")
    for d in (odd_documents, no_documents):
        assert quality_ordinal.rate_documents(d, none).count() == d.count()


# ------------------------------------------------------------------ backoff

def slow_scores(texts):
    cls = [[zlib.crc32(x) & ((1 << lm_backoff.CLASS_BITS) - 1) for x in (t or "").encode().lower().split()] for t in texts]
    words, pairs = Counter(), Counter()
    for c in cls:
        words.update(c)
        pairs.update(zip(c, c[1:]))
    total, out = sum(words.values()), []
    for c in cls:
        own, own2, rest = Counter(c), Counter(zip(c, c[1:])), max(1, total - len(c))
        uni = lambda x: ((words[x] - own[x]) or lm_backoff.BACKOFF) / rest  # noqa: B023, E731
        s = 0.0
        for i, x in enumerate(c):
            p = (c[i - 1], x) if i else None
            n = pairs[p] - own2[p] if p else 0
            s += math.log(n / (words[p[0]] - own[p[0]]) if n else uni(x) * (lm_backoff.BACKOFF if p else 1))
        out.append(s / len(c) if c else None)
    return out


@pytest.mark.parametrize("share", [0.01, 0.5])
def test_backoff_scores(spark, odd_documents, no_documents, share, monkeypatch):
    monkeypatch.setattr(lm_backoff, "HOT_SHARE", share)
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()] + [(100 + i, "the cat sat on the mat " + "x" * i) for i in range(40)]
    got = lm_backoff.score(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    want = slow_scores([r[1] for r in rows])
    key = lambda xs: sorted((-1 if i is None or i != i else int(i), None if s is None or s != s else round(s, 3)) for i, s in xs)
    assert str(key(zip(got.doc_id, got.lm_score))) == str(key(zip([r[0] for r in rows], want)))
    assert lm_backoff.score(no_documents).count() == 0
