"""Token counts against the tokenizer itself."""

import random

import pytest
from pyspark.sql import functions as F

from tremor.llm import token_counts as tc


@pytest.fixture(scope="module")
def own():
    return tc.pre_tokens(tc.default_path())


def counted(own, text):
    counts, added = own.frequencies(text)
    return added + sum(n * p for n, p in zip(counts.values(), own.pieces(list(counts))))


def by_library(own, text):
    return len(own.tokenizer.encode(text, add_special_tokens=False))


def test_random_strings(own):
    rng = random.Random(3)
    chars = [*"  \n\t'sdlmtrev", *"abcXYZ019.,!?-", "é", "ß", "ſ", "\x1c", "\x85", " ", " ", "　", "日", "本", "٣", "½", "🙂", "́", "‍",
             "՘", "֋", "꟎", "⃀", "<|endoftext|>", "<|", "|>"]
    for _ in range(4000):
        text = "".join(rng.choices(chars, k=rng.randint(0, 30)))
        assert counted(own, text) == by_library(own, text), repr(text)


def test_every_character(own):
    """All code points, a hundred in a text, each between letters, digits and blanks."""
    rng = random.Random(4)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    for k in range(0, 20_000, 100):
        text = "".join(rng.choice(["a", "1", " ", "", "."]) + chr(c) for c in points[k:k + 100])
        assert counted(own, text) == by_library(own, text)


def test_long_text_in_a_stream(own, monkeypatch):
    text = "Some words, 12 of them; naïve ones too.  \n" * 300
    want = own.frequencies(text)
    monkeypatch.setattr(tc, "LONG_TEXT", 10)
    assert own.frequencies(text) == want


@pytest.mark.parametrize("common", [0, 300, tc.COMMON])
def test_documents(spark, own, odd_documents, common):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(8, "a<|endoftext|>b <|endoftext|>"), (9, "x" * 5000), (9, "՘ and ꟎")], "doc_id bigint, text string"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tc.count_tokens(docs, common=common).collect())
    want = []
    for r in docs.collect():
        n = by_library(own, r.text or "")
        want.append((str(r.doc_id), len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_common_words_keep_their_bounds(spark):
    words = spark.range(1, 2001).select(F.concat(F.lit("w"), F.col("id")).alias("word"), (F.lit(2000) / F.col("id")).cast("long").alias("held_by"), F.lit(2).alias("pieces"))
    few = tc.common_words(words, 100)
    assert 0 < len(few) <= 100 and "w1" in few
    assert sum(map(len, tc.common_words(words, 10_000, 500))) <= 500
    assert tc.common_words(words, 0) == {}


def test_empty_and_other_files(spark, no_documents):
    import public_tokenizers

    assert tc.count_tokens(no_documents).count() == 0
    with pytest.raises(ValueError):
        tc.PreTokens(public_tokenizers.path("word_bpe_49k.json"))
