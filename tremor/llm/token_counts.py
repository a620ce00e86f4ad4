"""Token counts from pre-token frequencies.

Byte-level BPE works inside pre-tokens, so a text has as many tokens as its
pre-tokens have pieces.  Pieces are counted once per distinct pre-token of the
whole corpus, and documents are sums of frequencies times pieces: no document
is ever encoded, and no list of ids exists.

1. Each task emits its distinct pre-tokens with the number of documents that
   hold them; summed over tasks they are the table of pre-tokens, and one
   encoding of each gives its pieces.
2. A second pass over the texts takes each document's pre-token frequencies.
   Pre-tokens that many documents hold are looked up where they stand; the rest
   stay as frequencies, are joined to the table of pre-tokens, and are summed
   per document.

The common ones are those held by at least so many documents that no more than
``COMMON`` pre-tokens and ``COMMON_BYTES`` bytes qualify: a bounded table,
broadcast, and exact, as counts are over all documents.  A pre-token outside it
is held by few: less than about a ``COMMON``-th of all (document, pre-token)
pairs, or the table would have taken it, so the join has no hot key whatever
the text.  The choice decides where a pre-token is counted, never its count.

Pre-tokens are cut by a regular expression.  The tokenizer's own tables of
letters, digits and blanks may be of another Unicode version, so each character
beyond ASCII is tried on the tokenizer once per task; a text with a character
on which the two differ is cut by the tokenizer itself.  Added tokens of the
file are found first, as the library does, and count one each.

Needs a ``tokenizers`` file with byte-level BPE: no normalizer, the byte-level
pre-tokenizer with its regular expression and without a leading space, added
tokens without stripping or whole-word rules.  Other files are refused.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are
counted one by one, whatever their ids; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import id_text, schema_of
from tremor.session import materialize

LIMIT = 512
COMMON = 1 << 18
COMMON_BYTES = 1 << 24
FLUSH = 1 << 18
LONG_TEXT = 1 << 22
#: the byte-level pre-tokenizer's expression, a fixed value of the format
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same for texts in ASCII
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_LOADED: dict[str, "PreTokens"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokens:
    """Pre-tokens of texts, and pieces of pre-tokens, by one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, decoders

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        added = spec.get("added_tokens") or []
        if (spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or model.get("type", "BPE") != "BPE" or model.get("dropout") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.tokenizer, self._decode = Tokenizer.from_file(path), decoders.ByteLevel().decode
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = sorted((re.escape(a["content"]) for a in added), key=len, reverse=True)
        self._added = re.compile("|".join(names)) if names else None
        self._any, self._ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII, re.ASCII)
        self._same: set[str] = {chr(c) for c in range(128)}
        self._other: set[str] = set()

    def _agrees(self, char: str) -> bool:
        probe = f"a{char}1{char} {char}b"
        return self._by_library(probe) == self._any.findall(probe)

    def _by_library(self, text: str) -> list[str]:
        return [self._decode([piece]) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _cut(self, text: str) -> Iterable[str]:
        if text.isascii():
            split = self._ascii
        else:
            for char in set(text) - self._same - self._other:
                (self._same if self._agrees(char) else self._other).add(char)
            if not self._other.isdisjoint(text):
                return self._by_library(text)
            split = self._any
        # a list is faster, but a long text's would be many times the text
        return split.findall(text) if len(text) < LONG_TEXT else (m[0] for m in split.finditer(text))

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """(times of each pre-token, number of added tokens)."""
        if self._added is None or not self._added.search(text):
            return Counter(self._cut(text)), 0
        parts = self._added.split(text)
        counts = Counter()
        for part in parts:
            counts.update(self._cut(part))
        return counts, len(parts) - 1

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


def pre_tokens(path: str) -> PreTokens:
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]


def pre_token_table(texts: DataFrame, path: str) -> DataFrame:
    """(word, held_by, pieces): every distinct pre-token, the number of
    documents that hold it, and its pieces."""
    held = schema_of("word string,held_by bigint")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cut = Counter(), pre_tokens(path).frequencies

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], schema=held)

        for batch in batches:
            for text in batch.column(0):
                own.update(cut(text.as_py() or "")[0].keys())
                if len(own) >= FLUSH:
                    yield flush()
                    own.clear()
        yield flush()

    counted = schema_of("word string,held_by bigint,pieces int")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pre_tokens(path).pieces
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces(batch.column(0).to_pylist()), pa.int32())], schema=counted)

    words = texts.select("text").mapInArrow(distinct, "word string, held_by bigint").groupBy("word").agg(F.sum("held_by").alias("held_by"))
    return materialize(words.mapInArrow(count, "word string, held_by bigint, pieces int"), "pre-tokens")


def common_words(words: DataFrame, most: int = COMMON, most_bytes: int = COMMON_BYTES) -> dict[str, int]:
    """Pieces of the pre-tokens that the most documents hold: all above a
    threshold that keeps them within both bounds."""
    level = F.floor(4 * F.log2(F.col("held_by").cast("double"))).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes")).collect()  # at most 4 * 63 rows
    lowest, n, size = None, 0, 0
    for r in sorted(levels, key=lambda r: -r.level):
        n, size = n + r.n, size + r.bytes
        if n > most or size > most_bytes:
            break
        lowest = r.level
    if lowest is None:
        return {}
    rows = words.where(level >= lowest).select("word", "pieces").toArrow()  # within the two bounds
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, common: int = COMMON, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per document."""
    path = path or default_path()
    texts = id_text(docs, id_col, text_col)
    words = pre_token_table(texts, path)
    known = texts.sparkSession.sparkContext.broadcast(common_words(words, common))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()),
                       ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = pre_tokens(path).frequencies, known.value
        for batch in batches:
            n_known, rest, times = [], [], []
            for text in batch.column(1):
                counts, total = cut(text.as_py() or "")
                own: dict[str, int] = {}
                for word, n in counts.items():
                    p = pieces.get(word)
                    if p is None:
                        own[word] = n
                    else:
                        total += n * p
                n_known.append(total)
                rest.append(list(own))
                times.append(list(own.values()))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n_known, pa.int64()), pa.array(rest, arrow.field(3).type),
                                              pa.array(times, arrow.field(4).type)], schema=arrow)

    kinds = "doc_id bigint, n_bytes bigint, n_known bigint, words array<string>, times array<bigint>"
    # written once, so that a row keeps its number whatever is computed again
    rows = materialize(texts.mapInArrow(frequencies, kinds).withColumn("row", F.monotonically_increasing_id()), "pre-token-frequencies")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    joined = rare.join(words.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_rare"))
    n_tokens = F.col("n_known") + F.coalesce(F.col("n_rare"), F.lit(0))
    return rows.select("row", "doc_id", "n_bytes", "n_known").join(joined, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
