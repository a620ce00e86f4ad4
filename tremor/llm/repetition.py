"""Quality rules by repetition coverage.

A text's words are numbered; rolling hashes over the numbers (prefix sums of a
polynomial, in numpy) give the key of every n-word window for several n in one
subtraction.  What counts is how many characters lie inside windows, and
inside lines, that have occurred before: the first occurrence is no repetition,
so a heading that returns once at the end of a short text does no harm.

A window of n words can only repeat where its first n-1 words repeat, so each
length looks at the windows left by the one before; most texts end at once.

Defined results: null and empty texts have no words, hence fail the base rule
(fewer than ``min_words``); rows are judged one by one, so repeated rows get
equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import columns, id_text, map_batches

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"
BASE_N = 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Largest share of the word characters inside windows seen before, by
    window length; inside lines seen before; and most symbols per word."""

    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20})
    line_coverage: float = 0.30
    symbols_per_word: float = 0.30
    min_words: int = 50
    max_repeat_percent: int = 50

    @property
    def lengths(self) -> list[int]:
        return sorted(self.coverage)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads small integers over 64 bits."""
    x = (x + np.uint64(1)) * MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur at least twice, and which of those are not the first."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    hit = later.copy()
    hit[order[:-1][same]] = True
    return hit, later


def _covered(starts: np.ndarray, n: int, weights: np.ndarray) -> int:
    """Weight of the words in any window [start, start + n)."""
    delta = np.zeros(len(weights) + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + n, -1)
    return int(weights[np.cumsum(delta[:-1]) > 0].sum())


def _numbers(words: list[str]) -> np.ndarray:
    ids: dict[str, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))


def _exact_keys(ids: np.ndarray) -> np.ndarray:
    """Keys of the 3-word windows without any chance of a clash."""
    pair = ids[:-1] * (ids.max() + 1) + ids[1:]
    if ids.max() >= 1 << 20:  # a third factor would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    return pair[:-1] * (ids.max() + 1) + ids[2:]


def measure(text: str | None, lengths: list[int]) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    dup_line_chars, then the characters covered for each length."""
    text = text or ""
    words = _WORDS(text)
    n = len(words)
    chars = np.fromiter(map(len, words), dtype=np.int64, count=n)
    seen: set[str] = set()
    dup_lines, dup_line_chars = 0, 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(map(len, _WORDS(line)))
        elif _WORDS(line):
            seen.add(line)
    out = [n, int(chars.sum()), sum(map(text.count, SYMBOLS)), dup_lines, 0, dup_line_chars] + [0] * len(lengths)
    if n <= BASE_N:
        return out
    ids = _numbers(words)
    starts = np.flatnonzero(_repeated(_exact_keys(ids))[0])
    if not len(starts):
        return out
    out[4] = _covered(starts, BASE_N, np.ones(n, dtype=np.int64))
    # rolling hash: window key = (prefix[i + n] - prefix[i] * base^n), mod 2^64
    with np.errstate(over="ignore"):
        base = MULTIPLIER | np.uint64(1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, dtype=np.uint64)]))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mix(ids.astype(np.uint64)) * powers[:n])])
        unshift = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]))
        for k, length in enumerate(lengths):
            starts = starts[starts + length <= n]
            hit, later = _repeated((prefix[starts + length] - prefix[starts]) * unshift[starts])
            if not hit.any():
                break
            out[6 + k] = _covered(starts[later], length, chars)
            starts = starts[hit]
    return out


def verdict(m: list[int], rules: Rules) -> tuple[bool, bool]:
    """(base_failed, kept) of one text's measures."""
    n_words, word_chars, n_symbols, _, n_repeat, line_chars = m[:6]
    failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not failed and line_chars <= rules.line_coverage * word_chars and n_symbols <= rules.symbols_per_word * n_words
    return failed, kept and all(c <= rules.coverage[n] * word_chars for n, c in zip(rules.lengths, m[6:]))


def repetition_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its measures and verdict."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    names += [f"dup_chars_{n}" for n in rules.lengths]

    def judge(batch):
        rows = [measure(t, rules.lengths) for t in batch.column(1).to_pylist()]
        verdicts = [verdict(m, rules) for m in rows]
        return {"doc_id": batch.column(0), **{c: [m[i] for m in rows] for i, c in enumerate(names)},
                "base_failed": [v[0] for v in verdicts], "kept": [v[1] for v in verdicts]}

    schema = "doc_id bigint," + ",".join(f"{c} bigint" for c in names) + ",base_failed boolean,kept boolean"
    return map_batches(id_text(docs, id_col, text_col), judge, schema)


def keeps(text: Column, rules: Rules = Rules()) -> Column:
    """The verdict as a column, to filter documents with all their columns."""

    @F.pandas_udf("boolean")
    def run(texts):
        return texts.map(lambda t: verdict(measure(t, rules.lengths), rules)[1]).astype(bool)

    return run(text)


def filter_repetition(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that pass, every column kept."""
    return docs.filter(keeps(F.col(text_col), rules)).select(columns(docs))
