"""Keyword matching on whole texts.

A keyword stands alone when no word character touches it on either side.  Two
ways lead to the same answer: single keywords are tested by an expression, and
many keywords are found by one walk over the text (:mod:`phrases`), after which
testing a list is an overlap of two short arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor.functions.exprs import col, strip

# Letters, digits and underscore of any script, as the word class.
WORD = r"[\p{L}\p{N}_]"


def quote(kw: str) -> str:
    return re.sub(r"([\\.^$|?*+(){}\[\]\-])", r"\\\1", kw)


def _alone(keyword: str) -> str:
    return f"(?<!{WORD}){quote(keyword)}(?!{WORD})"


def _in_text(text: Column, keyword: str) -> Column:
    return text.contains(keyword) & text.rlike(_alone(keyword))


def keyword_hit(lowered: Column | str, keyword: str, found: Column | str | None = None) -> Column:
    """``keyword`` stands alone in an already lower-cased text.  ``found`` is
    the text's ``phrases.found_keywords`` column, if there is one."""
    kw = keyword.lower()
    return _in_text(col(lowered), kw) if found is None else F.array_contains(col(found), kw)


def token_hit(text: Column | str, token: str) -> Column:
    """Case-sensitive whole-token match (bare upper-case country codes)."""
    return _in_text(col(text), token)


def any_hit(lowered: Column | str, keywords: Iterable[str], found: Column | str | None = None) -> Column:
    keywords = [k.lower() for k in keywords]
    if found is not None:
        return F.arrays_overlap(col(found), F.array(*[F.lit(k) for k in keywords]))
    return reduce(lambda a, b: a | b, [keyword_hit(lowered, k) for k in keywords])


def hits(lowered: Column | str, keywords: Iterable[str], found: Column | str | None = None) -> Column:
    """The distinct keywords found, in list order."""
    if found is not None:
        return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.array_contains(col(found), F.lower(k)))
    return F.array_compact(F.array(*[F.when(keyword_hit(lowered, k), F.lit(k)) for k in keywords]))


def tokenize(text: Column | str) -> Column:
    """Lower-cased runs of ``[a-z0-9']``."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9']+)"), F.lit(1))


def combined_text(title: Column | str, text: Column | str) -> Column:
    """Title and text, nulls as empty, trimmed."""
    joined = F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.coalesce(col(text), F.lit("")))
    return strip(joined)
