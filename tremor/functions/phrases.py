"""Many keywords in one walk over a text.

An automaton of all keywords is walked once per text and reports every
occurrence, overlapping ones and ones inside others too.  An occurrence counts
if it stands alone: no letter, digit or underscore of any script touches it.
The cost follows the length of the text, not the number of keywords; the rest
of a labeller works on the short array of keywords found.

Texts travel to the walk in Arrow batches.  The automaton is built once per
Python worker and list of keywords; it is bounded by the keywords, never by the
texts.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor.functions.exprs import col

_BUILT: dict[tuple[str, ...], object] = {}


def automaton(keywords: tuple[str, ...]):
    if keywords not in _BUILT:
        import ahocorasick

        walk = ahocorasick.Automaton()
        for i, k in enumerate(keywords):
            if k:
                walk.add_word(k, (i, len(k)))
        walk.make_automaton()
        _BUILT[keywords] = walk
    return _BUILT[keywords]


def _touches(char: str) -> bool:
    return char.isalnum() or char == "_"


def standing_alone(text: str, keywords: tuple[str, ...]) -> list[str]:
    """The keywords of the tuple that stand alone in the text, in its order."""
    walk = automaton(keywords)
    if not len(walk):
        return []
    found: set[int] = set()
    last = len(text) - 1
    for end, (i, length) in walk.iter(text):
        if i in found:
            continue
        start = end - length
        if (start < 0 or not _touches(text[start])) and (end == last or not _touches(text[end + 1])):
            found.add(i)
    return [keywords[i] for i in sorted(found)]


def found_keywords(text: Column | str, keywords: Iterable[str]) -> Column:
    """The distinct keywords, lower-cased, that stand alone in the lower-cased
    text, in alphabetical order; none for a null text."""
    lists = tuple(sorted({k.lower() for k in keywords}))

    @F.arrow_udf(returnType="array<string>")
    def walk(texts: pa.Array) -> pa.Array:
        return pa.array([standing_alone(t.as_py().lower(), lists) if t.is_valid else [] for t in texts], pa.list_(pa.string()))

    return walk(col(text))
