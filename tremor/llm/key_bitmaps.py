"""Bitmaps of keys: which rows a join on the key can keep, told from one bit a
row, so that wide rows of no use are not dealt out for the join.

A key's hash is one of ``64 * WORDS`` bits.  A bitmap is a table of at most
``WORDS`` rows, whatever the number of keys, and is broadcast.  Two keys may
share a bit, so what a bitmap lets through is joined on the key itself; where
bits are crowded more rows are dealt, never others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18


def _place(on: list[str]) -> tuple[Column, Column]:
    """Word and bit of a key."""
    h = F.xxhash64(*on)
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))


def bitmaps(keys: DataFrame, on: list[str], **groups: Column) -> DataFrame:
    """(bitmap_word, a bitmap for each group): the bits of the keys for which
    the group's condition holds."""
    word, bit = _place(on)
    return (keys.select(word.alias("bitmap_word"), *[F.when(c, bit).otherwise(F.lit(0).cast("long")).alias(g) for g, c in groups.items()])
            .groupBy("bitmap_word").agg(*[F.bit_or(g).alias(g) for g in groups]))


def sifted(rows: DataFrame, on: list[str], words: DataFrame, **groups: bool) -> DataFrame:
    """The rows whose key has its bit set (True) or not set (False) in the
    bitmaps of the groups named; at least one of them must be True."""
    word, bit = _place(on)
    fit = word == words["bitmap_word"]
    for g, held in groups.items():
        fit &= (words[g].bitwiseAND(bit) != 0) == F.lit(held)
    return rows.join(F.broadcast(words), fit, "left_semi")
