"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words per document.  The sources share the sum of all sizes by
weight; a target stops at ``cap`` times its source's size and the excess goes
to the others by weight.  That is water filling: with the sources ordered by
``cap * size / weight``, the first k full ones leave the level
``(total - their caps) / (the other weights)``, and the level that no open
source exceeds is the answer.  The windows for it run over one row per source.

A document is emitted floor(rate) times, rate = target / source size, plus
once more with probability equal to the fraction: a uniform number from the
MD5 of a seed, the document's id and its text lies below it.  Each source
tries ``SEEDS`` seeds in one aggregate and takes the one whose words come
nearest to its target, so the words taken are close even in a small source.

Only sums per source are shuffled, partially summed in each task, so a hot
source costs one row per task.  Texts are never shuffled.

Defined results: null and empty texts have size 0 and are emitted as often as
their number says (they add no words); the null source is a source, last in
order; equal rows draw the same number; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import WORD, columns, fresh, quoted
from tremor.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 16
_SPAN = 1 << 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(id_: Column, text: Column) -> Column:
    """``SEEDS`` numbers in [0, 1), fixed by the id and the text."""
    own = F.concat(F.lit(":"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    one = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(str(s)), own)), 1, 13), 16, 10).cast("long") / F.lit(_SPAN)
    return F.array(*[one(s) for s in range(SEEDS)])


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    w = by_source.withColumn("w", weight.cast("double"))
    total = F.sum("source_size").over(Window.partitionBy())
    fill = Window.orderBy(F.col("source_size") * cap / F.col("w"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = (w.withColumn("limit", (F.col("source_size") * cap).cast("double"))
         .withColumn("left", total - F.coalesce(F.sum("limit").over(upto), F.lit(0.0)))
         .withColumn("open", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    # the level with this source and all after it open; a source below its own level is full,
    # and past the first open source the level only falls
    w = w.withColumn("level", F.col("left") / F.col("open"))
    level = F.max(F.when(F.col("limit") >= F.col("level") * F.col("w"), F.col("level"))).over(Window.partitionBy())
    target = F.least("limit", F.col("w") * level)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(1.0))
    return w.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _plan(sizes: DataFrame, weights, cap: int) -> DataFrame:
    """(source, source_size, target, rate, seed): one row per source."""
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets")
    whole, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    tried = [F.sum(F.col("size") * (whole + (F.col("draws")[s] < part).cast("long"))).alias(f"t{s}") for s in range(SEEDS)]
    got = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).groupBy(
        targets["source"].alias("source")).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                                             F.first("rate").alias("rate"), *tried)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{s}") - F.col("target")).alias("off"), F.lit(s).alias("s")) for s in range(SEEDS)]))
    return materialize(got.select("source", "source_size", "target", "rate", best["s"].alias("seed")), "mix-plan")


def _copies(rate: Column, seed: Column, draws_: Column) -> Column:
    return (F.floor(rate) + (F.element_at(draws_, seed + 1) < rate - F.floor(rate)).cast("long")).cast("long")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       n_words(text).alias("size"), draws(F.col(id_col).cast("long"), text).alias("draws"))


def mixed_counts(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row per document."""
    sizes = materialize(_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    plan = _plan(sizes, weights, cap)
    copies = _copies(F.col("rate"), F.col("seed"), F.col("draws"))
    return sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).select(
        "doc_id", sizes["source"], "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The mixture: every document as often as it is taken, every column kept."""
    plan = _plan(materialize(_sizes(docs, id_col, text_col, source_col), "mix-sizes"), weights, cap)
    names = {c: fresh(docs, "mix_" + c) for c in ("source", "rate", "seed")}
    plan = plan.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = docs.join(plan, F.col(quoted(source_col)).cast("string").eqNullSafe(F.col(names["source"])))
    drawn = draws(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    times = F.array_repeat(F.lit(0), _copies(F.col(names["rate"]), F.col(names["seed"]), drawn).cast("int"))
    return joined.select(*columns(docs), F.explode(times).alias(fresh(docs, "mix_copy"))).select(columns(docs))
