"""Daily price bars and checks on rows of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close", "adj_close"]


def bar_problem() -> Column:
    """Reason a bar is rejected, or null."""
    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c)

    any_missing = any_negative = F.lit(False)
    for c in PRICES:
        any_missing = any_missing | missing(c)
        any_negative = any_negative | (F.col(c) < 0)
    return (
        F.when(F.col("ticker").isNull() | (F.col("ticker") == ""), "empty ticker")
        .when(F.col("date").isNull(), "bad date")
        .when(any_missing, "missing price")
        .when(any_negative, "negative price")
        .when(F.col("volume").isNull() | (F.col("volume") < 0), "bad volume")
        .when(~(F.col("open").between(F.col("low"), F.col("high"))
                & F.col("close").between(F.col("low"), F.col("high"))), "inconsistent range")
    )


def checked(bars: DataFrame) -> DataFrame:
    return bars.withColumn("problem", bar_problem())


def scan_bars(bars: DataFrame, order_by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): the first *valid* row of a (ticker, day) is kept; later
    repeats and invalid rows are rejected with a reason.

    A (ticker, day) group is only as large as the feed repeats one bar; the
    first valid row is picked with ``min_by`` so partial aggregation happens
    before the shuffle.
    """
    rows = checked(bars)
    valid = rows.where(F.col("problem").isNull())
    key = F.struct(*order_by)
    payload = F.struct(*[c for c in bars.columns if c not in ("ticker", "date")])
    good = (valid.groupBy("ticker", "date")
            .agg(F.min_by(payload, key).alias("b"), F.count("*").alias("n_rows"))
            .select("ticker", "date", "b.*", "n_rows"))
    invalid = rows.where(F.col("problem").isNotNull()).groupBy("ticker", "problem").count()
    repeats = (good.where("n_rows > 1").groupBy("ticker")
               .agg(F.sum(F.col("n_rows") - 1).alias("count"))
               .select("ticker", F.lit("repeated day").alias("problem"), "count"))
    return good.drop("n_rows"), invalid.unionByName(repeats)


def feature_problem() -> Column:
    """Reason a feature row is rejected, or null."""
    need = ["adj_close", "daily_return", "sma_short", "sma_long", "volatility_10", "score"]
    missing = F.lit(False)
    for c in need:
        missing = missing | F.col(c).isNull() | F.isnan(c)
    return (
        F.when(F.col("ticker").isNull() | F.col("date").isNull(), "bad key")
        .when(missing, "missing value")
        .when(F.col("adj_close") < 0, "negative price")
        .when(F.col("score_source_date").isNull() | (F.col("score_source_date") > F.col("date")), "look-ahead")
        .when(~F.col("split").isin("train", "val", "test"), "bad split")
    )


def latest_bars(bars: DataFrame) -> DataFrame:
    """Newest close per ticker with the close before it: one window over rows
    unique by (ticker, day), so a group is bounded by the calendar."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return (bars.select("ticker", "date", "close", "adj_close",
                        F.lead("close").over(w).alias("prior_close"),
                        F.row_number().over(w).alias("rn"))
            .where("rn = 1").drop("rn"))
