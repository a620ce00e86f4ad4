"""Dollar-neutral rank portfolios and their backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNOVER_COST, SHORT_COST, DAYS_PER_YEAR = 0.0010, 0.0002, 252


def rank_weights(signals: DataFrame, signal: str, by: list[str]) -> DataFrame:
    """Strongest signal gets rank 1; raw = (n+1)/2 - rank; gross scaled to 1.

    The group is one sector on one day, i.e. as large as a sector has stocks.
    """
    w = Window.partitionBy(*by)
    rows = signals.withColumn("rank", F.row_number().over(w.orderBy(F.col(signal).desc(), "ticker")))
    rows = rows.withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("raw", (F.col("n") + 1) / 2.0 - F.col("rank"))
    gross = F.sum(F.abs("raw")).over(w)
    return rows.withColumn("weight", F.coalesce(F.col("raw") / F.nullif(gross, F.lit(0.0)), F.lit(0.0)))


def neutrality_violations(weights: DataFrame, by: list[str], tol: float = 1e-9) -> DataFrame:
    s = weights.groupBy(*by).agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"), F.max("n").alias("n"))
    bad_gross = (F.col("n") > 1) & (F.abs(F.col("gross") - 1) > tol)
    return s.where((F.abs("net") > tol) | bad_gross)


def momentum_signal(features: DataFrame) -> DataFrame:
    """Short over long moving average."""
    return features.withColumn("momentum", F.col("sma_short") / F.nullif(F.col("sma_long"), F.lit(0.0)) - 1)


def random_signal(rows: DataFrame, n_seeds: int = 10) -> DataFrame:
    """``n_seeds`` repeatable random signals per row, from a salted hash."""
    r = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))))
    return r.withColumn("signal", F.sha2(F.concat_ws("|", F.col("ticker"), F.col("date").cast("string"), F.col("seed").cast("string")), 256))


def net_returns(weights: DataFrame, book: list[str], ret: str = "daily_return") -> DataFrame:
    """Row costs: turnover against the weight on the book's previous day, and a
    carry on shorts.

    A stock that the book no longer lists has weight 0: on the first day
    without it a closing row (no return) carries its turnover.  The previous
    day is the book's, so a stock that comes back is bought anew.
    """
    days = weights.select(*book, "date").distinct()
    calendar = Window.partitionBy(*book).orderBy("date")  # one row per day and book
    days = days.withColumn("_day", F.row_number().over(calendar)).withColumn("_next", F.lead("date").over(calendar))
    own = Window.partitionBy(*book, "ticker").orderBy("date")
    rows = weights.join(days, [*book, "date"])
    held = F.lag("_day").over(own) == F.col("_day") - 1
    rows = rows.withColumn("_before", F.when(held, F.lag("weight").over(own)).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_leaves", F.col("_next").isNotNull() & (F.coalesce(F.lead("_day").over(own), F.lit(0)) != F.col("_day") + 1))
    stays = rows.withColumn("turnover", F.abs(F.col("weight") - F.coalesce("_before", F.lit(0.0))))
    closing = rows.where("_leaves").select(*book, "ticker", F.col("_next").alias("date"), F.abs("weight").alias("turnover"),
                                           F.lit(0.0).alias("weight"), F.lit(0.0).alias(ret))
    rows = stays.drop("_day", "_next", "_before", "_leaves").unionByName(closing, allowMissingColumns=True)
    short = F.when(F.col("weight") < 0, F.abs("weight")).otherwise(0.0)
    cost = F.col("turnover") * TURNOVER_COST + short * SHORT_COST
    return rows.withColumn("cost", cost).withColumn("net", F.coalesce(F.col("weight") * F.col(ret), F.lit(0.0)) - F.col("cost"))


def daily_returns(net: DataFrame, book: list[str]) -> DataFrame:
    return net.groupBy(*book, "date").agg(F.sum("net").alias("ret"), F.sum("turnover").alias("turnover"),
                                          F.sum("cost").alias("cost"))


def cumulative(daily: DataFrame, book: list[str]) -> DataFrame:
    """Compounded return; a book that loses everything stays at zero.  One row
    per day and book, so the ordered window is bounded by the calendar."""
    w = Window.partitionBy(*book).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.max((F.col("ret") <= -1).cast("int")).over(w) == 1
    growth = F.product(F.greatest(1 + F.coalesce("ret", F.lit(0.0)), F.lit(0.0))).over(w)
    return daily.withColumn("wealth", F.when(ruined, F.lit(0.0)).otherwise(growth))


def risk(wealth: DataFrame, book: list[str]) -> DataFrame:
    """Sharpe, Sortino, maximum drawdown, cumulative return."""
    w = Window.partitionBy(*book).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("wealth").over(w), F.lit(1.0))
    rows = wealth.withColumn("dd", F.col("wealth") / peak - 1)
    year = F.sqrt(F.lit(float(DAYS_PER_YEAR)))
    down = F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(0.0)))
    return rows.groupBy(*book).agg(
        F.count("*").alias("n_days"),
        (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * year).alias("sharpe"),
        (F.avg("ret") / F.nullif(down, F.lit(0.0)) * year).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
        (F.max_by("wealth", "date") - 1).alias("cumulative_return"))


def sector_table(risk_rows: DataFrame, base: str, variant: str) -> DataFrame:
    """(sector, base_sharpe, variant_sharpe, beats)."""
    s = risk_rows.groupBy("sector").agg(
        F.max(F.when(F.col("variant") == base, F.col("sharpe"))).alias("base_sharpe"),
        F.max(F.when(F.col("variant") == variant, F.col("sharpe"))).alias("variant_sharpe"))
    return s.withColumn("beats", F.coalesce(F.col("variant_sharpe") > F.col("base_sharpe"), F.lit(False)))


def hit_rate(table: DataFrame) -> DataFrame:
    """Hits, number of sectors, and the gate "every sector beats"."""
    return table.agg(F.count_if("beats").alias("hits"), F.count("*").alias("n_sectors"),
                     F.bool_and("beats").alias("shown"))


def fold_summary(risk_rows: DataFrame, base: str, by: list[str] = ()) -> DataFrame:
    """Per ``by`` and variant over folds (a handful of rows): Sharpe mean,
    median, std, and the share of folds in which it beats ``base``."""
    # A window, not a self-join: summed twice, a Sharpe ratio may differ from itself.
    fold = Window.partitionBy(*by, "fold_id")  # one row per variant
    j = risk_rows.withColumn("base_sharpe", F.max(F.when(F.col("variant") == base, F.col("sharpe"))).over(fold))
    return j.groupBy(*by, "variant").agg(
        F.count("*").alias("n_folds"), F.avg("sharpe").alias("mean_sharpe"), F.median("sharpe").alias("median_sharpe"),
        F.stddev_samp("sharpe").alias("std_sharpe"),
        F.avg((F.col("sharpe") > F.col("base_sharpe")).cast("double")).alias("hit_rate"))


def position_counts(weights: DataFrame, by: list[str]) -> DataFrame:
    w: Column = F.col("weight")
    return weights.groupBy(*by).agg(F.count_if(w > 0).alias("n_long"), F.count_if(w < 0).alias("n_short"),
                                    F.count_if(w == 0).alias("n_flat"))
