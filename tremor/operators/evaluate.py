"""Forecast metrics, conformal calibration, classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import exprs as X
from tremor.operators import ranks

LO_PCT, HI_PCT, ALPHA = 0.05, 0.95, 0.10
INF = float("inf")


# -- regression metrics -----------------------------------------------------
def metric_columns(y: Column | str, p: Column | str) -> list[Column]:
    """MAE, RMSE, MAPE; division by zero follows IEEE (x/0 inf, 0/0 nan)."""
    t = X.col(y)
    err = t - X.col(p)
    pct = (F.when(t != 0, F.abs(err / F.nullif(t, F.lit(0.0))))
           .when(err == 0, F.lit(float("nan"))).otherwise(F.lit(INF)))
    return [F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"), (F.avg(pct) * 100.0).alias("mape")]


def metrics(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(y, p))


def averaged_metrics(per_ticker: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean over tickers; counts add up."""
    return per_ticker.groupBy(*by).agg(F.sum("n").alias("n"), F.avg("mae").alias("mae"),
                                       F.avg("rmse").alias("rmse"), F.avg("mape").alias("mape"))


def baselines(df: DataFrame, y: str, prior: str, by: list[str]) -> DataFrame:
    """Predict zero; predict the previous value: both in one pass."""
    rules = F.explode(F.array(F.struct(F.lit("zero").alias("rule"), F.lit(0.0).alias("p")),
                              F.struct(F.lit("prior").alias("rule"), F.col(prior).alias("p"))))
    long = df.select(*by, F.col(y).alias("_y"), rules.alias("r")).select(*by, "_y", "r.rule", "r.p")
    return metrics(long, "_y", "p", [*by, "rule"])


def step_metrics(steps: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Per horizon step, plus all steps pooled (step null), in one pass."""
    sets = [[*by, "step"], by]
    return steps.groupingSets(sets, *by, "step").agg(*metric_columns(y, p))


def directional_accuracy(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    same = F.signum(F.col(y)) == F.signum(F.col(p))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("directional_accuracy"))


# -- conformal bands --------------------------------------------------------
def band_quantiles(samples: DataFrame, keys: list[str], lo: float = LO_PCT, hi: float = HI_PCT) -> DataFrame:
    """Linear quantiles of the sample paths.  The group is one window and step,
    so it holds as many rows as the ensemble has members (tens)."""
    q = F.percentile("value", F.array(F.lit(lo), F.lit(hi)))
    return samples.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def nonconformity(bands: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    return bands.join(actuals, keys).withColumn(
        "s", F.greatest(F.col("lo") - F.col("actual"), F.col("actual") - F.col("hi")))


def fit_calibration(scores: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """Per step the ceil((n+1)(1-alpha))-th smallest score; +inf if n is too
    small.  Steps are few and each holds every window, so the order statistic
    is found without sorting a step in one task."""
    level = F.ceil((F.col("n") + 1) * F.lit(1 - alpha))
    q = ranks.order_statistic(scores, by, "s", level, out="q_hat")
    return q.select(*by, F.col("n").alias("n_cal"),
                    F.coalesce("q_hat", F.lit(INF)).alias("q_hat"))


def apply_calibration(bands: DataFrame, calibration: DataFrame, by: list[str]) -> DataFrame:
    c = calibration.select(*by, "q_hat")
    return (bands.join(c, by).withColumn("lo_cal", F.col("lo") - F.col("q_hat"))
            .withColumn("hi_cal", F.col("hi") + F.col("q_hat")))


def coverage(bands: DataFrame, by: list[str]) -> DataFrame:
    inside = lambda lo, hi: F.avg(F.col("actual").between(F.col(lo), F.col(hi)).cast("double")) * 100.0
    return bands.groupBy(*by).agg(F.count("*").alias("n"), inside("lo", "hi").alias("raw_pct"),
                                  inside("lo_cal", "hi_cal").alias("calibrated_pct"))


def coverage_summary(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg(*[
        fn(c).alias(f"{c}_{name}") for c in ("raw_pct", "calibrated_pct")
        for name, fn in (("mean", F.avg), ("min", F.min), ("max", F.max))])


# -- classification metrics -------------------------------------------------
def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(gold, pred, n): all later work is on classes squared rows."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, classes: DataFrame) -> DataFrame:
    """Support, precision, recall, F1 (0 when undefined, 4 decimals)."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    g = conf.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    p = conf.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    t = classes.select("label").join(g, "label", "left").join(p, "label", "left").na.fill(0)
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.nullif(F.col("predicted"), F.lit(0))).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.nullif(F.col("support"), F.lit(0))).otherwise(0.0)
    t = t.withColumn("p_", precision).withColumn("r_", recall)
    f1 = F.when(F.col("p_") + F.col("r_") > 0,
                2 * F.col("p_") * F.col("r_") / F.nullif(F.col("p_") + F.col("r_"), F.lit(0.0))).otherwise(0.0)
    return t.select("label", "support", F.round("p_", 4).alias("precision"),
                    F.round("r_", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def macro_f1(table: DataFrame) -> DataFrame:
    """Mean of the rounded F1 over classes with support; 0 if there is none."""
    return table.agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def accuracy(conf: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    return conf.agg((right / F.nullif(F.sum("n"), F.lit(0))).alias("accuracy"), F.sum("n").alias("n"))


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """Most frequent label (ties: the smaller label); one row."""
    counts = train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"))


def pool_folds(scores: DataFrame, folds: list[int]) -> DataFrame:
    """Scores of several folds as one pool.  Folds are disjoint rows of one long
    table, so this is a filter and never a union of runs."""
    return scores.where(F.col("fold_id").isin(folds))
