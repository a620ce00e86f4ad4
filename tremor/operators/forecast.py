"""Return forecaster on look-back windows and its sample-path ensemble."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators import features as FE


def flat_windows(windows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Window structs flattened to one dense vector."""
    flat = F.flatten(F.transform("x", lambda r: F.array(*[r[c].cast("double") for c in cols])))
    return windows.withColumn("xv", array_to_vector(flat))


def fit(windows: DataFrame, cols: Sequence[str], reg: float = 0.01) -> Transformer:
    """One pooled ridge model on the train windows; the ticker is an input."""
    train = flat_windows(windows, cols).where("split = 'train'")
    return Pipeline(stages=[
        StringIndexer(inputCol="ticker", outputCol="_t", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["_t"], outputCols=["_tv"]),
        VectorAssembler(inputCols=["xv", "_tv"], outputCol="_x"),
        LinearRegression(featuresCol="_x", labelCol="y", regParam=reg, solver="normal"),
    ]).fit(train)


def predict(model: Transformer, windows: DataFrame, cols: Sequence[str]) -> DataFrame:
    return model.transform(flat_windows(windows, cols)).select(
        "ticker", "label_date", "split", "y", "y_prior", F.col("prediction").alias("predicted"))


#: steps of a path that share one stretch of residuals
BLOCK = 5


def bootstrap_paths(steps: DataFrame, residuals: DataFrame, n_samples: int = 50, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """``n_samples`` paths per window: the point forecast plus residuals of the
    same ticker.  A path takes them in stretches of ``block`` days in a row (the
    last day is followed by the first), each from a start drawn by hash, so its
    steps are correlated as the residuals are.

    ``steps``: (ticker, window_id, step, predicted), steps from 1 on;
    ``residuals``: (ticker, date, residual), one per day, so numbering them per
    ticker is bounded by the calendar and a draw is an equi-join on (ticker,
    number).
    """
    whole = Window.partitionBy("ticker")
    pool = residuals.select("ticker", "residual", F.row_number().over(whole.orderBy("date")).cast("bigint").alias("i"))
    n = pool.groupBy("ticker").agg(F.count("*").alias("n"))
    draws = steps.join(n, "ticker").withColumn("sample_id", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    stretch, within = F.floor((F.col("step") - 1) / block), (F.col("step") - 1) % block
    key = F.md5(F.concat_ws("|", "ticker", F.col("window_id").cast("string"), stretch.cast("string"), F.col("sample_id").cast("string"), F.lit(str(seed))))
    start = F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint") % F.col("n")
    return (draws.withColumn("i", (start + within) % F.col("n") + 1).join(pool, ["ticker", "i"])
            .select("ticker", "window_id", "step", "sample_id", (F.col("predicted") + F.col("residual")).alias("value")))


# -- paths of several steps ---------------------------------------------------
def sequence_steps(rows: DataFrame, cols: Sequence[str], lookback: int = FE.LOOKBACK, horizon: int = FE.HORIZON,
                   projected: DataFrame | None = None) -> DataFrame:
    """Rows (ticker, label_start, split, feature_end, x, step, target, y,
    projected_score): every label path of ``horizon`` steps with the feature
    matrix of the ``lookback`` rows before it.

    ``projected``: (ticker, as_of, target, score), scores of future days from
    what was known at ``as_of``; joined at as_of = feature_end, so no step sees
    a later event.  Without it, or without a row, the projected score is 0.
    """
    x = FE.lookback_windows(rows, cols, lookback).select("ticker", F.col("label_date").alias("label_start"), "x")
    steps = FE.path_steps(FE.path_windows(rows, lookback, horizon)).join(x, ["ticker", "label_start"])
    return _with_projection(steps, projected)


def future_steps(rows: DataFrame, cols: Sequence[str], lookback: int = FE.LOOKBACK, horizon: int = FE.HORIZON,
                 projected: DataFrame | None = None) -> DataFrame:
    """The same rows for the path after each ticker's last day (no y): targets
    are the next weekdays."""
    w = FE.by_ticker()
    last = rows.withColumn("_after", F.lead("date").over(w)).withColumn(
        "x", F.collect_list(F.struct(*[F.col(c) for c in cols])).over(w.rowsBetween(1 - lookback, 0)))
    last = last.where(F.col("_after").isNull() & (F.size("x") == lookback))
    days = F.filter(F.sequence(F.date_add("date", 1), F.date_add("date", 2 * horizon + 4)), lambda d: F.weekday(d) < 5)
    steps = last.select("ticker", F.col("date").alias("feature_end"), F.col("adj_close").alias("close"), "x",
                        F.posexplode(F.slice(days, 1, horizon)).alias("i", "target")).withColumn("step", F.col("i") + 1).drop("i")
    return _with_projection(steps, projected)


def projection_requests(rows: DataFrame, lookback: int = FE.LOOKBACK, horizon: int = FE.HORIZON) -> DataFrame:
    """(ticker, as_of, target) of every step of every label path, whatever its
    split, and of the path after each ticker's last day."""
    every = FE.path_steps(FE.path_windows(rows.withColumn("split", F.lit("train")), lookback, horizon, strict_tail=False))
    ahead = future_steps(rows, ["adj_close"], lookback, horizon)
    ask = lambda s: s.select("ticker", F.col("feature_end").alias("as_of"), "target")
    return ask(every).unionByName(ask(ahead)).distinct()


def _with_projection(steps: DataFrame, projected: DataFrame | None) -> DataFrame:
    if projected is None:
        return steps.withColumn("projected_score", F.lit(0.0))
    p = projected.select("ticker", F.col("as_of").alias("feature_end"), "target", F.col("score").alias("projected_score"))
    return steps.join(p, ["ticker", "feature_end", "target"], "left").na.fill(0.0, ["projected_score"])


def fit_steps(steps: DataFrame, cols: Sequence[str], reg: float = 0.01) -> Transformer:
    """One pooled ridge model of all tickers and steps on the train paths."""
    train = flat_windows(steps, cols).where("split = 'train'")
    return Pipeline(stages=[
        StringIndexer(inputCol="ticker", outputCol="_t", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["_t", "step"], outputCols=["_tv", "_sv"], handleInvalid="keep"),
        VectorAssembler(inputCols=["xv", "_tv", "_sv", "projected_score"], outputCol="_x"),
        LinearRegression(featuresCol="_x", labelCol="y", regParam=reg, solver="normal"),
    ]).fit(train)


def predict_steps(model: Transformer, steps: DataFrame, cols: Sequence[str]) -> DataFrame:
    keep = [c for c in steps.columns if c != "x"]
    return model.transform(flat_windows(steps, cols)).select(*keep, F.col("prediction").alias("predicted"))


def price_paths(steps: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Return paths as price paths: the close compounded with the predicted
    returns up to each step; the band replaces the step's own return.
    A path is ``horizon`` rows, so its window is short."""
    path = Window.partitionBy("ticker", "feature_end").orderBy("step")
    before = F.coalesce(F.product(1 + F.col("predicted")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    base = F.col("close") * before
    return (steps.withColumn("point_price", base * (1 + F.col("predicted"))).withColumn("lo_price", base * (1 + F.col(lo)))
            .withColumn("hi_price", base * (1 + F.col(hi))))
