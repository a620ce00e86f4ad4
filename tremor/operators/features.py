"""Features, splits and training windows.

Windows here partition by ticker over rows unique per (ticker, day).  Such a
group is bounded by the calendar (a century is 37k days), however many rows
the event corpus has; scale shows up as more tickers, i.e. more groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMA_SHORT, SMA_LONG, VOL_DAYS = 10, 50, 10
LOOKBACK, HORIZON = 60, 30
TRAIN_FRAC, VAL_FRAC = 0.70, 0.15
INDICATORS = ["daily_return", "sma_short", "sma_long", "volatility_10"]

BASE_COLS = ["daily_return", "price_to_sma_long", "sma_ratio", "volatility_10"]
VARIANTS = {"baseline": BASE_COLS, "with_score": [*BASE_COLS, "score"]}
UNSCALED = ["score"]


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def indicators(bars: DataFrame) -> DataFrame:
    """Causal indicators over the full price history; null until warmed up."""
    w = by_ticker()
    x = F.col("adj_close")
    rows = bars.select("ticker", "date", "adj_close")
    rows = rows.withColumn("daily_return", x / F.nullif(F.lag(x).over(w), F.lit(0.0)) - 1)

    def full(fn: Column, of: str, n: int) -> Column:
        frame = w.rowsBetween(-n + 1, 0)
        return F.when(F.count(of).over(frame) == n, fn.over(frame))

    return (rows.withColumn("sma_short", full(F.avg("adj_close"), "adj_close", SMA_SHORT))
            .withColumn("sma_long", full(F.avg("adj_close"), "adj_close", SMA_LONG))
            .withColumn("volatility_10", full(F.stddev_samp("daily_return"), "daily_return", VOL_DAYS)))


def asof_scores(prices: DataFrame, scores: DataFrame) -> DataFrame:
    """Each price row gets the score of its date, else of the last earlier
    date, with the date that supplied it.  Days before the score history get
    null.  One union and one running ``last``: linear, no range join."""
    left = prices.withColumn("_is_price", F.lit(True))
    right = scores.select("ticker", "date", F.col("score").alias("_s"), F.col("date").alias("_d"))
    both = left.unionByName(right, allowMissingColumns=True)
    # Score rows sort before price rows of the same day, so an exact match is
    # simply the last row seen.
    w = (Window.partitionBy("ticker").orderBy("date", F.col("_is_price").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, 0))
    return (both.withColumn("score", F.last("_s", ignorenulls=True).over(w))
            .withColumn("score_source_date", F.last("_d", ignorenulls=True).over(w))
            .where("_is_price").drop("_s", "_d", "_is_price"))


def join_diagnostics(joined: DataFrame, scores: DataFrame) -> DataFrame:
    """Per ticker: total, in-window, exact, carried-forward, unmatched and
    warm-up-dropped day counts of an as-of join over indicator rows."""
    first = scores.groupBy("ticker").agg(F.min("date").alias("first_score"))
    warm = F.lit(True)
    for c in INDICATORS:
        warm = warm & F.col(c).isNotNull()
    in_window = F.col("date") >= F.col("first_score")
    has = F.col("score").isNotNull()
    return (joined.join(first, "ticker", "left").groupBy("ticker").agg(
        F.count("*").alias("n_total"),
        F.count_if(in_window).alias("n_in_window"),
        F.count_if(has & (F.col("score_source_date") == F.col("date"))).alias("n_exact"),
        F.count_if(has & (F.col("score_source_date") < F.col("date"))).alias("n_carried"),
        F.count_if(in_window & ~has).alias("n_unmatched"),
        F.count_if(has & ~warm).alias("n_warmup_dropped")))


def usable(joined: DataFrame) -> DataFrame:
    return joined.dropna(subset=["score", *INDICATORS])


def assign_splits(rows: DataFrame, train: float = TRAIN_FRAC, val: float = VAL_FRAC) -> DataFrame:
    """Chronological split by row number; sizes round half to even."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    rows = rows.withColumn("rn", F.row_number().over(by_ticker())).withColumn("n", n)
    train_end = F.bround(F.col("n") * F.lit(train), 0)
    val_end = F.least(train_end + F.bround(F.col("n") * F.lit(val), 0), F.col("n").cast("double"))
    return rows.withColumn("split", F.when(F.col("rn") <= F.least(train_end, val_end), "train")
                           .when(F.col("rn") <= val_end, "val").otherwise("test"))


def build_features(bars: DataFrame, scores: DataFrame) -> DataFrame:
    return assign_splits(usable(asof_scores(indicators(bars), scores)))


def split_bounds(features: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    labelable = F.col("rn") > lookback
    return features.groupBy("ticker", "split").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_rows"),
        F.min(F.when(labelable, F.col("date"))).alias("first_usable_label_date"),
        F.count_if(labelable).alias("n_usable_labels"))


def derived_ratios(features: DataFrame) -> DataFrame:
    return (features.withColumn("price_to_sma_long", F.col("adj_close") / F.nullif(F.col("sma_long"), F.lit(0.0)))
            .withColumn("sma_ratio", F.col("sma_short") / F.nullif(F.col("sma_long"), F.lit(0.0))))


# -- scaling (fit on train rows only) ---------------------------------------
def fit_standard(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per ticker mean and population std of the train rows (std 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"{c}__mean"))
        std = F.stddev_pop(c)
        aggs.append(F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"{c}__std"))
    return rows.where("split = 'train'").groupBy("ticker").agg(*aggs)


def apply_standard(rows: DataFrame, fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = rows.join(fit, "ticker")
    for c in cols:
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std"))
    return out


def invert_standard(z: Column, col: str) -> Column:
    return z * F.col(f"{col}__std") + F.col(f"{col}__mean")


def fit_minmax(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs.append(F.min(c).alias(f"{c}__min"))
        rng = F.max(c) - F.min(c)
        aggs.append(F.when(rng == 0, F.lit(1.0)).otherwise(rng).alias(f"{c}__range"))
    return rows.where("split = 'train'").groupBy("ticker").agg(*aggs)


def apply_minmax(rows: DataFrame, fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = rows.join(fit, "ticker")
    for c in cols:
        out = out.withColumn(f"{c}_mm", (F.col(c) - F.col(f"{c}__min")) / F.col(f"{c}__range"))
    return out


def invert_minmax(v: Column, col: str) -> Column:
    return v * F.col(f"{col}__range") + F.col(f"{col}__min")


# -- windows ----------------------------------------------------------------
def lookback_windows(rows: DataFrame, cols: Sequence[str], lookback: int = LOOKBACK,
                     target: str = "daily_return") -> DataFrame:
    """Row i labels the window of rows [i - lookback, i - 1]; the split is the
    label row's.  A frame holds ``lookback`` rows, never the whole group."""
    w = by_ticker()
    frame = w.rowsBetween(-lookback, -1)
    x = F.struct(*[F.col(c) for c in cols])
    out = rows.select(
        "ticker", F.col("date").alias("label_date"), "split",
        F.collect_list(x).over(frame).alias("x"),
        F.min("date").over(frame).alias("feature_start"), F.max("date").over(frame).alias("feature_end"),
        F.lag(target).over(w).alias("y_prior"), F.col(target).alias("y"))
    return out.where((F.size("x") == lookback) & F.col("split").isNotNull())


def path_windows(rows: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON,
                 target: str = "daily_return", strict_tail: bool = True) -> DataFrame:
    """Label paths of ``horizon`` rows from row i on.

    ``strict_tail`` keeps the documented off-by-one: the last complete path is
    not used.  Train (val) paths that end on or after the first val (test)
    date are left out, not relabelled.
    """
    w, whole = by_ticker(), Window.partitionBy("ticker")
    ahead = w.rowsBetween(0, horizon - 1)
    first = lambda s: F.min(F.when(F.col("split") == s, F.col("date"))).over(whole)
    out = rows.select(
        "ticker", "split", F.col("date").alias("label_start"),
        F.max("date").over(ahead).alias("label_end"),
        F.lag("date").over(w).alias("feature_end"), F.lag(target).over(w).alias("y_prior"),
        F.collect_list("date").over(ahead).alias("label_dates"),
        F.collect_list(target).over(ahead).alias("y_path"),
        F.row_number().over(w).alias("pos"), F.count("*").over(whole).alias("total"),
        first("val").alias("val_start"), first("test").alias("test_start"))
    last = F.col("total") - horizon + (0 if strict_tail else 1)
    out = out.where((F.col("pos") > lookback) & (F.col("pos") <= last) & F.col("split").isNotNull())
    crosses = (((F.col("split") == "train") & F.col("val_start").isNotNull() & (F.col("label_end") >= F.col("val_start")))
               | ((F.col("split") == "val") & F.col("test_start").isNotNull() & (F.col("label_end") >= F.col("test_start"))))
    return out.where(~crosses).drop("pos", "total", "val_start", "test_start")


def path_steps(windows: DataFrame) -> DataFrame:
    """Long form: (ticker, label_start, split, y_prior, step, target, y)."""
    z = F.posexplode(F.arrays_zip(F.col("label_dates").alias("d"), F.col("y_path").alias("y")))
    rows = windows.select("ticker", "split", "label_start", "feature_end", "y_prior", z.alias("i", "z"))
    return rows.select("ticker", "split", "label_start", "feature_end", "y_prior",
                       (F.col("i") + 1).alias("step"), F.col("z.d").alias("target"), F.col("z.y").alias("y"))


def prior_returns(rows: DataFrame, value: str = "daily_return") -> DataFrame:
    """(ticker, date, prior): the return of the row before, for the persistence
    baseline."""
    return rows.select("ticker", "date", F.lag(value).over(by_ticker()).alias("prior"))


# -- walk-forward folds -----------------------------------------------------
def walk_forward_folds(label_days: DataFrame, first_day: DataFrame, n_folds: int, test_days: int,
                       val_frac: float = VAL_FRAC) -> DataFrame:
    """Expanding folds over the shared calendar of usable label days.

    K test slices of ``test_days`` days partition the tail; the pool before a
    slice is split so that its trailing ``val_frac`` (rounded half to even)
    validates; train starts at ``first_day``.  ``label_days`` is one row per
    calendar day -- bounded by the calendar, so the single ordered window over
    it is small whatever the data size.
    """
    days = label_days.select("date").distinct()
    one = Window.partitionBy(F.lit(1))
    d = days.select("date", F.row_number().over(one.orderBy("date")).alias("i"), F.count("*").over(one).alias("n"))
    d = d.withColumn("fold_id", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    test_lo = F.col("n") - (F.lit(n_folds) - F.col("fold_id") + 1) * test_days
    d = d.withColumn("pool", test_lo)
    val_n = F.bround(F.col("pool") * F.lit(val_frac), 0)
    split = (F.when(F.col("i") <= F.col("pool") - val_n, "train").when(F.col("i") <= F.col("pool"), "val")
             .when(F.col("i") <= F.col("pool") + test_days, "test"))
    rows = d.withColumn("split", split).where("split is not null")
    b = rows.groupBy("fold_id", "split").agg(F.min("date").alias("s"), F.max("date").alias("end_date"),
                                             F.count("*").alias("n_label_days"))
    start = F.when(F.col("split") == "train", F.least("s", "first_date")).otherwise(F.col("s"))
    # first_day is one row; the equi-join on a constant is a broadcast of it.
    return (b.withColumn("_k", F.lit(1)).join(F.broadcast(first_day.select("first_date", F.lit(1).alias("_k"))), "_k")
            .select("fold_id", "split", start.alias("start_date"), "end_date", "n_label_days"))


def fold_bounds(folds: DataFrame, tickers: DataFrame) -> DataFrame:
    """The same bounds for every ticker: folds are collected into one array per
    run (3 x n_folds entries) and exploded inside each ticker row."""
    packed = folds.groupBy(F.lit(1).alias("_k")).agg(F.collect_list(
        F.struct("fold_id", "split", "start_date", "end_date", "n_label_days")).alias("f"))
    t = tickers.select("ticker").distinct().withColumn("_k", F.lit(1))
    return t.join(F.broadcast(packed), "_k").select("ticker", F.explode("f").alias("f")).select("f.fold_id", "ticker", "f.split", "f.start_date", "f.end_date", "f.n_label_days")


def split_by_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Split label of each row under each fold's bounds (train, val, test in
    that order); rows outside a fold are absent from it."""
    b = bounds.groupBy("fold_id", "ticker").agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c[:2]}")
        for s in ("train", "val", "test") for c in ("start_date", "end_date")])
    j = rows.join(b, "ticker")
    inside = lambda s: F.col("date").between(F.col(f"{s}_st"), F.col(f"{s}_en"))
    return (j.withColumn("split", F.when(inside("train"), "train").when(inside("val"), "val").when(inside("test"), "test"))
            .where("split is not null"))


# -- leakage checks: every one must return no rows --------------------------
def window_leaks(windows: DataFrame, bounds: DataFrame) -> DataFrame:
    own = bounds.select("ticker", "split", F.col("start_date").alias("lo"), F.col("end_date").alias("hi"))
    val = bounds.where("split = 'val'").select("ticker", F.col("start_date").alias("val_start"))
    j = windows.join(own, ["ticker", "split"], "left").join(val, "ticker", "left")
    outside = F.coalesce(~F.col("label_date").between(F.col("lo"), F.col("hi")), F.lit(True))
    reads_on = (F.col("split") == "train") & (F.col("feature_end") >= F.col("val_start"))
    return j.where(outside | reads_on).select("ticker", "split", "label_date", "feature_end")


def path_leaks(windows: DataFrame, bounds: DataFrame) -> DataFrame:
    own = bounds.select("ticker", "split", F.col("start_date").alias("lo"), F.col("end_date").alias("hi"))
    nxt = bounds.groupBy("ticker").agg(
        F.min(F.when(F.col("split") == "val", F.col("start_date"))).alias("val_start"),
        F.min(F.when(F.col("split") == "test", F.col("start_date"))).alias("test_start"))
    j = windows.join(own, ["ticker", "split"], "left").join(nxt, "ticker", "left")
    outside = F.coalesce(~F.col("label_start").between(F.col("lo"), F.col("hi")), F.lit(True))
    train = (F.col("split") == "train") & ((F.col("feature_end") >= F.col("val_start")) | (F.col("label_end") >= F.col("val_start")))
    val = (F.col("split") == "val") & (F.col("label_end") >= F.col("test_start"))
    return j.where(outside | train | val).select("ticker", "split", "label_start", "label_end")


def fold_violations(folds: DataFrame) -> DataFrame:
    """Order within a fold and non-overlap across folds."""
    p = folds.groupBy("fold_id").agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c[:2]}")
        for s in ("train", "val", "test") for c in ("start_date", "end_date")])
    w = Window.partitionBy(F.lit(1)).orderBy("fold_id")  # one row per fold
    p = p.withColumn("prev_end", F.lag("test_en").over(w))
    ok = ((F.col("train_st") <= F.col("train_en")) & (F.col("train_en") < F.col("val_st"))
          & (F.col("val_st") <= F.col("val_en")) & (F.col("val_en") < F.col("test_st"))
          & (F.col("test_st") <= F.col("test_en")))
    after = F.col("prev_end").isNull() | (F.col("test_st") > F.col("prev_end"))
    return p.where(F.coalesce(~(ok & after), F.lit(True))).select("fold_id")


def table_audit(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Duplicate keys, nulls, carried-forward rows and score mismatches."""
    keys = features.groupBy("ticker", "date").agg(
        F.count("*").alias("c"), F.count_if(F.col("score").isNull()).alias("nulls"),
        F.count_if(F.col("score_source_date") != F.col("date")).alias("carried"),
        F.first("score").alias("score"), F.first("score_source_date").alias("src"))
    s = scores.select("ticker", F.col("date").alias("src"), F.col("score").alias("stored"))
    j = keys.join(s, ["ticker", "src"], "left")
    return j.agg(F.count_if(F.col("c") > 1).alias("n_duplicate_keys"),
                 F.sum("nulls").alias("n_null_scores"), F.sum("carried").alias("n_carried"),
                 F.count_if(F.col("stored").isNull() | (F.abs(F.col("stored") - F.col("score")) > 1e-12)).alias("n_score_mismatch"))
