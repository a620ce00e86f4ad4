"""Features, windows, folds and their checks."""

from pyspark.sql import functions as F

from tremor.operators import features as FE
from tremor.operators import views as V
from tremor.plans.registry import query
from tremor.sources import bars as B

COLS = FE.VARIANTS["with_score"]


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query("A17_join_diagnostics", """SELECT ticker, count(*) AS n_total, count(*) FILTER (date >= f) AS n_in_window, count(*) FILTER (score_source_date = date) AS n_exact,
    count(*) FILTER (score_source_date < date) AS n_carried, count(*) FILTER (date >= f AND score IS NULL) AS n_unmatched,
    count(*) FILTER (score IS NOT NULL AND (daily_return IS NULL OR sma_short IS NULL OR sma_long IS NULL OR volatility_10 IS NULL)) AS n_warmup_dropped
    FROM jnd LEFT JOIN (SELECT ticker, min(date) AS f FROM sco GROUP BY ticker) USING (ticker) GROUP BY ticker""")
def a17(f):
    return FE.join_diagnostics(f.joined, f.score_days)


@query("V1_daily_return", "SELECT ticker, date, round(daily_return, 6) AS daily_return FROM ret")
def v1(f):
    return FE.indicators(f.bars).select("ticker", "date", r6("daily_return"))


@query("V2_moving_averages", "SELECT ticker, date, round(sma_short, 5) AS sma_short, round(sma_long, 5) AS sma_long FROM ind")
def v2(f):
    return FE.indicators(f.bars).select("ticker", "date", F.round("sma_short", 5).alias("sma_short"), F.round("sma_long", 5).alias("sma_long"))


@query("V3_volatility", "SELECT ticker, date, round(volatility_10, 6) AS volatility_10 FROM ind")
def v3(f):
    return FE.indicators(f.bars).select("ticker", "date", r6("volatility_10"))


@query("V4_usable_rows", "SELECT ticker, date, score_source_date FROM ftr")
def v4(f):
    return FE.usable(f.joined).select("ticker", "date", "score_source_date")


@query("V5_chronological_split", "SELECT ticker, date, split FROM ftr")
def v5(f):
    return f.features.select("ticker", "date", "split")


@query("V6_split_bounds", "SELECT * FROM bnd")
def v6(f):
    return FE.split_bounds(f.features)


@query("V7_lookback_windows", """SELECT ticker, date AS label_date, split, round(daily_return, 6) AS y, round(lag(daily_return) OVER w, 6) AS y_prior,
    lag(date, 60) OVER w AS feature_start, lag(date) OVER w AS feature_end, round(sum(score) OVER f, 6) AS score_sum, round(sum(volatility_10) OVER f, 6) AS vol_sum
    FROM ftr WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) QUALIFY rn > 60""")
def v7(f):
    w = FE.lookback_windows(FE.derived_ratios(f.features), COLS)
    total = lambda c: F.round(F.aggregate(F.transform("x", lambda r: r[c]), F.lit(0.0), lambda a, v: a + v), 6)
    return w.select("ticker", "label_date", "split", r6("y"), r6("y_prior"), "feature_start", "feature_end",
                    total("score").alias("score_sum"), total("volatility_10").alias("vol_sum"))


PATHW = {"vts": "SELECT ticker, min(date) FILTER (split = 'val') AS vs, min(date) FILTER (split = 'test') AS ts FROM ftr GROUP BY ticker",
         "pw0": """SELECT ticker, date AS label_start, split, rn, n, lead(date, 29) OVER w AS label_end, lag(date) OVER w AS feature_end,
    lag(daily_return) OVER w AS y_prior, sum(daily_return) OVER f AS y_sum FROM ftr
    WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)""",
         "pw": "SELECT * FROM pw0 JOIN vts USING (ticker) WHERE rn > 60 AND rn <= n - 30 AND NOT (split = 'train' AND label_end >= vs) AND NOT (split = 'val' AND label_end >= ts)"}


@query("V8_path_windows", "SELECT ticker, label_start, label_end, feature_end, split, round(y_sum, 6) AS y_sum, round(y_prior, 6) AS y_prior FROM pw", **PATHW)
def v8(f):
    p = FE.path_windows(f.features)
    return p.select("ticker", "label_start", "label_end", "feature_end", "split",
                    F.round(F.aggregate("y_path", F.lit(0.0), lambda a, v: a + v), 6).alias("y_sum"), r6("y_prior"))


@query("V9_boundary_exclusion", "SELECT ticker, split, count(*) AS n_windows, max(label_end) AS last_label FROM pw GROUP BY ticker, split", **PATHW)
def v9(f):
    return FE.path_windows(f.features).groupBy("ticker", "split").agg(F.count("*").alias("n_windows"), F.max("label_end").alias("last_label"))


ZFIT = {"zfit": "SELECT ticker, avg(daily_return) AS m, CASE WHEN stddev_pop(daily_return) = 0 THEN 1 ELSE stddev_pop(daily_return) END AS s, min(daily_return) AS lo, CASE WHEN max(daily_return) = min(daily_return) THEN 1 ELSE max(daily_return) - min(daily_return) END AS rng FROM ftr WHERE split = 'train' GROUP BY ticker"}


@query("V10_standard_scaling", "SELECT ticker, date, round((daily_return - m) / s, 5) AS z, round(score, 9) AS score FROM ftr JOIN zfit USING (ticker)", **ZFIT)
def v10(f):
    z = FE.apply_standard(f.features, FE.fit_standard(f.features, ["daily_return"]), ["daily_return"])
    return z.select("ticker", "date", F.round("daily_return_z", 5).alias("z"), F.round("score", 9).alias("score"))


@query("V11_minmax_scaling", "SELECT ticker, date, round((daily_return - lo) / rng, 6) AS v FROM ftr JOIN zfit USING (ticker)", **ZFIT)
def v11(f):
    z = FE.apply_minmax(f.features, FE.fit_minmax(f.features, ["daily_return"]), ["daily_return"])
    return z.select("ticker", "date", r6("daily_return_mm", "v"))


@query("V12_inverse_scaling", "SELECT ticker, date, round(0.5e0 * s + m, 6) AS std_back, round(0.5e0 * rng + lo, 6) AS mm_back FROM ftr JOIN zfit USING (ticker) WHERE split = 'test'", **ZFIT)
def v12(f):
    t = f.features.where("split = 'test'").select("ticker", "date")
    t = t.join(FE.fit_standard(f.features, ["daily_return"]), "ticker").join(FE.fit_minmax(f.features, ["daily_return"]), "ticker")
    return t.select("ticker", "date", F.round(FE.invert_standard(F.lit(0.5), "daily_return"), 6).alias("std_back"),
                    F.round(FE.invert_minmax(F.lit(0.5), "daily_return"), 6).alias("mm_back"))


@query("V13_latest_close", "SELECT ticker, date, close, adj_close, lag_close AS prior_close FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS lag_close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars) WHERE r = 1")
def v13(f):
    return B.latest_bars(f.bars)


@query("V14_last_points", "SELECT ticker, date, adj_close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30")
def v14(f):
    return V.last_points(f.bars, 30).select("ticker", "date", "adj_close")


FOLDS = {"lday": "SELECT DISTINCT date FROM ftr WHERE rn > 60",
         "lnum": "SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM lday",
         "fday": "SELECT date, i, CAST(k AS INTEGER) AS fold_id, n - (4 - k + 1) * 100 AS pool FROM lnum CROSS JOIN range(1, 5) t(k)",
         "fspl": "SELECT *, CASE WHEN i <= pool - round_even(pool * 0.15e0, 0) THEN 'train' WHEN i <= pool THEN 'val' WHEN i <= pool + 100 THEN 'test' END AS split FROM fday",
         "fold": "SELECT fold_id, split, CASE WHEN split = 'train' THEN least(min(date), (SELECT min(date) FROM ftr)) ELSE min(date) END AS start_date, max(date) AS end_date, count(*) AS n_label_days FROM fspl WHERE split IS NOT NULL GROUP BY fold_id, split"}


def folds(f):
    days = f.features.where(F.col("rn") > FE.LOOKBACK).select("date")
    first = f.features.agg(F.min("date").alias("first_date"))
    return FE.walk_forward_folds(days, first, 4, 100)


@query("V15_walk_forward_folds", "SELECT * FROM fold", **FOLDS)
def v15(f):
    return folds(f)


@query("V16_fold_bounds", "SELECT fold_id, ticker, split, start_date, end_date, n_label_days FROM fold CROSS JOIN stk", **FOLDS)
def v16(f):
    return FE.fold_bounds(folds(f), f.stocks)


@query("F20_split_by_fold", "SELECT b.fold_id, b.split, count(*) AS n_rows FROM ftr r JOIN fold b ON r.date BETWEEN b.start_date AND b.end_date GROUP BY ALL", **FOLDS)
def f20b(f):
    rows = f.features.drop("split").select("ticker", "date")
    return FE.split_by_bounds(rows, FE.fold_bounds(folds(f), f.stocks)).groupBy("fold_id", "split").agg(F.count("*").alias("n_rows"))


@query("J16_prior_return", "SELECT ticker, date, round(lag(daily_return) OVER (PARTITION BY ticker ORDER BY date), 6) AS prior FROM ftr")
def j16(f):
    return FE.prior_returns(f.features).withColumn("prior", F.round("prior", 6))


@query("J17_bounds_join_windows", "SELECT ticker, split, count(*) AS n_windows, min(date) AS first_label, max(date) AS last_label, bool_and(date BETWEEN start_date AND end_date) AS inside FROM (SELECT ticker, split, date FROM ftr WHERE rn > 60) JOIN bnd USING (ticker, split) GROUP BY ticker, split")
def j17(f):
    w = FE.lookback_windows(FE.derived_ratios(f.features), COLS).select("ticker", "split", "label_date")
    j = w.join(FE.split_bounds(f.features), ["ticker", "split"])
    return j.groupBy("ticker", "split").agg(F.count("*").alias("n_windows"), F.min("label_date").alias("first_label"), F.max("label_date").alias("last_label"),
                                            F.bool_and(F.col("label_date").between(F.col("start_date"), F.col("end_date"))).alias("inside"))


@query("E13_window_leakage", "SELECT ticker, split, date AS label_date, date AS feature_end FROM ftr WHERE false")
def e13(f):
    w = FE.lookback_windows(FE.derived_ratios(f.features), COLS)
    return FE.window_leaks(w, FE.split_bounds(f.features))


@query("E13_leakage_found", "SELECT ticker, split, count(*) AS n FROM (SELECT f.ticker, f.split, f.date, lag(f.date) OVER (PARTITION BY f.ticker ORDER BY f.date) AS fe, f.rn, b.start_date + 30 AS lo, b.end_date AS hi, v.start_date + 30 AS vs FROM ftr f JOIN bnd b USING (ticker, split) JOIN bnd v ON v.ticker = f.ticker AND v.split = 'val') WHERE rn > 60 AND (NOT date BETWEEN lo AND hi OR (split = 'train' AND fe >= vs)) GROUP BY ALL")
def e13b(f):
    """The same check against bounds moved by 30 days must report rows."""
    moved = FE.split_bounds(f.features).select("ticker", "split", F.date_add("start_date", 30).alias("start_date"), "end_date")
    w = FE.lookback_windows(FE.derived_ratios(f.features), COLS)
    leaks = FE.window_leaks(w, moved)
    return leaks.groupBy("ticker", "split").agg(F.count("*").alias("n"))


@query("E14_path_leakage", "SELECT ticker, split, label_start, label_end FROM pw WHERE false", **PATHW)
def e14(f):
    return FE.path_leaks(FE.path_windows(f.features), FE.split_bounds(f.features))


@query("E14_leakage_found", """SELECT p.ticker, p.split, count(*) AS n FROM pw p JOIN bnd b ON b.ticker = p.ticker AND b.split = p.split
    JOIN (SELECT ticker, max(start_date) FILTER (split = 'val') + 30 AS v30, max(start_date) FILTER (split = 'test') + 30 AS t30 FROM bnd GROUP BY ticker) v ON v.ticker = p.ticker
    WHERE NOT label_start BETWEEN b.start_date + 30 AND b.end_date OR (p.split = 'train' AND (feature_end >= v30 OR label_end >= v30)) OR (p.split = 'val' AND label_end >= t30)
    GROUP BY p.ticker, p.split""", **PATHW)
def e14b(f):
    """Bounds moved by 30 days must report rows."""
    moved = FE.split_bounds(f.features).select("ticker", "split", F.date_add("start_date", 30).alias("start_date"), "end_date")
    return FE.path_leaks(FE.path_windows(f.features), moved).groupBy("ticker", "split").agg(F.count("*").alias("n"))


@query("E15_violations_found", "SELECT fold_id FROM (SELECT fold_id, start_date, lag(end_date + 100) OVER (ORDER BY fold_id) AS before FROM fold WHERE split = 'test') WHERE start_date <= before", **FOLDS)
def e15b(f):
    """Test slices drawn out by 100 days overlap the next ones."""
    late = F.when(F.col("split") == "test", F.date_add("end_date", 100)).otherwise(F.col("end_date"))
    return FE.fold_violations(folds(f).withColumn("end_date", late))


@query("E15_fold_violations", "SELECT fold_id FROM fold WHERE false", **FOLDS)
def e15(f):
    return FE.fold_violations(folds(f))


@query("E16_feature_checks", """SELECT ticker, date, CASE WHEN day(date) = 1 THEN 'missing value' WHEN day(date) = 2 THEN 'negative price' WHEN day(date) = 3 THEN 'look-ahead' WHEN day(date) = 4 THEN 'bad split' END AS problem FROM ftr""")
def e16(f):
    d = F.dayofmonth("date")
    r = (f.features.withColumn("sma_long", F.when(d != 1, F.col("sma_long"))).withColumn("adj_close", F.when(d == 2, F.lit(-1.0)).otherwise(F.col("adj_close")))
         .withColumn("score_source_date", F.when(d == 3, F.date_add("date", 1)).otherwise(F.col("score_source_date")))
         .withColumn("split", F.when(d == 4, "holdout").otherwise(F.col("split"))))
    return r.select("ticker", "date", B.feature_problem().alias("problem"))


@query("E17_bar_checks", """SELECT ticker, date, CASE WHEN day(date) = 1 THEN 'missing price' WHEN day(date) = 2 THEN 'negative price' WHEN day(date) = 3 THEN 'bad volume' WHEN day(date) = 4 THEN 'inconsistent range' END AS problem FROM bars""")
def e17(f):
    d = F.dayofmonth("date")
    r = (f.bars.withColumn("close", F.when(d != 1, F.col("close"))).withColumn("adj_close", F.when(d == 2, F.lit(-5.0)).otherwise(F.col("adj_close")))
         .withColumn("volume", F.when(d == 3, F.lit(-1)).otherwise(F.col("volume"))).withColumn("low", F.when(d == 4, F.col("high") + 1).otherwise(F.col("low"))))
    return r.select("ticker", "date", B.bar_problem().alias("problem"))


@query("E20_table_audit", """SELECT (SELECT count(*) FROM (SELECT 1 FROM ftr GROUP BY ticker, date HAVING count(*) > 1)) AS n_duplicate_keys, CAST(count(*) FILTER (score IS NULL) AS BIGINT) AS n_null_scores,
    CAST(count(*) FILTER (score_source_date <> date) AS BIGINT) AS n_carried, CAST(0 AS BIGINT) AS n_score_mismatch FROM ftr""")
def e20(f):
    return FE.table_audit(f.features, f.score_days)

