"""Metrics, calibration, classifier evaluation and portfolios."""

from pyspark.sql import functions as F

from tremor import dims
from tremor.functions import exprs as X
from tremor.operators import corpus as C
from tremor.operators import evaluate as E
from tremor.operators import features as FE
from tremor.operators import forecast as FC
from tremor.operators import labels as L
from tremor.operators import portfolio as PF
from tremor.operators import scoring as SC
from tremor.plans import fixtures as FX
from tremor.plans.q_features import PATHW
from tremor.plans.q_scoring import PROJ, projected, requests
from tremor.plans.q_scalars import _TYPE as TYPE_SQL
from tremor.plans.q_scalars import TEXT
from tremor.plans.q_scalars import _low as low_docs
from tremor.plans.registry import query
from tremor.session import materialize

KEYS = ["ticker", "window_id", "step", "fold_id"]
M = """count(*) AS n, round(avg(abs({y} - {p})), 6) AS mae, round(sqrt(avg(({y} - {p}) ^ 2)), 6) AS rmse,
    round(avg(CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) WHEN {p} = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END) * 100, 4) AS mape"""


def m(y, p):
    return M.format(y=y, p=p)


def rounded(df, keys):
    return df.select(*keys, "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("mape", 4).alias("mape"))


@query("E1_regression_metrics", f"SELECT ticker, variant, {m('actual', 'predicted')} FROM prd WHERE split = 'test' GROUP BY ticker, variant")
def e1(f):
    return rounded(E.metrics(f.predictions.where("split = 'test'"), "actual", "predicted", ["ticker", "variant"]), ["ticker", "variant"])


@query("E1_metrics_zero_actual", f"SELECT grp, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, CAST(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) WHEN p = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END) * 100 AS VARCHAR) IN ('inf', 'nan') AS not_finite FROM (SELECT eid % 4 AS grp, CASE WHEN eid % 4 > 1 THEN 0e0 ELSE 1e0 + k0 END AS y, CASE WHEN eid % 4 = 3 THEN 0e0 ELSE k0 * 1e0 END AS p FROM ev) GROUP BY grp")
def e1b(f):
    g = F.col("eid") % 4
    r = f.events.select(g.alias("grp"), F.when(g > 1, F.lit(0.0)).otherwise(F.col("k0") + F.lit(1.0)).alias("y"),
                        F.when(g == 3, F.lit(0.0)).otherwise(F.col("k0").cast("double")).alias("p"))
    t = E.metrics(r, "y", "p", ["grp"])
    return t.select("grp", "n", F.round("mae", 6).alias("mae"), (F.isnan("mape") | (F.col("mape") == float("inf"))).alias("not_finite"))


@query("E3_persistence_baselines", f"SELECT ticker, 'zero' AS rule, {m('actual', '0')} FROM prd WHERE variant = 'baseline' AND prior IS NOT NULL GROUP BY ticker UNION ALL SELECT ticker, 'prior', {m('actual', 'prior')} FROM prd WHERE variant = 'baseline' AND prior IS NOT NULL GROUP BY ticker")
def e3(f):
    p = f.predictions.where("variant = 'baseline' and prior is not null")
    return rounded(E.baselines(p, "actual", "prior", ["ticker"]), ["ticker", "rule"])


@query("E4_averaged_metrics", f"SELECT variant, CAST(sum(n) AS BIGINT) AS n, round(avg(a), 6) AS mae, round(avg(b), 6) AS rmse FROM (SELECT variant, ticker, count(*) AS n, avg(abs(actual - predicted)) AS a, sqrt(avg((actual - predicted) ^ 2)) AS b FROM prd WHERE split = 'test' GROUP BY ALL) GROUP BY variant")
def e4(f):
    per = E.metrics(f.predictions.where("split = 'test'"), "actual", "predicted", ["variant", "ticker"])
    return E.averaged_metrics(per, ["variant"]).select("variant", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query("E5_step_metrics", "SELECT step, count(*) AS n, round(avg(abs(actual - mid)), 6) AS mae, round(sqrt(avg((actual - mid) ^ 2)), 6) AS rmse FROM (SELECT step, actual, (lo + hi) / 2 AS mid FROM bnq) GROUP BY GROUPING SETS ((step), ())")
def e5(f):
    b = E.band_quantiles(f.samples, KEYS).join(f.path_steps, KEYS).withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
    t = E.step_metrics(b, "actual", "mid", [])
    return t.select("step", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query("E6_step_persistence", "SELECT CAST(j AS INTEGER) AS step, count(*) AS n, round(avg(abs(y - y_prior)), 6) AS mae FROM (SELECT p.ticker, p.y_prior, j, f.daily_return AS y FROM pw p CROSS JOIN range(1, 31) t(j) JOIN ftr f ON f.ticker = p.ticker AND f.rn = p.rn + j - 1 WHERE p.split = 'test') GROUP BY j", **PATHW)
def e6(f):
    s = FE.path_steps(FE.path_windows(f.features).where("split = 'test'"))
    t = s.groupBy("step").agg(*E.metric_columns("y", "y_prior"))
    return t.select("step", "n", F.round("mae", 6).alias("mae"))


@query("E7_band_quantiles", "SELECT ticker, window_id, step, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bnq")
def e7(f):
    b = E.band_quantiles(f.samples, KEYS)
    return b.select("ticker", "window_id", "step", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def scores(f):
    return E.nonconformity(E.band_quantiles(f.samples, KEYS), f.path_steps, KEYS)


@query("E8_nonconformity", "SELECT ticker, window_id, step, round(s, 6) AS s FROM ncf")
def e8(f):
    return scores(f).select("ticker", "window_id", "step", F.round("s", 6).alias("s"))


def calibration(f):
    return E.fit_calibration(scores(f).where("fold_id < 3"), ["step"])


@query("E9_conformal_quantile", "SELECT step, n_cal, round(q_hat, 6) AS q_hat FROM cqr")
def e9(f):
    return calibration(f).select("step", "n_cal", F.round("q_hat", 6).alias("q_hat"))


@query("E9_small_sample", """SELECT ticker, window_id // 2 AS pair, count(*) AS n_cal, CAST(round(coalesce(max(s) FILTER (r = ceil((n + 1) * 0.9e0)), 'inf'::DOUBLE), 6) AS VARCHAR) = 'inf' AS too_small,
    CASE WHEN count(*) > 8 THEN round(max(s) FILTER (r = ceil((n + 1) * 0.9e0)), 6) END AS q_hat FROM
    (SELECT ticker, window_id, s, row_number() OVER (PARTITION BY ticker, window_id // 2 ORDER BY s) AS r, count(*) OVER (PARTITION BY ticker, window_id // 2) AS n FROM ncf) GROUP BY ticker, window_id // 2""")
def e9b(f):
    """Pairs of windows: 10 scores give a band, a last single window (at most
    5) is too small and gives +inf."""
    s = scores(f).withColumn("pair", F.floor(F.col("window_id") / 2))
    c = E.fit_calibration(s, ["ticker", "pair"])
    inf = F.col("q_hat") == float("inf")
    return c.select("ticker", "pair", "n_cal", inf.alias("too_small"), F.round(F.when(~inf, F.col("q_hat")), 6).alias("q_hat"))


def calibrated(f, last=True):
    b = scores(f)
    if last:
        b = b.where("fold_id = 3")
    return E.apply_calibration(b, calibration(f), ["step"])


@query("E10_apply_calibration", "SELECT ticker, window_id, step, round(lo - q_hat, 6) AS lo_cal, round(hi + q_hat, 6) AS hi_cal FROM ncf JOIN cqr USING (step) WHERE fold_id = 3")
def e10(f):
    return calibrated(f).select("ticker", "window_id", "step", F.round("lo_cal", 6).alias("lo_cal"), F.round("hi_cal", 6).alias("hi_cal"))


COV = {"cov": "SELECT step, count(*) AS n, avg(CAST(actual BETWEEN lo AND hi AS DOUBLE)) * 100 AS raw_pct, avg(CAST(actual BETWEEN lo - q_hat AND hi + q_hat AS DOUBLE)) * 100 AS calibrated_pct FROM ncf JOIN cqr USING (step) WHERE fold_id = 3 GROUP BY step"}


@query("E11_coverage", "SELECT step, n, round(raw_pct, 4) AS raw_pct, round(calibrated_pct, 4) AS calibrated_pct FROM cov", **COV)
def e11(f):
    t = E.coverage(calibrated(f), ["step"])
    return t.select("step", "n", F.round("raw_pct", 4).alias("raw_pct"), F.round("calibrated_pct", 4).alias("calibrated_pct"))


@query("E12_fold_calibration", "SELECT " + ", ".join(f"round({fn}({c}), 4) AS {c}_{n}" for c in ("raw_pct", "calibrated_pct") for n, fn in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM cov", **COV)
def e12(f):
    t = E.coverage_summary(E.coverage(calibrated(f), ["step"]), [])
    return t.select(*[F.round(c, 4).alias(c) for c in t.columns])


@query("E18_projection_check", """SELECT ticker, as_of, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different, round(sum(score), 6) AS total
    FROM prj GROUP BY ticker, as_of""", **PROJ)
def e18(f):
    """Projected scores against a recompute from the events themselves: highest
    k of a day, type and corridor, highest impact over its countries, decay to
    the target's midnight.  Neither clusters nor their reach are shared."""
    ev = f.scorable.withColumn("published_at", F.to_date("published_at").cast("timestamp"))
    key = [F.to_date("published_at").alias("day"), "event_type", "corridor_key"]
    top = SC.with_k(ev, FX.NATIONS).groupBy(*key).agg(F.max("k").alias("k"), F.max("corridor").alias("corridor"))
    reached = top.withColumn("country", F.explode("corridor")).join(f.reach, ["country", "event_type"])
    reached = reached.groupBy("day", "event_type", "corridor_key", F.col("stock").alias("ticker")).agg(F.max("k").alias("k"), F.max("imp").alias("imp"))
    # the ages a day's events live are spelled out, so that targets meet them by equality
    aged = reached.withColumn("target", F.explode(F.sequence(F.col("day"), F.date_add("day", dims.lookback_days()))))
    age = X.fractional_days(F.col("target").cast("timestamp"), F.col("day").cast("timestamp"))
    aged = aged.withColumn("tau", F.pow(F.lit(0.5), age / F.lit(dims.HALF_LIFE_DAYS))).where(F.col("tau") >= dims.EPSILON)
    days = aged.groupBy("ticker", "target", "day").agg(F.product(1 - F.col("k") * F.col("imp") * F.col("tau")).alias("survive"))
    again = (requests(f).join(days, ["ticker", "target"]).where(F.col("day") <= F.col("as_of")).groupBy("ticker", "as_of", "target")
             .agg((1 - F.product("survive")).alias("again")))
    j = projected(f).join(again, ["ticker", "as_of", "target"], "left").withColumn("again", F.coalesce("again", F.lit(0.0)))
    return j.groupBy("ticker", "as_of").agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("score") - F.col("again")) > 1e-9).alias("n_different"),
                                            F.round(F.sum("again"), 6).alias("total"))


@query("E19_directional_accuracy", "SELECT variant, count(*) AS n, round(avg(CAST(sign(actual) = sign(predicted) AS DOUBLE)), 6) AS directional_accuracy FROM prd GROUP BY variant")
def e19(f):
    t = E.directional_accuracy(f.predictions, "actual", "predicted", ["variant"])
    return t.select("variant", "n", F.round("directional_accuracy", 6).alias("directional_accuracy"))


# -- text corpus -------------------------------------------------------------
STRAT = {"hsh": "SELECT doc_id, lang, substr(sha256(doc_id || '|42'), 1, 15) AS h FROM documents",
         "hrn": "SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS r, count(*) OVER (PARTITION BY lang) AS n FROM hsh",
         "spl": "SELECT doc_id, lang, CASE WHEN n >= 2 AND r <= least(round_even(n * 0.15e0, 0), n - 1) THEN 'val' ELSE 'train' END AS split FROM hrn"}
TOK = {**STRAT, "trn": "SELECT doc_id, text FROM documents JOIN spl USING (doc_id) WHERE split = 'train'",
       "cnt": "SELECT token, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS token FROM trn) GROUP BY token",
       "voc": "SELECT token, c, row_number() OVER (ORDER BY c DESC, token) + 1 AS token_id FROM cnt QUALIFY row_number() OVER (ORDER BY c DESC, token) <= 19998"}


def train_docs(f):
    """Train rows of the stratified split."""
    return C.stratified_split(f.table("documents").select("doc_id", "lang", "text"), "doc_id", "lang").where("split = 'train'")


@query("N2_vocabulary", "SELECT token, c AS count, CAST(token_id AS INTEGER) AS token_id FROM voc", **TOK)
def n2(f):
    return C.vocabulary(train_docs(f), "text")


@query("N3_encode", """SELECT doc_id, array_to_string(list_concat(coalesce(s, []), list_resize([]::BIGINT[], CAST(64 - len(coalesce(s, [])) AS BIGINT), 0)), ' ') AS ids FROM documents LEFT JOIN
    (SELECT doc_id, list(coalesce(token_id, 1) ORDER BY i) AS s FROM (SELECT doc_id, i, toks[i] AS token FROM (SELECT doc_id, toks, unnest(range(1, least(64, len(toks)) + 1)) AS i FROM
      (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS toks FROM documents))) LEFT JOIN voc USING (token) GROUP BY doc_id) USING (doc_id)""", **TOK)
def n3(f):
    e = C.encode(f.table("documents"), C.vocabulary(train_docs(f), "text"), "doc_id", "text", 64)
    return e.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("N4_stratified_split", "SELECT doc_id, lang, split FROM spl", **STRAT)
def n4(f):
    return C.stratified_split(f.table("documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "lang", "split")


CLS = {"cls_": "SELECT unnest(['0', '1', '2']) AS label"}


def classes(f):
    return f.spark.createDataFrame([("0",), ("1",), ("2",)], "label string")


@query("N5_class_support", "SELECT label, count(gold) AS support FROM cls_ LEFT JOIN jdg ON gold = label GROUP BY label", **CLS)
def n5(f):
    return C.class_support(f.judged, "gold", classes(f))


@query("N6_class_weights", "SELECT label, support, round(1e0 / greatest(support, 1) / sum(1e0 / greatest(support, 1)) OVER () * count(*) OVER (), 9) AS weight FROM (SELECT label, count(gold) AS support FROM cls_ LEFT JOIN jdg ON gold = label GROUP BY label)", **CLS)
def n6(f):
    return C.class_weights(C.class_support(f.judged, "gold", classes(f))).select("label", "support", F.round("weight", 9).alias("weight"))


PRF = {"prf0": "SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS np FROM cls_ CROSS JOIN jdg GROUP BY label",
       "prf1": "SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0e0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS r FROM prf0",
       "prf": "SELECT label, support, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END, 4) AS f1 FROM prf1"}


@query("N7_per_class_metrics", "SELECT * FROM prf", **CLS, **PRF)
def n7(f):
    return E.per_class(E.confusion(f.judged, "gold", "pred"), classes(f))


@query("N8_macro_f1_accuracy", "SELECT (SELECT round(avg(f1), 6) FROM prf WHERE support > 0) AS macro_f1, (SELECT round(avg(CAST(gold = pred AS DOUBLE)), 6) FROM jdg) AS accuracy", **CLS, **PRF)
def n8(f):
    conf = E.confusion(f.judged, "gold", "pred")
    macro = E.macro_f1(E.per_class(conf, classes(f))).select(F.lit(1).alias("one"), F.round("macro_f1", 6).alias("macro_f1"))
    acc = E.accuracy(conf).select(F.lit(1).alias("one"), F.round("accuracy", 6).alias("accuracy"))
    return macro.join(acc, "one").drop("one")


@query("N9_majority_baseline", "SELECT label AS majority, round(n / CAST(total AS DOUBLE), 6) AS accuracy FROM (SELECT gold AS label, count(*) AS n, sum(count(*)) OVER () AS total FROM jdg GROUP BY gold ORDER BY n DESC, label LIMIT 1)")
def n9(f):
    maj = E.majority_class(f.judged, "gold").withColumn("one", F.lit(1))
    conf = f.judged.withColumn("one", F.lit(1)).join(F.broadcast(maj), "one")
    acc = E.accuracy(E.confusion(conf, "gold", "majority")).withColumn("one", F.lit(1))
    return maj.join(acc, "one").select("majority", F.round("accuracy", 6).alias("accuracy"))


@query("N10_label_agreement", "SELECT count(*) AS n, round(avg(CAST(gold = pred AS DOUBLE)), 6) AS agreement FROM jdg")
def n10(f):
    return C.label_agreement(f.judged, "gold", "pred").select("n", F.round("agreement", 6).alias("agreement"))


@query("J15_training_pool", "SELECT r.id, l.event_type FROM rawev r JOIN lab l ON l.event_id = r.id WHERE r.source = 'rss' AND l.label_source = 'rule_based' AND r.published_at < TIMESTAMP '2024-01-29 00:00:00'")
def j15(f):
    holdout = f.events.where(F.col("published_at") >= "2024-01-29").select(F.col("event_id").alias("id"))
    return C.training_pool(f.raw, f.labels, holdout, "rss", "rule_based").select("id", "event_type")


N11SQL = {**TEXT, "tys": f"SELECT doc_id, {TYPE_SQL} AS label FROM dcnt",
          "trk": "SELECT label, row_number() OVER (PARTITION BY label ORDER BY substr(sha256(doc_id || '|42'), 1, 15)) AS r, count(*) OVER (PARTITION BY label) AS n FROM tys"}


@query("N11_event_classifier", """SELECT label, CAST(max(n) - max(nv) AS BIGINT) AS n_train, CAST(max(nv) AS BIGINT) AS n_val, true AS beats_majority
    FROM (SELECT label, n, CASE WHEN n >= 2 THEN least(round_even(n * 0.15e0, 0), n - 1) ELSE 0 END AS nv FROM trk) GROUP BY label""", **N11SQL)
def n11(f):
    """Class-weighted classifier of the rule labels' event types, its macro F1
    on the stratified validation rows against always naming the most frequent
    type."""
    # A text is read once: its type and its counts are stored, all passes of split, fit and scores read those.
    typed = low_docs(f).select("doc_id", "text", F.coalesce(L.event_type_match("low", FX.DICTIONARY, "known")["event_type"], F.lit("unclassified")).alias("event_type"))
    typed = materialize(C.hashed_counts(typed, "text").drop("text"), "n11")
    rows = C.stratified_split(typed, "doc_id", "event_type")
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    sizes = rows.groupBy(F.col("event_type").alias("label")).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    sizes = materialize(sizes, "n11-sizes")
    w = materialize(C.class_weights(sizes.select("label", F.col("n_train").alias("support"))).select(F.col("label").alias("event_type"), "weight"), "n11-weights")
    model = C.fit_classifier(train.join(w, "event_type"), "features", "event_type", "weight")
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    pred = model.transform(val).select(F.col("event_type").alias("gold"), F.get(names, F.col("prediction").cast("int")).alias("pred"))
    def macro(rows_, name):
        conf = materialize(E.confusion(rows_, "gold", "pred"), "n11-confusion")  # classes squared rows, read by gold and by guess
        return E.macro_f1(E.per_class(conf, sizes.select("label"))).select(F.col("macro_f1").alias(name))

    majority = F.broadcast(E.majority_class(train, "event_type").withColumnRenamed("majority", "pred"))  # one row
    guess = macro(val.select(F.col("event_type").alias("gold")).join(majority, F.lit(True)), "guess")
    both = macro(pred, "own").join(F.broadcast(guess), F.lit(True)).select((F.col("own") > F.col("guess")).alias("beats_majority"))
    return sizes.join(F.broadcast(both), F.lit(True))


@query("E21_return_forecaster", """SELECT v AS variant, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'train') AS n_train, true AS centred, true AS no_worse_than_zero
    FROM (SELECT split FROM ftr QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date) > 60) CROSS JOIN (VALUES ('baseline'), ('with_score')) t(v) GROUP BY v""")
def e21(f):
    """Pooled forecaster with and without the score.  A least-squares fit with
    an intercept has train residuals of mean zero (its first normal equation)
    and a squared error no larger than that of the constant zero."""
    rows = FE.derived_ratios(f.features)
    rows = materialize(FE.apply_standard(rows, FE.fit_standard(rows, FE.BASE_COLS), FE.BASE_COLS), "e21")
    out = None
    for name, cols in FE.VARIANTS.items():
        xs = [c if c in FE.UNSCALED else f"{c}_z" for c in cols]
        w = FE.lookback_windows(rows, xs)
        pred = FC.predict(FC.fit(w, xs), w, xs)
        train, res = F.col("split") == "train", F.col("y") - F.col("predicted")
        mean = lambda c: F.avg(F.when(train, c))  # noqa: B023, E731
        m_ = pred.agg(F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(train).alias("n_train"),
                      (F.abs(mean(res)) <= 1e-6 * F.greatest(mean(F.abs("y")), F.lit(1e-9))).alias("centred"),
                      (mean(res * res) <= mean(F.col("y") * F.col("y"))).alias("no_worse_than_zero")).withColumn("variant", F.lit(name))
        out = m_ if out is None else out.unionByName(m_)
    return out


@query("E22_sample_paths", """SELECT w.ticker AS ticker, step, count(*) AS n, round(sum(predicted + residual), 4) AS total FROM drw w JOIN res r ON r.ticker = w.ticker AND r.i = w.i
    GROUP BY w.ticker, step""",
       res="SELECT ticker, actual - predicted AS residual, row_number() OVER (PARTITION BY ticker ORDER BY label_date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM prd WHERE variant = 'baseline'",
       rsn="SELECT ticker, max(n) AS n FROM res GROUP BY ticker",
       stp="SELECT f.ticker, (f.rn - 1) // 5 AS window_id, CAST((f.rn - 1) % 5 + 1 AS INTEGER) AS step, p.predicted FROM ftr f JOIN prd p ON p.ticker = f.ticker AND p.label_date = f.date AND p.variant = 'baseline'",
       drw="""SELECT stp.ticker AS ticker, step, predicted, (CAST('0x' || substr(md5(concat_ws('|', stp.ticker, window_id, (step - 1) // 5, s, 42)), 1, 15) AS BIGINT) % n + (step - 1) % 5) % n + 1 AS i
           FROM stp JOIN rsn USING (ticker) CROSS JOIN range(1, 51) t(s)""")
def e22(f):
    point = f.predictions.where("variant = 'baseline'").select("ticker", F.col("label_date").alias("date"), "actual", "predicted")
    steps = f.path_steps.drop("actual").join(point, ["ticker", "date"])
    p = FC.bootstrap_paths(steps, point.select("ticker", "date", (F.col("actual") - F.col("predicted")).alias("residual")))
    return p.groupBy("ticker", "step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# -- portfolios --------------------------------------------------------------
RNK = {"sig": "SELECT p.ticker, label_date AS date, variant, predicted, actual, CASE WHEN CAST(substr(p.ticker, 7) AS INTEGER) % 3 = 0 THEN 's0' WHEN CAST(substr(p.ticker, 7) AS INTEGER) % 3 = 1 THEN 's1' ELSE 's2' END AS sector FROM prd p",
       "rk0": "SELECT *, row_number() OVER (PARTITION BY variant, sector, date ORDER BY predicted DESC, ticker) AS rank, count(*) OVER (PARTITION BY variant, sector, date) AS n FROM sig",
       "wts": "SELECT *, coalesce(((n + 1) / 2 - rank) / nullif(sum(abs((n + 1) / 2 - rank)) OVER (PARTITION BY variant, sector, date), 0), 0e0) AS weight FROM rk0",
       "grid": "SELECT * FROM (SELECT DISTINCT variant, sector, ticker FROM wts) JOIN (SELECT DISTINCT variant, sector, date FROM wts) USING (variant, sector)",
       "net0": "SELECT g.*, coalesce(w.weight, 0e0) AS weight, coalesce(w.weight * w.actual, 0e0) AS gain, abs(coalesce(w.weight, 0e0) - coalesce(lag(w.weight) OVER (PARTITION BY g.variant, g.sector, g.ticker ORDER BY g.date), 0e0)) AS turn FROM grid g LEFT JOIN wts w USING (variant, sector, ticker, date)",
       "day0": "SELECT variant, sector, date, sum(gain) - 0.001e0 * sum(turn) - 0.0002e0 * sum(greatest(-weight, 0e0)) AS ret, sum(turn) AS turnover FROM net0 GROUP BY ALL",
       "wlt": "SELECT variant, sector, unnest(dates) AS date, unnest(rets) AS ret, unnest(turns) AS turnover, unnest(list_transform(range(1, len(rets) + 1), lambda i: CASE WHEN list_min(rets[1:i]) <= -1 THEN 0e0 ELSE exp(list_sum(list_transform(rets[1:i], lambda r: ln(greatest(1 + r, 1e-300))))) END)) AS wealth FROM (SELECT variant, sector, list(date ORDER BY date) AS dates, list(ret ORDER BY date) AS rets, list(turnover ORDER BY date) AS turns FROM day0 GROUP BY variant, sector)",
       "ddn": "SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY variant, sector ORDER BY date ROWS UNBOUNDED PRECEDING), 1e0) - 1 AS dd FROM wlt",
       "rsk": "SELECT variant, sector, count(*) AS n_days, avg(ret) / stddev_samp(ret) * sqrt(252e0) AS sharpe, avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END)) * sqrt(252e0) AS sortino, min(dd) AS max_drawdown, arg_max(wealth, date) - 1 AS cumulative_return FROM ddn GROUP BY variant, sector"}
SECTORS = ["s0", "s1", "s2"]
BY = ["variant", "sector", "date"]
BOOK = ["variant", "sector"]


def with_sector(df):
    n = F.substring("ticker", 7, 3).cast("int") % 3
    return df.withColumn("sector", F.when(n == 0, "s0").when(n == 1, "s1").otherwise("s2"))


def signals(f):
    p = f.predictions.select("ticker", F.col("label_date").alias("date"), "variant", "predicted", F.col("actual").alias("daily_return"))
    return with_sector(p)


def weights(f):
    return PF.rank_weights(signals(f), "predicted", BY)


@query("B1_rank_weights", "SELECT ticker, date, variant, sector, CAST(rank AS INTEGER) AS rank, round(weight, 9) AS weight FROM wts", **RNK)
def b1(f):
    return weights(f).select("ticker", "date", "variant", "sector", "rank", F.round("weight", 9).alias("weight"))


@query("B2_neutrality_check", "SELECT variant, sector, date FROM wts WHERE false", **RNK)
def b2(f):
    return PF.neutrality_violations(weights(f), BY).select("variant", "sector", "date")


@query("B2_violations_found", "SELECT variant, sector, date FROM wts GROUP BY variant, sector, date HAVING sum(abs(weight)) > 1e-9", **RNK)
def b2b(f):
    """Long-only weights are not neutral and must all be reported."""
    long_only = weights(f).withColumn("weight", F.abs("weight"))
    return PF.neutrality_violations(long_only, BY).select("variant", "sector", "date")


@query("B3_momentum_control", "SELECT ticker, date, round(coalesce(((n + 1) / 2 - r) / nullif(sum(abs((n + 1) / 2 - r)) OVER (PARTITION BY date), 0), 0e0), 9) AS weight FROM (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY round(sma_short / sma_long - 1, 8) DESC, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM ftr)")
def b3(f):
    s = PF.momentum_signal(f.features).withColumn("momentum", F.round("momentum", 8))
    return PF.rank_weights(s.select("ticker", "date", "momentum"), "momentum", ["date"]).select("ticker", "date", F.round("weight", 9).alias("weight"))


@query("B3_random_control", "SELECT seed, count(*) AS n, round(sum(weight * daily_return), 4) AS total FROM (SELECT seed, daily_return, coalesce(((n + 1) / 2 - r) / nullif(sum(abs((n + 1) / 2 - r)) OVER (PARTITION BY date, seed), 0), 0e0) AS weight FROM (SELECT CAST(s AS INTEGER) AS seed, date, daily_return, row_number() OVER (PARTITION BY date, s ORDER BY sha256(ticker || '|' || date || '|' || s) DESC, ticker) AS r, count(*) OVER (PARTITION BY date, s) AS n FROM ftr CROSS JOIN range(0, 10) t(s))) GROUP BY seed")
def b3b(f):
    r = PF.random_signal(f.features.select("ticker", "date", "daily_return"))
    w = PF.rank_weights(r, "signal", ["date", "seed"])
    return w.groupBy("seed").agg(F.count("*").alias("n"), F.round(F.sum(F.col("weight") * F.col("daily_return")), 4).alias("total"))


def net(f):
    return PF.net_returns(weights(f), BOOK)


@query("B4_costs", "SELECT variant, sector, date, round(turnover, 9) AS turnover FROM day0", **RNK)
def b4(f):
    return PF.daily_returns(net(f), BOOK).select(*BY, F.round("turnover", 9).alias("turnover"))


def wealth(f):
    return PF.cumulative(PF.daily_returns(net(f), BOOK), BOOK)


@query("B5_daily_cumulative", "SELECT variant, sector, date, round(ret, 8) AS ret, round(CASE WHEN wealth > 0 THEN ln(wealth) END, 6) AS log_wealth FROM wlt", **RNK)
def b5(f):
    return wealth(f).select(*BY, F.round("ret", 8).alias("ret"), F.round(F.log("wealth"), 6).alias("log_wealth"))


RISK = ["sharpe", "sortino", "max_drawdown", "cumulative_return"]


@query("B6_risk_metrics", "SELECT variant, sector, n_days, " + ", ".join(f"round({c}, 6) AS {c}" for c in RISK) + " FROM rsk", **RNK)
def b6(f):
    return PF.risk(wealth(f), BOOK).select("variant", "sector", "n_days", *[F.round(c, 6).alias(c) for c in RISK])


STB = {**RNK, "stb": "SELECT sector, max(sharpe) FILTER (variant = 'baseline') AS base_sharpe, max(sharpe) FILTER (variant = 'with_score') AS variant_sharpe FROM rsk GROUP BY sector"}


def sector_rows(f):
    return PF.sector_table(PF.risk(wealth(f), BOOK), "baseline", "with_score")


@query("B7_sector_table", "SELECT sector, round(base_sharpe, 6) AS base_sharpe, round(variant_sharpe, 6) AS variant_sharpe, variant_sharpe > base_sharpe AS beats FROM stb", **STB)
def b7(f):
    return sector_rows(f).select("sector", F.round("base_sharpe", 6).alias("base_sharpe"), F.round("variant_sharpe", 6).alias("variant_sharpe"), "beats")


FSUM = {**RNK, "fw": "SELECT *, CAST(year(date) AS INTEGER) AS fold_id FROM day0",
        "fr": "SELECT sector, variant, fold_id, avg(ret) / stddev_samp(ret) * sqrt(252e0) AS sharpe FROM fw GROUP BY ALL"}


@query("B8_fold_summary", "SELECT sector, variant, count(*) AS n_folds, round(avg(sharpe), 6) AS mean_sharpe, round(median(sharpe), 6) AS median_sharpe, round(stddev_samp(sharpe), 6) AS std_sharpe, round(avg(CAST(sharpe > b AS DOUBLE)), 6) AS hit_rate FROM (SELECT *, max(sharpe) FILTER (variant = 'baseline') OVER (PARTITION BY sector, fold_id) AS b FROM fr) GROUP BY sector, variant", **FSUM)
def b8(f):
    d = PF.daily_returns(net(f), BOOK).withColumn("fold_id", F.year("date"))
    by = [*BOOK, "fold_id"]
    s = PF.fold_summary(PF.risk(PF.cumulative(d, by), by), "baseline", ["sector"])
    return s.select("sector", "variant", "n_folds", *[F.round(c, 6).alias(c) for c in ("mean_sharpe", "median_sharpe", "std_sharpe", "hit_rate")])


@query("B9_display_gate", "SELECT count(*) FILTER (variant_sharpe > base_sharpe) AS hits, count(*) AS n_sectors, bool_and(variant_sharpe > base_sharpe) AS shown FROM stb", **STB)
def b9(f):
    return PF.hit_rate(sector_rows(f))


@query("B10_position_counts", "SELECT ticker, variant, count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short, count(*) FILTER (weight = 0) AS n_flat FROM wts GROUP BY ticker, variant", **RNK)
def b10(f):
    return PF.position_counts(weights(f), ["ticker", "variant"])

