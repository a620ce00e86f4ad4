"""Order statistics against brute force, features against hand counts."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import corpus as CO
from tremor.operators import evaluate as E
from tremor.operators import features as FE
from tremor.operators import portfolio as PF
from tremor.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of them."""
    r = random.Random(7)
    rows = [("hot", float(v)) for v in [42.0] * 700 + [round(r.gauss(0, 50), 3) for _ in range(1300)]]
    rows += [("small", float(v)) for v in range(9)] + [("one", 1.5)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5)


def test_order_statistic(skewed):
    rows, df = skewed
    for frac in (0.0, 0.3, 0.5, 0.9, 1.0):
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(frac)))
        got = {r["g"]: r["value"] for r in ranks.order_statistic(df, ["g"], "v", rank).collect()}
        for g in ("hot", "small", "one"):
            vals = sorted(v for k, v in rows if k == g)
            assert got[g] == vals[max(1, math.ceil(len(vals) * frac)) - 1], (g, frac)


def test_quantiles(skewed):
    import numpy as np

    rows, df = skewed
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", {"lo": .33, "hi": .67}).collect()}
    for g in ("hot", "small", "one"):
        vals = [v for k, v in rows if k == g]
        assert got[g]["lo"] == pytest.approx(np.percentile(vals, 33)) and got[g]["hi"] == pytest.approx(np.percentile(vals, 67))


def test_rank_out_of_range_is_null(skewed):
    got = {r["g"]: r["value"] for r in ranks.order_statistic(skewed[1], ["g"], "v", F.lit(10)).collect()}
    assert got["small"] is None and got["one"] is None and got["hot"] is not None


def test_conformal_small_samples(spark):
    df = spark.createDataFrame([(9, float(i)) for i in range(9)] + [(8, float(i)) for i in range(8)], "step int, s double")
    got = {r["step"]: r["q_hat"] for r in E.fit_calibration(df, ["step"]).collect()}
    assert got == {9: 8.0, 8: math.inf}


def test_stratified_split_sizes(spark):
    rows = [(i, "big") for i in range(100)] + [(100 + i, "two") for i in range(2)] + [(200, "single")] + [(300 + i, "ten") for i in range(10)]
    out = CO.stratified_split(spark.createDataFrame(rows, "id int, label string"), "id", "label")
    n = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert n == {("big", "val"): 15, ("big", "train"): 85, ("two", "train"): 2, ("single", "train"): 1, ("ten", "val"): 2, ("ten", "train"): 8}


def feature_rows(spark, n, ticker="T"):
    d0 = dt.date(2020, 1, 1)
    rows = [(ticker, d0 + dt.timedelta(days=i), 100.0 + math.sin(i) * 5) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, adj_close double")


def test_split_counts(spark):
    f = FE.assign_splits(feature_rows(spark, 502))
    b = {r["split"]: (r["n_rows"], r["n_usable_labels"]) for r in FE.split_bounds(f).collect()}
    assert b == {"train": (351, 291), "val": (75, 75), "test": (76, 76)}


def test_asof_is_backward(spark):
    d = [dt.date(2024, 1, i) for i in range(1, 7)]
    prices = spark.createDataFrame([("T", x) for x in d], "ticker string, date date")
    scores = spark.createDataFrame([("T", d[1], .2), ("T", d[3], .4), ("T", dt.date(2024, 1, 9), .9)], "ticker string, date date, score double")
    got = [(r["score"], r["score_source_date"]) for r in FE.asof_scores(prices, scores).orderBy("date").collect()]
    assert got == [(None, None), (.2, d[1]), (.2, d[1]), (.4, d[3]), (.4, d[3]), (.4, d[3])]


def test_path_windows_tail_and_boundaries(spark):
    f = FE.assign_splits(feature_rows(spark, 502).withColumn("daily_return", F.lit(0.01)))
    strict, full = FE.path_windows(f), FE.path_windows(f, strict_tail=False)
    assert full.count() == strict.count() + 1
    n = {r["split"]: r["count"] for r in strict.groupBy("split").count().collect()}
    assert n == {"train": 291 - 29, "val": 75 - 29, "test": 76 - 30}
    assert FE.path_leaks(strict, FE.split_bounds(f)).count() == 0
    assert FE.path_steps(strict).count() == 30 * strict.count()


def test_folds_match_published_table(spark):
    """443 usable label days, 4 folds of 50: sizes of the published table."""
    days = feature_rows(spark, 443).select("date")
    first = spark.createDataFrame([(dt.date(2019, 10, 1),)], "first_date date")
    folds = FE.walk_forward_folds(days, first, 4, 50)
    n = {(r["fold_id"], r["split"]): r["n_label_days"] for r in folds.collect()}
    assert [tuple(n[(k, s)] for s in ("train", "val", "test")) for k in (1, 2, 3, 4)] == [(207, 36, 50), (249, 44, 50), (292, 51, 50), (334, 59, 50)]
    assert FE.fold_violations(folds).count() == 0
    assert folds.where("split = 'train'").select("start_date").distinct().count() == 1
    broken = folds.withColumn("end_date", F.when(F.col("split") == "test", F.date_add("end_date", 100)).otherwise(F.col("end_date")))
    assert FE.fold_violations(broken).count() == 3


def test_rank_weights(spark):
    df = spark.createDataFrame([("d", f"t{i}", float(8 - i)) for i in range(8)], "date string, ticker string, s double")
    w = [r["weight"] for r in PF.rank_weights(df, "s", ["date"]).orderBy("ticker").collect()]
    assert w == pytest.approx([.21875, .15625, .09375, .03125, -.03125, -.09375, -.15625, -.21875])
    assert PF.neutrality_violations(PF.rank_weights(df, "s", ["date"]), ["date"]).count() == 0


def test_drawdown_and_costs(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    rows = [(d[0], "a", .5, .1), (d[0], "b", -.5, 0.), (d[1], "a", -.5, .1), (d[1], "b", .5, 0.), (d[2], "a", -.5, -.1), (d[2], "b", .5, 0.)]
    df = spark.createDataFrame(rows, "date date, ticker string, weight double, daily_return double").withColumn("book", F.lit("x"))
    day = {r["date"]: r for r in PF.daily_returns(PF.net_returns(df, ["book"]), ["book"]).collect()}
    assert day[d[0]]["ret"] == pytest.approx(.05 - .001 - .0001) and day[d[1]]["turnover"] == pytest.approx(2.0)
    assert day[d[1]]["ret"] == pytest.approx(-.05 - .002 - .0001) and day[d[2]]["ret"] == pytest.approx(.05 - .0001)
    r = PF.risk(PF.cumulative(PF.daily_returns(PF.net_returns(df, ["book"]), ["book"]), ["book"]), ["book"]).first()
    assert r["max_drawdown"] == pytest.approx(-.0521)


def test_exits_and_ruin(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 3, 4)]
    # b leaves after day 1 and comes back on day 3; a has its worst day then
    rows = [(d[0], "a", .5, 0.), (d[0], "b", -.5, 0.), (d[1], "a", .5, 0.), (d[2], "a", .5, -2.5), (d[2], "b", -.5, 0.), (d[3], "a", .5, .2), (d[3], "b", -.5, 0.)]
    df = spark.createDataFrame(rows, "date date, ticker string, weight double, daily_return double").withColumn("book", F.lit("x"))
    daily = PF.daily_returns(PF.net_returns(df, ["book"]), ["book"])
    day = {r["date"]: r for r in daily.collect()}
    assert [day[x]["turnover"] for x in d] == pytest.approx([1.0, .5, .5, 0])
    wealth = {r["date"]: r["wealth"] for r in PF.cumulative(daily, ["book"]).collect()}
    assert wealth[d[1]] == pytest.approx((1 - .001 - .0001) * (1 - .0005)) and wealth[d[2]] == wealth[d[3]] == 0
    r = PF.risk(PF.cumulative(daily, ["book"]), ["book"]).first()
    assert r["cumulative_return"] == -1 and r["max_drawdown"] == -1


def test_encode_and_weights(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, ""), (4, "a b c d e")], "id int, text string")
    vocab = CO.vocabulary(docs.where("id in (1, 2)"), "text")
    assert [(r["token"], r["token_id"]) for r in vocab.orderBy("token_id").collect()] == [("a", 2), ("b", 3), ("c", 4)]
    got = {r["id"]: r["ids"] for r in CO.encode(docs, vocab, "id", "text", 4).collect()}
    assert got == {1: [2, 3, 2, 0], 2: [4, 0, 0, 0], 3: [0, 0, 0, 0], 4: [2, 3, 4, 1]}
    sup = spark.createDataFrame([("x", 0), ("y", 4)], "label string, support long")
    w = {r["label"]: r["weight"] for r in CO.class_weights(sup).collect()}
    assert w == {"x": pytest.approx(1.6), "y": pytest.approx(.4)}


def test_path_residuals_hang_together_as_the_pool_does(spark):
    """Residuals with a lag-1 correlation of 0.8: within a stretch the paths
    show it too; drawn one by one they would show none."""
    from tremor.operators import forecast as FC

    rng, x, pool = random.Random(4), 0.0, []
    for i in range(1500):
        x = 0.8 * x + rng.gauss(0, 1)
        pool.append(("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), x))
    residuals = spark.createDataFrame(pool, "ticker string, date date, residual double")
    steps = spark.createDataFrame([("A", w, s, 0.0) for w in range(40) for s in range(1, 21)], "ticker string, window_id long, step int, predicted double")

    def lag1(block):
        rows = FC.bootstrap_paths(steps, residuals, 20, block=block).toPandas().sort_values(["window_id", "sample_id", "step"])
        assert len(rows) == 40 * 20 * 20
        v = rows["value"].to_numpy().reshape(-1, 20)
        inside = [k for k in range(19) if (k + 1) % block]  # pairs of steps of one stretch
        return np.corrcoef(v[:, inside].ravel(), v[:, [k + 1 for k in inside]].ravel())[0, 1] if inside else np.corrcoef(v[:, :-1].ravel(), v[:, 1:].ravel())[0, 1]

    own = np.corrcoef([r[2] for r in pool[:-1]], [r[2] for r in pool[1:]])[0, 1]
    assert abs(lag1(5) - own) < 0.05 and abs(lag1(20) - own) < 0.05 and abs(lag1(1)) < 0.05
