"""The batch jobs end to end on the built-in graph, each run twice."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tremor import dims
from tremor import schemas as S
from tremor.plans import jobs

T0 = dt.datetime(2024, 1, 10, 9)


def raw(spark, rows):
    return spark.createDataFrame([(i, s, i, t, T0, title, text, url, meta) for i, s, t, title, text, url, meta in rows], S.RAW_EVENTS)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    store = jobs.Store(spark, str(tmp_path_factory.mktemp("store")))
    meta = json.dumps({"QuadClass": 4, "GoldsteinScale": -8.0, "NumMentions": 12, "Actor1CountryCode": "TWN"})
    news = raw(spark, [("n1", "rss", T0, "Earthquake hits Taiwan", "flooding and landslide", "http://a/1", None),
                       ("n2", "rss", T0, "Bakery opens", "", "http://a/2", None), ("n1", "rss", T0 + dt.timedelta(hours=1), "repeat", "", "http://a/1", None)])
    coded = raw(spark, [("c1", "gdelt", T0, "Missile fired near Taipei", None, "http://b/1", meta), ("c2", "gdelt", T0 + dt.timedelta(days=1), "Man arrested", None, "http://b/2", meta)])
    return store, news, coded


def scores(store):
    return {(r["ticker"], r["date"].day): r["score"] for r in store.scores.read().collect()}


def test_pipeline(spark, world):
    store, news, coded = world
    for k in range(2):
        out = {r["source"]: r for r in jobs.ingest(store, {"rss": news, "gdelt": coded})}
        assert [out[s]["inserted"] for s in ("rss", "gdelt")] == ([2, 2] if k == 0 else [0, 0])
        lab = jobs.label(store)
        assert [lab[s]["inserted"] for s in ("rss", "gdelt")] == ([2, 2] if k == 0 else [0, 0])
    graph = jobs.Graph.builtin(spark)
    span = [F.lit(d).cast("date") for d in ("2024-01-09", "2024-01-13")]
    # No ledger yet: the gate is off and both coded rows count.
    jobs.rebuild_scores(store, graph, *span)
    open_gate = scores(store)
    assert len(open_gate) == 23 * 5 and open_gate[("TSM", 9)] == 0 and open_gate[("TSM", 10)] > 0
    assert store.catalog.read().count() == 3
    answers = spark.createDataFrame([("c1", json.dumps({"event_type": dims.TENSION, "confidence": .9, "severity_score": .8, "countries": ["Taiwan"]}))], "event_id string, answer string")
    assert jobs.recheck(store, answers) == {"confirmed": 1, "checked": 2}
    assert {r["event_id"]: r["verdict"] for r in store.ledger.read().collect()} == {"c1": "confirm_stage2", "c2": "reject_stage1"}
    assert jobs.recheck(store, answers) == {"confirmed": 0, "checked": 0}
    for _ in range(2):
        jobs.rebuild_scores(store, graph, *span)
        gated = scores(store)
        assert len(gated) == len(open_gate)
        assert {r["event_id"] for r in store.catalog.read().collect()} == {"n1", "c1"}
    assert gated[("TSM", 11)] != open_gate[("TSM", 11)]
    assert store.attribution.read().where("event_id = 'c2'").count() == 0
    top = store.attribution.read().where("ticker = 'TSM' and date = date'2024-01-10'").orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["path"] == ["Taiwan", "TSM"]
    # A deleted label must not come back.
    assert jobs.label(store)["gdelt"]["inserted"] == 0


def stored(store):
    r6 = lambda r, *c: tuple(round(r[x], 9) if isinstance(r[x], float) else str(r[x]) for x in c)
    return (sorted(r6(r, "ticker", "date", "score", "direction", "direction_coverage", "n_clusters") for r in store.scores.read().collect()),
            sorted(r6(r, "ticker", "date", "rank", "event_id", "contribution", "path") for r in store.attribution.read().collect()),
            sorted(r6(r, "event_id", "label_source", "title", "published_at") for r in store.catalog.read().collect()))


def labelled_events(spark, n):
    """Labels with publish times over half a year, several to a cluster."""
    import random

    rng = random.Random(n)
    kinds, places = [dims.TENSION, "natural_disaster", "trade_export_control"], [["Taiwan"], ["United States"], ["South Korea", "Taiwan"]]
    rows = []
    for i in range(n):
        t = dt.datetime(2024, 1, 1, 6) + dt.timedelta(days=rng.randrange(180), minutes=rng.randrange(600))
        rows.append((f"e{i}", rng.choice(kinds), rng.choice([.2, .5, .8]), .5, rng.choice([None, -.5]), rng.choice(places), "rule_based", t))
    schema = "event_id string, event_type string, severity_score double, confidence double, polarity double, countries array<string>, label_source string, published_at timestamp"
    return spark.createDataFrame(rows, schema)


def test_late_rows_reach_their_days_and_no_others(spark, tmp_path):
    """Three batches, each late for the ones before, against one rebuild; a
    batch that comes twice; folders of days out of reach keep their files."""
    import os

    from tremor.operators import scoring as SC

    graph = jobs.Graph.builtin(spark)
    reach, stocks = graph.reach().cache(), graph.stocks()
    start, end = (F.lit(d).cast("date") for d in ("2024-01-01", "2024-07-15"))
    events = labelled_events(spark, 120)
    raw_rows = events.select(F.col("event_id").alias("id"), F.lit("rss").alias("source"), F.col("event_id").alias("source_id"), "published_at",
                             F.col("published_at").alias("ingested_at"), F.concat(F.lit("title "), "event_id").alias("title"), F.lit("x").alias("text"),
                             F.lit("http://x").alias("url"), F.lit(None).cast("string").alias("raw_metadata"))
    whole, live = jobs.Store(spark, str(tmp_path / "whole"), ticker_buckets=2), jobs.Store(spark, str(tmp_path / "live"), ticker_buckets=2)
    for s in (whole, live):
        s.raw_events.insert_or_ignore(raw_rows, ["source"])
    clusters = SC.build_clusters(events, graph.country_nodes)
    spread = SC.spread_days(SC.cluster_reach(clusters, reach), start, end)
    whole.scores.insert_or_replace(SC.daily_scores(spread, stocks, start, end))
    whole.attribution.replace_groups(SC.attribution(spread), ["ticker", "date"])
    whole.catalog.insert_or_replace(jobs.catalog_rows(clusters, whole.raw_events.read(), None))

    assert jobs.extend_days(live, stocks, reach, start, F.lit("2024-06-30").cast("date")) == 23 * 182
    batch = lambda i: events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i)
    seen = [jobs.refresh_scores(live, batch(i), reach, graph.country_nodes, start, end) for i in range(3)]
    assert seen[0]["clusters"] and any(s["replaced"] for s in seen[1:])
    assert jobs.refresh_scores(live, batch(1), reach, graph.country_nodes, start, end) == {"clusters": 0, "replaced": 0, "days": 0}
    jobs.extend_days(live, stocks, reach, start, end)  # days of July that no event reaches
    assert jobs.extend_days(live, stocks, reach, start, end) == 0
    assert stored(live) == stored(whole)

    files = lambda: {f: os.stat(f.removeprefix("file:")).st_mtime_ns for f in live.scores.read().inputFiles()}
    before = files()
    late = labelled_events(spark, 1).withColumn("published_at", F.lit("2024-04-02 10:00:00").cast("timestamp")).withColumn("event_id", F.lit("late")).withColumn("severity_score", F.lit(.9))
    assert jobs.refresh_scores(live, late, reach, graph.country_nodes, start, end)["clusters"] == 1
    after = files()
    months = {f.split("month=")[1][:7] for f in set(before.items()) ^ set(after.items()) for f in [f[0]]}
    assert months <= {"2024-04", "2024-05"} and months


def test_features_and_forecast(spark, world, tmp_path):
    import math

    store = jobs.Store(spark, str(tmp_path))
    d0 = dt.date(2023, 1, 1)
    bars = [(t, d0 + dt.timedelta(days=i), *[50 + 5 * math.sin(i / 3 + k)] * 5, 100) for k, t in enumerate(("A", "B")) for i in range(150)]
    store.bars.insert_or_ignore(spark.createDataFrame(bars, S.DAILY_BARS), ["volume"])
    sc = [(t, d0 + dt.timedelta(days=i), i / 200, None, 0.0, 0) for t in ("A", "B") for i in range(20, 150)]
    store.scores.insert_or_replace(spark.createDataFrame(sc, S.DAILY_SCORES))
    jobs.build_features(store)
    n = {r["split"]: r["count"] for r in store.features.read().groupBy("split").count().collect()}
    assert sum(n.values()) == 2 * 101 and n["train"] == 2 * 71
    for _ in range(2):
        jobs.forecast(store, lookback=10)
        p = store.predictions.read()
        assert p.count() == 2 * n["test"] and p.where("predicted is null").count() == 0


def test_multi_step_chain(spark, tmp_path):
    """Folds, calibration, coverage and stored price paths."""
    import math

    from tremor.operators import features as FE
    from tremor.operators import views as V

    store = jobs.Store(spark, str(tmp_path))
    d0 = dt.date(2022, 1, 3)
    feed = [(t, d0 + dt.timedelta(days=i), *[50 + 5 * math.sin(i / 3 + k) + (i * 7919 % 13) / 10] * 5, 100, i) for k, t in enumerate(("A", "B")) for i in range(260)]
    feed.append(("A", d0, 1.0, 2.0, 3.0, 1.0, 1.0, 100, -1))
    bars = spark.createDataFrame(feed, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume long, pos int")
    assert [tuple(r) for r in jobs.ingest_bars(store, bars, ["pos"]).collect()] == [("A", "inconsistent range", 1)]
    sc = [(t, d0 + dt.timedelta(days=i), i / 400, None, 0.0, 0) for t in ("A", "B") for i in range(260)]
    store.scores.insert_or_replace(spark.createDataFrame(sc, S.DAILY_SCORES))
    jobs.build_features(store)
    bounds = jobs.walk_forward(store, n_folds=2, test_days=30)
    assert bounds.count() == 2 * 2 * 3 and FE.fold_violations(bounds.where("ticker = 'A'")).count() == 0
    reach = spark.createDataFrame([("X", "strike", "A", .5, ["X", "A"]), ("X", "strike", "B", .25, ["X", "B"])],
                                  "country string, event_type string, stock string, imp double, path array<string>")
    events = [(d0 + dt.timedelta(days=i), "strike", "X", .4, ["X"], f"e{i}", "manual", None, .4, 1.0, ["X"], dt.datetime(2022, 1, 3) + dt.timedelta(days=i)) for i in range(0, 270, 3)]
    store.clusters.insert_or_replace(spark.createDataFrame(events, jobs.CLUSTERS))
    asked = jobs.project_paths(store, reach, lookback=10, horizon=5).collect()
    days = {r["date"] for r in store.features.read().select("date").collect()}
    assert len(asked) == len({(r["ticker"], r["as_of"], r["target"]) for r in asked}) > 5 * (len(days) - 20)
    for r in asked:  # from what was known when the path began, and nothing later
        left = 1.0
        for day, *_ in events:
            age = (r["target"] - day).days
            if day <= r["as_of"] and 0 <= age and .5 ** (age / 5) >= .01:
                left *= 1 - .4 * (.5 if r["ticker"] == "A" else .25) * .5 ** (age / 5)
        assert r["score"] == pytest.approx(1 - left, abs=1e-12) and r["score"] > 0
    jobs.calibrate_and_forecast(store, reach, lookback=10, horizon=5, n_samples=10)
    cal = store.calibration.read().collect()
    assert len(cal) == 2 * 5 and all(r["q_hat"] < float("inf") and r["calibrated_pct"] >= 50 for r in cal)
    fc = store.forecasts.read()
    assert fc.count() == 2 * 2 * 5
    rows = V.latest_vintage(fc).where("ticker = 'A' and variant = 'with_score'").orderBy("horizon_step").collect()
    assert [r["horizon_step"] for r in rows] == [1, 2, 3, 4, 5] and all(r["target_date"].weekday() < 5 for r in rows)
    close = store.bars.read().where("ticker = 'A'").orderBy(F.col("date").desc()).first()["adj_close"]
    price = close
    for r in rows:
        price *= 1 + r["point_return"]
        assert r["point_price"] == pytest.approx(price) and r["lo_price"] < r["point_price"] < r["hi_price"]


def test_one_labeller_failing_does_not_stop_the_others(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path))
    rows = raw(spark, [("n1", "rss", T0, "Earthquake", "", "http://a/1", None), ("c1", "gdelt", T0, None, None, "http://b/1", '{"QuadClass": 4, "GoldsteinScale": -8.0, "NumMentions": 1}')])
    jobs.ingest(store, {"all": rows})
    out = jobs.label(store, dictionary=object())  # no word lists at all
    assert out["rss"]["error"] and out["gdelt"]["error"] is None and out["gdelt"]["inserted"] == 1
