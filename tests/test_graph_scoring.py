"""Golden values of the built-in graph and of the score formula."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tremor import dims
from tremor.operators import graph as G
from tremor.operators import scoring as SC


@pytest.fixture(scope="module")
def reach(spark):
    r = G.reach(dims.edges_df(spark), dims.nodes_df(spark), dims.activation_df(spark)).cache()
    assert r.count() > 0
    return r


def pick(reach, country, event_type):
    rows = reach.where((F.col("country") == country) & (F.col("event_type") == event_type)).collect()
    return {r["stock"]: (round(r["imp"], 6), list(r["path"])) for r in rows}


def test_sizes(spark):
    assert len(dims.EDGES) == 112 and dims.nodes_df(spark).count() == 32
    assert len(dims.TICKERS) == 23 and len(dims.COUNTRIES) == 5
    assert dims.lookback_days() == 34


def test_taiwan_disaster(reach):
    got = pick(reach, "Taiwan", "natural_disaster")
    want = {"TSM": .9, "NVDA": .675, "AMD": .63, "QCOM": .585, "ASML": .36, "AMAT": .315, "INTC": .225, "MU": .45}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["NVDA"][1] == ["Taiwan", "TSM", "NVDA"] and got["MU"][1] == ["Taiwan", "MU"]


def test_us_export_control(reach):
    got = {k: v[0] for k, v in pick(reach, "United States", "trade_export_control").items()}
    assert len(got) == 23
    for t, v in {"VRTX": .7, "MRNA": .66, "JPM": .65, "ZION": .62, "REGN": .61, "NVDA": .6}.items():
        assert got[t] == v


def test_korea_fab(reach):
    got = {k: v[0] for k, v in pick(reach, "South Korea", "supply_chain_fab_disruption").items()}
    assert got == {"MU": .3, "NVDA": .25, "AMD": .2, "TSM": .1485, "QCOM": .12375, "ASML": .1155, "INTC": .1155, "AMAT": .10725}


def test_corridor_is_max_over_countries(spark, reach):
    pairs = spark.createDataFrame([("Russia|Saudi Arabia", ["Russia", "Saudi Arabia"], "geopolitical_military_tension")],
                                  "corridor_key string, corridor array<string>, event_type string")
    got = {r["stock"]: round(r["imp"], 6) for r in G.corridor_reach(pairs, reach).collect()}
    assert got == {"OXY": .28, "VLO": .27, "XOM": .255, "EOG": .24, "LNG": .165}


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, label_source string, event_type string, severity_score double, "
                                       "confidence double, polarity double, countries array<string>, published_at timestamp")


T0 = dt.datetime(2024, 3, 10)
A = ("a", "rule_based", "natural_disaster", .8, .6, None, ["Taiwan"], T0 - dt.timedelta(days=2))
B = ("b", "gdelt_derived", "geopolitical_military_tension", .6, .55, -.7, ["United States"], T0 - dt.timedelta(days=1))
GOLD = {"TSM": (.355219, -.7, .112182), "NVDA": (.273289, -.7, .130250), "INTC": (.155704, -.7, .495656)}


def stocks(spark):
    return spark.createDataFrame([(t,) for t in dims.TICKERS], "ticker string")


def daily(spark, reach, rows, start, end):
    cr = SC.cluster_reach(SC.build_clusters(events(spark, rows), dims.COUNTRY_NAMES), reach)
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    con = SC.spread_days(cr, s, e)
    return con, SC.daily_scores(con, stocks(spark), s, e)


def test_daily_golden(spark, reach):
    _, d = daily(spark, reach, [A, B], "2024-03-10", "2024-03-10")
    got = {r["ticker"]: r for r in d.collect()}
    assert len(got) == 23
    for t, (score, direction, cov) in GOLD.items():
        assert got[t]["score"] == pytest.approx(score, abs=1e-6)
        assert got[t]["direction"] == pytest.approx(direction)
        assert got[t]["direction_coverage"] == pytest.approx(cov, abs=1e-6)


def test_instant_equals_daily_at_midnight(spark, reach):
    con = SC.instant_contributions(events(spark, [A, B]), dims.COUNTRY_NAMES, reach, F.lit(T0))
    got = {r["ticker"]: r["score"] for r in SC.instant_scores(con, stocks(spark)).collect()}
    for t, (score, _, _) in GOLD.items():
        assert got[t] == pytest.approx(score, abs=1e-6)


def test_window_edge_and_empty_days(spark, reach):
    _, d = daily(spark, reach, [A], "2024-03-01", "2024-05-01")
    n = {r["date"]: r["n_clusters"] for r in d.where("ticker = 'TSM'").collect()}
    first = A[-1].date()
    assert n[first - dt.timedelta(days=1)] == 0 and n[first] == 1
    assert n[first + dt.timedelta(days=33)] == 1 and n[first + dt.timedelta(days=34)] == 0
    assert len(n) == 62
    quiet = d.where("n_clusters = 0").select("score", "direction", "direction_coverage").distinct().collect()
    assert [tuple(r) for r in quiet] == [(0.0, None, 0.0)]


def test_duplicates_and_monotone(spark, reach):
    weaker = ("c", "rule_based", "natural_disaster", .5, .6, .9, ["Taiwan"], A[-1])
    other = ("d", "manual", "trade_export_control", .5, .5, None, ["Taiwan"], A[-1])
    base = {r["ticker"]: r["score"] for r in daily(spark, reach, [A, B], "2024-03-10", "2024-03-10")[1].collect()}
    same = {r["ticker"]: r["score"] for r in daily(spark, reach, [A, B, weaker], "2024-03-10", "2024-03-10")[1].collect()}
    more = {r["ticker"]: r["score"] for r in daily(spark, reach, [A, B, other], "2024-03-10", "2024-03-10")[1].collect()}
    assert base == same
    assert all(base[t] <= more[t] <= 1 for t in base) and any(more[t] > base[t] for t in base)


def test_ties_and_exclusions(spark):
    e = events(spark, [("z", "manual", "natural_disaster", .5, .5, None, ["Taiwan"], T0), ("y", "manual", "natural_disaster", .5, .5, .1, ["Taiwan"], T0),
                       ("u", "manual", "unclassified", .9, .9, None, ["Taiwan"], T0), ("v", "hearsay", "natural_disaster", .9, .9, None, ["Taiwan"], T0),
                       ("w", "manual", "natural_disaster", .9, .9, None, ["Atlantis"], T0)])
    got = SC.build_clusters(e, dims.COUNTRY_NAMES).collect()
    assert [(r["event_id"], r["corridor_key"], round(r["k"], 6)) for r in got] == [("y", "Taiwan", .25)]


def test_attribution_ranks(spark, reach):
    con, _ = daily(spark, reach, [A, B], "2024-03-10", "2024-03-10")
    rows = SC.attribution(con, 1).where("ticker = 'TSM'").collect()
    assert [(r["rank"], r["event_id"], r["days_since"]) for r in rows] == [(1, "a", 2)]
    assert rows[0]["contribution"] == pytest.approx(.327395, abs=1e-6)
    both = SC.attribution(con, 5).where("ticker = 'INTC'").orderBy("rank").collect()
    assert [r["event_id"] for r in both] == ["a", "b"]


def test_future_events_do_not_count(spark, reach):
    con = SC.instant_contributions(events(spark, [B]), dims.COUNTRY_NAMES, reach, F.lit(B[-1] - dt.timedelta(seconds=1)))
    assert con.count() == 0


def test_projection_sees_only_known_events(spark, reach):
    late = ("late", "manual", "natural_disaster", 1., 1., None, ["Taiwan"], T0 + dt.timedelta(days=1))
    cr = SC.cluster_reach(SC.build_clusters(events(spark, [A, late]), dims.COUNTRY_NAMES), reach)
    req = spark.createDataFrame([("TSM", T0.date(), (T0 + dt.timedelta(days=2)).date())], "ticker string, as_of date, target date")
    s, e = F.lit("2024-03-01").cast("date"), F.lit("2024-04-30").cast("date")
    got = SC.projected_scores(cr, req, s, e).collect()[0]["score"]
    assert got == pytest.approx(.8 * .6 * .9 * .5 ** (4 / 5))


def test_what_if(spark, reach):
    s = spark.createDataFrame([(1, "natural_disaster", ["Taiwan"], .7, .7)], "scenario_id int, event_type string, countries array<string>, severity double, confidence double")
    got = {r["stock"]: r["contribution"] for r in G.simulate(s, reach).collect()}
    assert got["TSM"] == pytest.approx(.7 * .7 * .9) and len(got) == 8


def test_grounding_limits_and_orders(spark, reach):
    edges = dims.edges_df(spark).withColumn("note", F.concat(F.lit("§x-1: "), F.col("src"), F.lit(" to "), F.col("dst"), F.lit(" "), F.coalesce("channel", F.lit("beta"))))
    er = reach.where("country = 'Taiwan' and event_type = 'natural_disaster' and stock = 'NVDA'").withColumn("event_id", F.lit("e"))
    got = G.grounding(er.select("event_id", "stock", "imp", "path"), edges).collect()[0]["notes"]
    assert got == ["Taiwan to TSM manufacturing", "TSM to NVDA beta"]
    us = spark.createDataFrame([("e", "TSM", .5, ["United States", "TSM"])], "event_id string, stock string, imp double, path array<string>")
    assert len(G.grounding(us, edges, 2).collect()[0]["notes"]) == 2


@pytest.mark.parametrize("seed", range(2))
def test_strongest_paths_equal_enumeration(spark, seed):
    """Random graphs with parallel edges, cycles and ties, up to four hops."""
    import random

    rng = random.Random(seed)
    names = [f"c{i}" for i in range(3)] + [f"s{i}" for i in range(3)] + [f"k{i}" for i in range(4)]
    kind = {"c": "country", "s": "sector", "k": "stock"}
    nodes = spark.createDataFrame([(n, kind[n[0]]) for n in names], "name string, node_type string")
    pairs = [(a, b) for a in names for b in names if a != b and rng.random() < .45]
    edges = spark.createDataFrame([(a, b, rng.choice(["x", "y"]), rng.choice([.25, .5, .5, .9])) for a, b in pairs for _ in range(rng.randint(1, 2))],
                                  "src string, dst string, channel string, weight double")
    act = spark.createDataFrame([("t", "x", .5), ("t", "y", 1.0), ("u", "x", .25)], "event_type string, channel string, activation double")
    for hops in (3, 4):
        every = G.paths(edges, nodes, hops)
        scored = every.join(act, "channel").withColumn("imp", F.col("activation") * F.col("weight"))
        want = {(r.country, r.event_type, r.stock): round(r.imp, 12) for r in scored.groupBy("country", "event_type", "stock").agg(F.max("imp").alias("imp")).collect()}
        table = G.reach(edges, nodes, act, hops).collect()
        assert {(r.country, r.event_type, r.stock): round(r.imp, 12) for r in table} == want
        weight = {}
        for r in edges.collect():
            weight.setdefault((r.src, r.dst), []).append((r.channel, r.weight))
        for r in table:  # each path is simple and really gives its impact
            assert len(set(r.path)) == len(r.path) <= hops + 1
            steps = list(zip(r.path, r.path[1:]))
            firsts = [w * {("t", "x"): .5, ("t", "y"): 1.0, ("u", "x"): .25}.get((r.event_type, c), 0) for c, w in weight[steps[0]]]
            for later in steps[1:]:
                firsts = [f * w for f in firsts for _, w in weight[later]]
            assert any(abs(f - r.imp) < 1e-12 for f in firsts)
        kept = G.strongest_paths(edges, nodes, hops).count()
    assert kept * 5 < every.count()
