"""Scalar functions and labelling on hand-made rows."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tremor import dims
from tremor.functions import exprs as X
from tremor.functions import phrases as PH
from tremor.functions import text as TX
from tremor.operators import labels as L


def one(spark, expr, **cols):
    names, vals = list(cols), list(cols.values())
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in cols.items())
    return spark.createDataFrame([tuple(vals)], schema).select(expr.alias("x")).first()["x"] if names else spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("url,want", [
    ("HTTP://Example.COM/a/b//?q=1#frag", "http://example.com/a/b?q=1"), ("https://x.y", "https://x.y/"),
    ("  https://x.y/ ", "https://x.y/"), ("//Host/p", "http://host/p"), ("a.b/c/", "http:a.b/c"), ("/p/q", "http:///p/q"),
    ("mailto:me@x", "mailto:me@x"), ("   ", None), (None, None), ("http://h/p?", "http://h/p"), ("http://h/a\nb", "http://h/ab"),
])
def test_normalize_url(spark, url, want):
    assert one(spark, X.normalize_url("u"), u=url) == want


def test_event_id_rejects(spark):
    import hashlib

    df = spark.createDataFrame([("http://A.b/", None), (None, "n1"), ("", None), (None, "")], "url string, sid string")
    got = [r["x"] for r in df.select(X.event_id(F.lit("rss"), "url", "sid").alias("x")).collect()]
    assert got == [hashlib.sha256(b"rss|http://a.b/").hexdigest(), hashlib.sha256(b"rss|n1").hexdigest(), None, None]


def test_decay_values_and_errors(spark):
    df = spark.createDataFrame([(0,), (5,), (10,)], "d int")
    assert [r["x"] for r in df.select(X.time_decay("d").alias("x")).collect()] == [1.0, .5, .25]
    with pytest.raises(ValueError):
        X.time_decay("d", 0)
    with pytest.raises(Exception, match="negative age"):
        spark.createDataFrame([(-1,)], "d int").select(X.time_decay("d").alias("x")).collect()


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (-.1, 0., .149, .15, .35, .55, .75, 1., 2.)], "s double")
    rows = df.select(X.severity_band("s").alias("b")).withColumn("m", X.severity_midpoint("b")).collect()
    assert [r["b"] for r in rows] == [1, 1, 1, 2, 3, 4, 5, 5, 5]
    assert {r["b"]: r["m"] for r in rows} == {1: .075, 2: .25, 3: .45, 4: .65, 5: .875}


def test_path_impact(spark):
    df = spark.sql("select array(0.9D, 0.75D) w")
    assert df.select(X.path_impact("w").alias("x")).first()["x"] == pytest.approx(.675)
    assert df.select(X.path_impact("w", .5).alias("x")).first()["x"] == pytest.approx(.3375)


def test_price_delta(spark):
    df = spark.createDataFrame([(11., 10.), (9., 10.), (9., None), (9., 0.)], "c double, p double")
    rows = df.select(X.price_delta_pct("c", "p").alias("x"), X.price_delta_dir("c", "p").alias("d")).collect()
    assert [(r["x"] and round(r["x"], 6), r["d"]) for r in rows] == [(10.0, "yes"), (-10.0, "no"), (None, ""), (None, "yes")]


@pytest.mark.parametrize("text,kw,want", [
    ("toward peace", "war", False), ("mamdani wins", "amd", False), ("the u.s. said", "u.s.", True), ("war", "war", True),
    ("post-war era", "war", True), ("war_room", "war", False), ("préwar", "war", False), ("opec+ cuts", "opec+", True),
    ("opec+s", "opec+", False), ("trade  war", "trade war", False), ("trade war!", "trade war", True), ("a cross-strait visit", "cross-strait", True),
])
def test_keyword_boundaries(spark, text, kw, want):
    df = spark.createDataFrame([(text,)], "t string").withColumn("k", PH.found_keywords("t", [kw, "other words"]))
    row = df.select(TX.keyword_hit("t", kw).alias("a"), TX.keyword_hit("t", kw, "k").alias("b"), TX.any_hit("t", [kw], "k").alias("c")).first()
    assert tuple(row) == (want, want, want)


def test_phrase_walk_keeps_overlapping_and_inner_keywords():
    """Against a regular expression per keyword, on texts made of their pieces."""
    keys = ("trade", "trade war", "war", "war room", "opec+", "+", "u.s.", "s", "a", "aa", "é", "_x", "trade  war")
    rng = random.Random(2)
    pieces = [*keys, " ", " ", "-", "_", "1", "x", ".", "日"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        want = [k for k in keys if re.search(r"(?<!\w)" + re.escape(k) + r"(?!\w)", text)]
        assert PH.standing_alone(text, keys) == want, text
    assert PH.standing_alone("anything", ()) == [] and PH.standing_alone("", keys) == []


def test_texts_are_walked_once(spark):
    """One walk in the plan, however many lists and tests follow it."""
    df = spark.createDataFrame([("1", "War", None)], "id string, title string, text string")
    plan = L.label_by_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_rule_label_rows(spark):
    rows = [("1", "US weighs export ban on chips", "New tariffs and sanctions on Taiwan; TSMC falls"), ("2", None, None), ("3", "", "quiet day for us"),
            ("4", "War and merger", None), ("5", "Banks rally in America", ""), ("6", "Charles Schwab beats earnings guidance", "")]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    got = {r["event_id"]: r for r in L.label_by_rules(df).collect()}
    a = got["1"]
    assert a["event_type"] == "trade_export_control" and a["confidence"] == .55 and a["severity"] == 4
    assert a["countries"] == ["Taiwan", "United States"] and a["companies"] == ["TSM"] and a["sector"] == "semiconductors"
    assert (got["2"]["event_type"], got["2"]["confidence"], got["2"]["severity"], got["2"]["severity_score"]) == ("unclassified", 0.0, 1, .075)
    assert got["2"]["countries"] == [] and got["2"]["sector"] is None
    assert got["3"]["event_type"] == "unclassified" and got["3"]["countries"] == []
    assert got["4"]["event_type"] == "geopolitical_military_tension" and got["4"]["severity"] == 5  # tie: earlier category
    assert got["5"]["sector"] == "financials" and got["5"]["countries"] == ["United States"]
    assert got["6"]["event_type"] == "corporate_strategic" and got["6"]["companies"] == ["SCHW"] and got["6"]["severity"] == 2


def test_coded_labels(spark):
    rows = [(1, 4, -10.0, 20), (2, 3, -5.0, 4), (3, 1, 3.4, 10), (4, 4, -9.5, 0), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id int, q int, g double, m int")
    got = {r["event_id"]: r for r in L.label_coded(df, F.col("id"), F.col("q"), F.col("g"), F.col("m"), F.array(F.lit("Taiwan"))).collect()}
    view = lambda i: (got[i]["severity_score"], got[i]["severity"], got[i]["confidence"], got[i]["polarity"])
    assert view("1") == (1.0, 5, .55, -1.0) and view("2") == (.51, 3, .40, -.5)
    assert view("3") == (.2757, 2, .15, pytest.approx(.34)) and view("4") == (.6175, 4, .55, -.95)
    assert view("5") == (0.0, 1, .15, None) and got["3"]["event_type"] == "unclassified"


def test_headlines(spark):
    rows = [("Missile strike near border",), ("Man arrested after car crash",), ("Troops and National Guard deployed",), ("Local bakery opens",), ("North Korea reopens to tourists",)]
    df = spark.createDataFrame(rows, "title string")
    assert [r["screen"] for r in L.screen_headlines(df).collect()] == ["confirm", "reject", "uncertain", "uncertain", "uncertain"]


def test_model_verdicts(spark):
    def ans(**kw):
        return json.dumps(kw)

    rows = [("a", ans(event_type=dims.TENSION, confidence=80, severity_score=.5, severity=3)), ("b", ans(event_type=dims.TENSION, confidence=.74)),
            ("c", ans(event_type="gossip", confidence=.9)), ("d", "{bad"), ("e", ans(event_type="natural_disaster", confidence=.99, severity=7, severity_score=1)),
            ("f", ans(event_type=dims.TENSION, confidence=.75, severity_score=.125))]
    got = {r["event_id"]: r for r in L.fold_verdicts(spark.createDataFrame(rows, "event_id string, answer string")).withColumn("ok", L.accepted()).collect()}
    assert set(got) == {"a", "b", "e", "f"}
    assert got["a"]["confidence"] == .8 and got["a"]["severity"] == 3 and got["a"]["ok"]
    assert got["b"]["severity_score"] == .5 and got["b"]["severity"] == 3 and not got["b"]["ok"]
    assert got["e"]["severity"] == 5 and not got["e"]["ok"]
    assert got["f"]["severity"] == 1 and got["f"]["ok"]  # round(0.5) is 0: half to even


def test_gate(spark):
    labels = spark.createDataFrame([("1", "gdelt_derived", dims.TENSION), ("2", "gdelt_derived", dims.TENSION), ("3", "manual", dims.TENSION),
                                    ("4", "gdelt_derived", "natural_disaster"), ("5", "manual", "unclassified")], "event_id string, label_source string, event_type string")
    raw = spark.sql("select string(id) id, timestamp'2024-01-01' published_at from range(1, 6)")
    ledger = spark.createDataFrame([("1", "confirm_stage2"), ("2", "reject_stage2")], "event_id string, verdict string")
    ids = lambda led: sorted(r["event_id"] for r in L.scorable(labels, raw, led).collect())
    assert ids(ledger) == ["1", "3", "4"] and ids(None) == ["1", "2", "3", "4"]
