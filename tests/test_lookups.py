"""Small look-ups, JSON clean-up and aggregates on hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tremor.functions import exprs as X
from tremor.operators import evaluate as E
from tremor.operators import features as FE
from tremor.operators import views as V

NAN, INF = float("nan"), float("inf")


def test_finite_at_every_level(spark):
    ddl = ("`a b` double, f float, s struct<v:double,t:struct<w:float,n:string>>, l array<array<double>>, m map<string,struct<x:double>>, "
           "i int, none struct<v:double>, names array<string>")
    row = (NAN, INF, (1.5, (float("-inf"), "n")), [[NAN, 2.0], None], {"k": (INF,), "j": (3.0,)}, 7, None, ["a"])
    df = spark.createDataFrame([row], ddl)
    out = X.finite_rows(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    r = out.first()
    assert (r["a b"], r.f, r.i, r.none, r.names) == (None, None, 7, None, ["a"])
    assert (r.s.v, r.s.t.w, r.s.t.n) == (1.5, None, "n") and r.l == [[None, 2.0], None]
    assert {k: v.x for k, v in r.m.items()} == {"k": None, "j": 3.0}
    assert spark.createDataFrame([], ddl).transform(X.finite_rows).count() == 0


def test_json_columns(spark):
    df = spark.createDataFrame([('["a", null, "b"]', '{"k": 3}'), ("[oops", "nope"), (None, None), ("{}", "[]")], "l string, o string")
    rows = df.select(X.json_list("l").alias("l"), X.json_object("o", "k int, z string").alias("o")).collect()
    assert [r.l for r in rows] == [["a", "b"], [], [], []]
    assert [r.o and r.o.k for r in rows] == [3, None, None, None] and all(r.o.z is None for r in rows)


def test_lookback_days(spark):
    rows = spark.createDataFrame([(5.0,), (10.0,)], "h double").select(X.lookback_days("h", .01).alias("d")).collect()
    assert [r.d for r in rows] == [math.ceil(h * math.log2(100)) for h in (5, 10)] == [34, 67]


def test_scopes(spark):
    scope = spark.createDataFrame([("energy", "T1", "US", 1), ("tech", "T2", "US", 1), ("energy", "T2", "IR", 2), ("tech", "T3", "IR", 3)],
                                  "sector string, ticker string, country string, code int")
    union = V.scope_union(scope, "country", "code")
    assert {r.country: (r.n_codes, r.conflict) for r in union.collect()} == {"US": (1, False), "IR": (2, True)}
    assert V.require_no_conflict(V.scope_union(scope.where("country = 'US'"), "country", "code"), "country").count() == 1
    with pytest.raises(Exception, match="sectors disagree on IR"):
        V.require_no_conflict(union, "country").collect()
    got = V.sector_of(spark.createDataFrame([("T2",), ("T9",)], "ticker string"), scope).collect()
    assert {r.ticker: r.sector for r in got} == {"T2": "energy", "T9": None}


def test_ledgers_and_aggregates(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, v int")
    ledger = spark.createDataFrame([("a",), (None,)], "id string")
    assert sorted(r.v for r in V.not_in(rows, ledger, "id").collect()) == [2, 3, 4]
    names = spark.createDataFrame([("a", "A")], "key string, name string")
    assert {r.v: r.name for r in V.lookup(rows, names, "id", "key", ["name"]).collect()} == {1: "A", 2: None, 3: None, 4: None}
    assert {r.id: r.n for r in V.counts_by(rows, "id").collect()} == {"a": 1, "b": 2, None: 1}
    assert tuple(V.dedup_ratio(rows, "id").first()) == (4, 3, 4 / 3)
    assert tuple(V.dedup_ratio(rows.limit(0), "id").first()) == (0, 0, None)
    d = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([("A", d, .1), ("A", d + dt.timedelta(days=2), .2)], "ticker string, date date, daily_return double")
    assert tuple(V.coverage_by(bars, "ticker").first()) == ("A", 2, d, d + dt.timedelta(days=2))
    assert V.freshness(bars, "date").first().latest == d + dt.timedelta(days=2)
    assert [r.prior for r in FE.prior_returns(bars).orderBy("date").collect()] == [None, .1]


def test_pools_and_reports(spark):
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (3, 9.0)], "fold_id int, s double")
    assert E.pool_folds(s, [0, 1]).agg(F.sum("s")).first()[0] == 3.0
    reports = spark.createDataFrame([("baseline", NAN, [1.0, INF]), ("with_score", 1.0, [])], "variant string, sharpe double, path array<double>")
    r = V.stored_report(reports, "baseline", "all").collect()
    assert [tuple(x) for x in r] == [("all", "baseline", None, [1.0, None])]
