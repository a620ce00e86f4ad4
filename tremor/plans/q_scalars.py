"""Scalar functions and text labelling."""

import math

from pyspark.sql import functions as F

from tremor import dims
from tremor.functions import exprs as X
from tremor.functions import text as TX
from tremor.functions.phrases import found_keywords
from tremor.operators import labels as L
from tremor.operators import ranks
from tremor.operators import views as V
from tremor.plans import fixtures as FX
from tremor.plans.oracle import band
from tremor.plans.registry import query

D = FX.DICTIONARY
B0, B1 = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


# -- the same keyword rules as SQL text --------------------------------------
def _lit(s: str) -> str:
    return s.replace("'", "''")


def hit(col: str, kw: str) -> str:
    return f"regexp_matches({col}, '{B0}{_lit(TX.quote(kw.lower()))}{B1}')"


def any_hit(col: str, kws) -> str:
    alts = "|".join(_lit(TX.quote(k.lower())) for k in kws)
    return f"regexp_matches({col}, '{B0}({alts}){B1}')"


def n_hits(col: str, kws) -> str:
    return "(" + " + ".join(f"CAST({hit(col, k)} AS INTEGER)" for k in kws) + ")"


NORM = r"""CASE WHEN length(s) > 0 THEN
    lower(CASE WHEN regexp_extract(s, '{r}', 1) = '' THEN 'http' ELSE regexp_extract(s, '{r}', 1) END) || ':' ||
    CASE WHEN regexp_extract(s, '{r}', 2) <> '' OR starts_with(CASE WHEN rtrim(regexp_extract(s, '{r}', 3), '/') = '' THEN '/' ELSE regexp_extract(s, '{r}', 3) END, '/')
         THEN '//' || lower(regexp_extract(s, '{r}', 2)) ELSE '' END ||
    CASE WHEN rtrim(regexp_extract(s, '{r}', 3), '/') = '' THEN '/' ELSE rtrim(regexp_extract(s, '{r}', 3), '/') END ||
    CASE WHEN regexp_extract(s, '{r}', 4) <> '' THEN '?' || regexp_extract(s, '{r}', 4) ELSE '' END END""".replace(
    "{r}", r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$")
URLS = {"urls": "SELECT page_id, url, trim(CASE WHEN page_id % 10 = 0 THEN '  ' WHEN page_id % 10 = 1 THEN replace(url, 'http', 'HTTP') || '///#frag' WHEN page_id % 10 = 2 THEN replace(url, 'http://', '') ELSE ' ' || url || ' ' END) AS s FROM pages"}


def _urls(f):
    i, u = F.col("page_id") % 10, F.col("url")
    s = (F.when(i == 0, F.lit("  ")).when(i == 1, F.concat(F.replace(u, F.lit("http"), F.lit("HTTP")), F.lit("///#frag")))
         .when(i == 2, F.replace(u, F.lit("http://"), F.lit(""))).otherwise(F.concat(F.lit(" "), u, F.lit(" "))))
    return f.pages.select("page_id", s.alias("s"))


@query("F1_normalize_url", f"SELECT page_id, {NORM} AS norm FROM urls", **URLS)
def f1(f):
    return _urls(f).select("page_id", X.normalize_url("s").alias("norm"))


@query("F2_event_id", f"""SELECT page_id, CASE WHEN length(s) > 0 THEN sha256('rss|' || {NORM}) WHEN page_id % 20 = 0 THEN sha256('rss|' || page_id) END AS id FROM urls""", **URLS)
def f2(f):
    native = F.when(F.col("page_id") % 20 == 0, F.col("page_id").cast("string"))
    return _urls(f).withColumn("native", native).select("page_id", X.event_id(F.lit("rss"), "s", "native").alias("id"))


@query("F3_http_only", "SELECT page_id, CASE WHEN starts_with(lower(s), 'http') THEN s END AS u FROM urls", **URLS)
def f3(f):
    return _urls(f).select("page_id", X.http_only("s").alias("u"))


@query("F4_clip", "SELECT eid, greatest(-0.5e0, least(0.5e0, goldstein / 10e0)) AS v FROM ev")
def f4(f):
    return f.events.select("eid", X.clip(F.col("goldstein") / 10.0, -0.5, 0.5).alias("v"))


@query("F5_tolerant_clip", "SELECT eid, CASE WHEN x IS NULL THEN 0.5e0 ELSE greatest(0e0, least(1e0, CASE WHEN x > 1 THEN x / 100e0 ELSE x END)) END AS v FROM (SELECT eid, CASE WHEN eid % 9 <> 0 THEN k0 / 2e0 - 3 END AS x FROM ev)")
def f5(f):
    x = F.when(F.col("eid") % 9 != 0, F.col("k0") / F.lit(2.0) - 3)
    return f.events.select("eid", X.tolerant_clip(x, 0.5).alias("v"))


@query("F6_severity_band", f"SELECT eid, {band('greatest(0e0, least(1e0, k0 / 100e0))')} AS band FROM ev")
def f6(f):
    return f.events.select("eid", X.severity_band(F.col("k0") / F.lit(100.0)).alias("band"))


@query("F7_band_midpoint", "SELECT event_id, CASE severity WHEN 1 THEN 0.075e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.45e0 WHEN 4 THEN 0.65e0 ELSE 0.875e0 END AS mid FROM lab")
def f7(f):
    return f.labels.select("event_id", X.severity_midpoint("severity").alias("mid"))


@query("F8_time_decay", "SELECT eid, round(pow(0.5e0, k0 / 5e0), 9) AS tau FROM ev")
def f8(f):
    return f.events.select("eid", F.round(X.time_decay("k0"), 9).alias("tau"))


@query("F9_lookback_days", "SELECT quad, CAST(ceil((quad + 4) * log2(100e0)) AS BIGINT) AS days, count(*) AS n FROM ev GROUP BY ALL")
def f9(f):
    return f.events.select("quad", X.lookback_days(F.col("quad") + 4, dims.EPSILON).alias("days")).groupBy("quad", "days").agg(F.count("*").alias("n"))


@query("F10_path_impact", "SELECT src, round(product(weight) * pow(0.9e0, count(*) - 1), 9) AS imp FROM edg WHERE channel IS NULL GROUP BY src")
def f10(f):
    w = f.edges.where("channel is null").groupBy("src").agg(F.array_sort(F.collect_list("weight")).alias("w"))
    return w.select("src", F.round(X.path_impact("w", 0.9), 9).alias("imp"))


@query("F11_propagated_impact", "SELECT eid, round(severity_score * pow(0.5e0, (eid % 30) / 5e0), 9) AS v FROM lab")
def f11(f):
    return f.labels.select("eid", F.round(X.propagated_impact("severity_score", F.col("eid") % 30), 9).alias("v"))


@query("F12_price_delta", """SELECT ticker, date, round((close - p) / p * 100, 6) AS pct, CASE WHEN p IS NULL THEN '' WHEN close - p >= 0 THEN 'yes' ELSE 'no' END AS dir
    FROM (SELECT ticker, date, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars)""")
def f12(f):
    from tremor.operators.features import by_ticker

    r = f.bars.withColumn("p", F.lag("close").over(by_ticker()))
    return r.select("ticker", "date", F.round(X.price_delta_pct("close", "p"), 6).alias("pct"), X.price_delta_dir("close", "p").alias("dir"))


@query("F13_tiers", "SELECT eid, CASE WHEN severity_score < 0.25e0 THEN 'Weak' WHEN severity_score < 0.48e0 THEN 'Moderate' ELSE 'Strong' END AS impact_tier, CASE WHEN severity_score / 8 < 0.058e0 THEN 'Weak' WHEN severity_score / 8 < 0.084e0 THEN 'Moderate' ELSE 'Strong' END AS contribution_tier FROM lab")
def f13(f):
    s = F.col("severity_score")
    return f.labels.select("eid", X.tier(s, dims.IMPACT_CUTS).alias("impact_tier"), X.tier(s / 8, dims.CONTRIBUTION_CUTS).alias("contribution_tier"))


@query("F14_tier_calibration", "SELECT event_type, round(quantile_cont(k, 0.33), 9) AS low, round(quantile_cont(k, 0.67), 9) AS high FROM kev GROUP BY event_type")
def f14(f):
    from tremor.operators import scoring as SC

    q = ranks.quantiles(SC.with_k(f.scorable, FX.NATIONS), ["event_type"], "k", {"low": 0.33, "high": 0.67})
    return q.select("event_type", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("F15_clean_note", "SELECT src, dst, channel, coalesce(channel, 'beta') || ' share' AS note FROM edg")
def f15(f):
    return f.edges.select("src", "dst", "channel", X.clean_note("note").alias("note"))


@query("F16_derived_ratios", "SELECT ticker, date, round(adj_close / sma_long, 6) AS price_to_sma_long, round(sma_short / sma_long, 6) AS sma_ratio FROM ftr")
def f16(f):
    from tremor.operators import features as FE

    r = FE.derived_ratios(f.features)
    return r.select("ticker", "date", F.round("price_to_sma_long", 6).alias("price_to_sma_long"), F.round("sma_ratio", 6).alias("sma_ratio"))


@query("F17_sector_of_ticker", "SELECT ticker, seg AS sector, volume FROM (SELECT ticker, sum(volume)::BIGINT AS volume FROM bars GROUP BY ticker) b LEFT JOIN (SELECT stock, min(seg) AS seg FROM rev GROUP BY stock) r ON r.stock = b.ticker")
def f17(f):
    scope = f.revenue.select(F.col("stock").alias("ticker"), F.col("seg").alias("sector"))
    return V.sector_of(f.bars.groupBy("ticker").agg(F.sum("volume").alias("volume")), scope).select("ticker", "sector", "volume")


@query("F18_coded_countries", """SELECT eid, array_to_string(list_sort(list_distinct(list_filter([
    CASE WHEN user_id % 25 < 20 THEN actor1 END, CASE WHEN (user_id * 7) % 25 < 20 THEN actor2 END, CASE WHEN eid % 2 = 0 THEN 'NATION_3' END], lambda x: x IS NOT NULL))), '|') AS countries FROM ev""")
def f18(f):
    actors = {n: n for n in FX.NATIONS[:20]}
    place = F.when(F.col("eid") % 2 == 0, "P3").otherwise("P4")
    c = X.coded_countries("actor1", "actor2", place, actors, {"P3": "NATION_3"})
    return f.events.select("eid", F.array_join(c, "|").alias("countries"))


@query("F19_corridor", "SELECT eid, CASE WHEN len(c) > 0 THEN array_to_string(c, '|') END AS corridor FROM (SELECT eid, list_sort(list_filter([actor2, actor1], lambda x: x IN ('NATION_1', 'NATION_2', 'NATION_4', 'NATION_7', 'NATION_0'))) AS c FROM ev)")
def f19(f):
    c = X.corridor(F.array("actor2", "actor1"), ["NATION_1", "NATION_2", "NATION_4", "NATION_7", "NATION_0"])
    return f.events.select("eid", F.array_join(c, "|").alias("corridor"))


SPLITS = {"train": ("1996-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-06-30"), "test": ("1999-07-01", "2000-12-31")}


@query("F20_split_of_date", "SELECT ticker, date, " + "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{s}'" for s, (a, b) in SPLITS.items()) + " END AS split FROM bars")
def f20(f):
    return f.bars.select("ticker", "date", X.split_of_date("date", SPLITS).alias("split"))


@query("F21_sparkline_scale", """SELECT ticker, date, round((adj_close - min(adj_close) OVER w) / coalesce(nullif(max(adj_close) OVER w - min(adj_close) OVER w, 0), 1), 6) AS scaled
    FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30) WINDOW w AS (PARTITION BY ticker)""")
def f21(f):
    r = V.sparkline(V.last_points(f.bars, 30), "adj_close")
    return r.select("ticker", "date", F.round("scaled", 6).alias("scaled"))


@query("F22_quick_ranges", "SELECT ticker, r AS quick_range, count(*) AS n FROM (SELECT ticker, date, max(date) OVER (PARTITION BY ticker) AS newest FROM bars) JOIN (VALUES ('1M', 30), ('3M', 91), ('6M', 182), ('1Y', 365)) t(r, days) ON date >= newest - days GROUP BY ALL")
def f22(f):
    r = V.last_days(f.bars, 365)
    newest = f.bars.groupBy("ticker").agg(F.max("date").alias("newest"))
    tags = F.array_compact(F.array(*[F.when(F.col("date") >= F.date_sub("newest", d), F.lit(n)) for n, d in V.QUICK_RANGES.items()]))
    return r.join(newest, "ticker").select("ticker", F.explode(tags).alias("quick_range")).groupBy("ticker", "quick_range").agg(F.count("*").alias("n"))


# -- text labelling ----------------------------------------------------------
@query("T1_boundary_match", f"""SELECT doc_id, {hit("lower(text)", "the")} AS hit_the, {hit("lower(text)", "é")} AS hit_accent,
    {hit("lower(text)", "que.")} AS hit_dot, {hit("lower(text)", "an")} AS hit_an FROM documents""")
def t1(f):
    d = f.table("documents").withColumn("low", F.lower("text"))
    return d.select("doc_id", *[TX.keyword_hit("low", k).alias(n) for n, k in (("hit_the", "the"), ("hit_accent", "é"), ("hit_dot", "que."), ("hit_an", "an"))])


_CATS = list(D.event_types.items())
_COUNTS = ", ".join(f"{n_hits('low', kws)} AS c{i}" for i, (_, kws) in enumerate(_CATS))
_BEST = "greatest(" + ", ".join(f"c{i}" for i in range(len(_CATS))) + ")"
_TYPE = "CASE WHEN " + _BEST + " = 0 THEN 'unclassified' " + " ".join(f"WHEN c{i} = {_BEST} THEN '{t}'" for i, (t, _) in enumerate(_CATS)) + " END"
_SEV = "CASE " + " ".join(f"WHEN {any_hit('low', D.severity[b])} THEN {b}" for b in (5, 4, 3, 2, 1)) + " END"
_COUNTRY = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {any_hit('low', als)}" + (f" OR regexp_matches(alltext, '{B0}The{B1}')" if c == "United States" else "") + f" THEN '{c}' END"
    for c, als in D.countries.items()) + "], lambda x: x IS NOT NULL))"
_BYT = L._by_ticker(D)
_COMPANY = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {any_hit('low', a)} THEN '{t}' END" for t, a in _BYT.items()) + "], lambda x: x IS NOT NULL))"
_SECTOR = "CASE " + " ".join(f"WHEN {any_hit('low', [alias])} THEN '{D.ticker_sector[t]}'" for t, alias in D.companies) + " " + \
    " ".join(f"WHEN {any_hit('low', k)} THEN '{s}'" for s, k in D.sectors.items()) + " END"
TEXT = {"dlow": "SELECT *, lower(alltext) AS low FROM doc", "dcnt": f"SELECT *, {_COUNTS} FROM dlow"}


def _low(f):
    d = f.docs.withColumn("all", TX.combined_text("title", "text")).withColumn("low", F.lower("all"))
    return d.withColumn("known", found_keywords("low", D.all_keywords()))


@query("T2_event_type", f"SELECT id, {_TYPE} AS event_type, {_BEST} AS n_hits FROM dcnt", **TEXT)
def t2(f):
    m = _low(f).select("id", L.event_type_match("low", D, "known").alias("m"))
    return m.select("id", F.coalesce("m.event_type", F.lit("unclassified")).alias("event_type"), F.coalesce("m.n", F.lit(0)).alias("n_hits"))


@query("T3_severity", f"SELECT id, CAST({_SEV} AS INTEGER) AS severity FROM dlow", **TEXT)
def t3(f):
    return _low(f).select("id", L.severity_match("low", D, "known").alias("severity"))


@query("T4_entities", f"SELECT id, array_to_string({_COUNTRY}, '|') AS countries, array_to_string({_COMPANY}, '|') AS companies FROM dlow", **TEXT)
def t4(f):
    return _low(f).select("id", F.array_join(L.match_countries("all", "low", D, "known"), "|").alias("countries"),
                          F.array_join(L.match_companies("low", D, "known"), "|").alias("companies"))


@query("T5_sector", f"SELECT id, {_SECTOR} AS sector FROM dlow", **TEXT)
def t5(f):
    return _low(f).select("id", L.match_sector("low", D, "known").alias("sector"))


@query("T6_confidence", "SELECT eid, round(least(0.25e0 + 0.1e0 * (eid % 9), 0.85e0), 4) AS confidence FROM ev")
def t6(f):
    return f.events.select("eid", L.rule_confidence(F.col("eid") % 9).alias("confidence"))


@query("T7_rule_label", f"""SELECT id AS event_id, 'rule_based' AS label_source, event_type, CAST(sv AS INTEGER) AS severity,
    CASE sv WHEN 1 THEN 0.075e0 WHEN 2 THEN 0.25e0 WHEN 3 THEN 0.45e0 WHEN 4 THEN 0.65e0 ELSE 0.875e0 END AS severity_score,
    CASE WHEN event_type = 'unclassified' THEN 0e0 ELSE round(least(0.25e0 + 0.1e0 * best, 0.85e0), 4) END AS confidence,
    array_to_string(countries, '|') AS countries, sector, array_to_string(companies, '|') AS companies FROM
    (SELECT id, event_type, best, CASE WHEN event_type = 'unclassified' THEN 1 ELSE coalesce(sev, 2) END AS sv, countries, sector, companies FROM
      (SELECT id, {_TYPE} AS event_type, {_BEST} AS best, {_SEV} AS sev, {_COUNTRY} AS countries, {_SECTOR} AS sector, {_COMPANY} AS companies FROM dcnt))""", **TEXT)
def t7(f):
    r = f.doc_labels
    return r.select("event_id", "label_source", "event_type", "severity", "severity_score", "confidence",
                    F.array_join("countries", "|").alias("countries"), "sector", F.array_join("companies", "|").alias("companies"))


_GEO, _REJ = any_hit("lower(title)", FX.HEADLINE_CONFIRM), any_hit("lower(title)", FX.HEADLINE_REJECT)


@query("T8_headline_verdict", f"SELECT id, CASE WHEN {_GEO} AND NOT {_REJ} THEN 'confirm' WHEN {_REJ} AND NOT {_GEO} THEN 'reject' ELSE 'uncertain' END AS verdict FROM doc")
def t8(f):
    return L.screen_headlines(f.docs, "title", FX.HEADLINE_CONFIRM, FX.HEADLINE_REJECT, "verdict").select("id", "verdict")


CODED = {"cdl": f"""SELECT event_id, quad, CASE WHEN eid % 10 <> 0 THEN goldstein END AS g, CASE WHEN eid % 8 <> 0 THEN k0 END AS m,
    list_sort(list_distinct([actor1, actor2])) AS countries FROM ev""",
         "cds": f"""SELECT *, round(greatest(0e0, least(1e0, 0.65e0 * CASE WHEN g IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, -g / 10e0)) END
    + 0.35e0 * greatest(0e0, least(1e0, ln(1e0 + coalesce(m, 0)) / ln(21e0))))), 4) AS score FROM cdl"""}


@query("T9_coded_label", f"""SELECT event_id, CASE WHEN quad >= 3 THEN 'geopolitical_military_tension' ELSE 'unclassified' END AS event_type,
    CASE quad WHEN 4 THEN 0.55e0 WHEN 3 THEN 0.4e0 ELSE 0.15e0 END AS confidence,
    CASE WHEN g IS NOT NULL THEN greatest(-1e0, least(1e0, g / 10e0)) END AS polarity, score AS severity_score,
    CAST({band('score')} AS INTEGER) AS severity, array_to_string(countries, '|') AS countries FROM cds""", **CODED)
def t9(f):
    eid = F.col("eid")
    r = L.label_coded(f.events, F.col("event_id"), F.col("quad"), F.when(eid % 10 != 0, F.col("goldstein")),
                      F.when(eid % 8 != 0, F.col("k0")), X.coded_countries("actor1", "actor2", F.lit("-"), FX.NATION_MAP, {"x": "x"}))
    return r.select("event_id", "event_type", "confidence", "polarity", "severity_score", "severity", F.array_join("countries", "|").alias("countries"))


def _answers(f):
    """Model answers as JSON text: percentages, bad types, bad JSON, missing
    severities all occur."""
    eid, k = F.col("eid"), F.col("k0")
    kind = F.when(eid % 7 == 0, "weather").when(eid % 3 == 0, "corporate_strategic").otherwise(dims.TENSION)
    conf = F.when(eid % 5 == 0, k.cast("string")).otherwise((k / F.lit(100.0)).cast("string"))
    body = F.concat(F.lit('{"event_type": "'), kind, F.lit('", "confidence": '), conf, F.lit(', "severity_score": '),
                    (k / F.lit(100.0)).cast("string"), F.when(eid % 2 == 0, F.concat(F.lit(', "severity": '), (k % 8).cast("string"))).otherwise(""),
                    F.lit(', "countries": ["NATION_1"]}'))
    return f.events.select("event_id", F.when(eid % 11 == 0, F.lit("not json")).otherwise(body).alias("answer"))


ANS = {"ans": """SELECT event_id, eid, CASE WHEN eid % 3 = 0 THEN 'corporate_strategic' ELSE 'geopolitical_military_tension' END AS event_type,
    k0 / 100e0 AS score, CASE WHEN eid % 5 = 0 THEN CASE WHEN k0 > 1 THEN k0 / 100e0 ELSE k0 * 1e0 END ELSE k0 / 100e0 END AS conf,
    CASE WHEN eid % 2 = 0 AND k0 % 8 BETWEEN 1 AND 5 THEN k0 % 8 ELSE greatest(1, least(5, CAST(round_even(k0 / 100e0 * 4e0, 0) AS INTEGER) + 1)) END AS sv
    FROM ev WHERE eid % 11 <> 0 AND eid % 7 <> 0""",
       "cand": """SELECT c.event_id, c.title FROM cat c WHERE label_source = 'gdelt_derived' AND event_type = 'geopolitical_military_tension'
    AND title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM led l WHERE l.event_id = c.event_id AND l.verdict = 'reject_stage2')""",
       "outc": """SELECT c.event_id, CASE WHEN CAST(c.event_id AS BIGINT) % 4 = 0 THEN 'reject_stage1' WHEN a.event_type = 'geopolitical_military_tension' AND a.conf >= 0.75e0 THEN 'confirm_stage2'
    WHEN a.event_id IS NOT NULL THEN 'reject_stage2' END AS verdict FROM cand c LEFT JOIN ans a USING (event_id)"""}


@query("T10_model_verdicts", "SELECT event_id, event_type, score AS severity_score, conf AS confidence, CAST(sv AS INTEGER) AS severity, event_type = 'geopolitical_military_tension' AND conf >= 0.75e0 AS accepted FROM ans", **ANS)
def t10(f):
    return L.fold_verdicts(_answers(f)).select("event_id", "event_type", "severity_score", "confidence", "severity", L.accepted().alias("accepted"))


def _candidates(f):
    # Rows without a final rejection count as unchecked here, so that the
    # gated catalog (confirmed rows only) still yields candidates.
    return L.recheck_candidates(f.catalog, f.ledger.where("verdict = 'reject_stage2'"))


@query("T11_recheck_candidates", "SELECT event_id, title FROM cand", **ANS)
def t11(f):
    return _candidates(f)


def _outcome(f):
    screen = F.when(F.col("event_id").cast("bigint") % 4 == 0, "reject").otherwise("uncertain")
    return L.recheck(_candidates(f).withColumn("screen", screen), L.fold_verdicts(_answers(f)))


@query("T12_recheck_outcome", "SELECT event_id, verdict FROM outc", **ANS)
def t12(f):
    return _outcome(f).select("event_id", "verdict")


@query("T12_recheck_outputs", """SELECT 'label' AS kind, event_id FROM outc WHERE verdict = 'confirm_stage2' UNION ALL
    SELECT 'delete', event_id FROM outc WHERE verdict LIKE 'reject%' UNION ALL SELECT 'ledger', event_id FROM outc WHERE verdict IS NOT NULL""", **ANS)
def t12b(f):
    new, delete, checked = L.recheck_outputs(_outcome(f), L.fold_verdicts(_answers(f)))
    tag = lambda k, d: d.select(F.lit(k).alias("kind"), "event_id")
    return tag("label", new).unionByName(tag("delete", delete)).unionByName(tag("ledger", checked))


@query("T13_incremental_labels", """SELECT r.id AS event_id FROM rawev r WHERE source = 'rss' AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.event_id = r.id AND l.label_source = 'rule_based')
    AND NOT EXISTS (SELECT 1 FROM led g WHERE g.event_id = r.id AND g.verdict = 'reject_stage2')""")
def t13(f):
    rows = L.unlabelled(f.raw, f.labels, "rss", "rule_based", f.ledger.where("verdict = 'reject_stage2'"))
    return L.label_by_rules(rows, D).select("event_id")


@query("T14_label_checks", """SELECT event_id, CASE WHEN eid % 10 = 1 THEN 'unknown label source' WHEN eid % 10 = 2 THEN 'unknown event type' WHEN eid % 10 = 3 THEN 'severity out of range' END AS problem FROM lab""")
def t14(f):
    m = F.col("eid") % 10
    r = f.labels.select("event_id", F.when(m == 1, "guess").otherwise(F.col("label_source")).alias("label_source"),
                        F.when(m == 2, "rumour").otherwise(F.col("event_type")).alias("event_type"),
                        F.when(m == 3, 9).otherwise(F.col("severity")).alias("severity"))
    return r.select("event_id", L.label_problem().alias("problem"))


assert math.isclose(L.GOLDSTEIN_WEIGHT + L.MENTIONS_WEIGHT, 1.0)
