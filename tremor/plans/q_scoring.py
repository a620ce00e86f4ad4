"""Joins, graph propagation, scores and aggregates."""

from pyspark.sql import functions as F

from tremor import dims
from tremor.operators import features as FE
from tremor.operators import graph as G
from tremor.operators import labels as L
from tremor.operators import scoring as SC
from tremor.operators import views as V
from tremor.plans import fixtures as FX
from tremor.plans.registry import query

P = "array_to_string(path, '>')"


def path_text(c="path"):
    return F.array_join(c, ">")


def r9(c, name=None):
    return F.round(c, 9).alias(name or c)


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


# -- joins -------------------------------------------------------------------
@query("J1_labels_join_events", "SELECT l.event_id, l.label_source, l.event_type, epoch_us(r.published_at) AS published_us FROM lab l JOIN rawev r ON r.id = l.event_id WHERE l.event_type <> 'unclassified' AND l.label_source IN ('manual', 'rule_based') AND r.published_at >= TIMESTAMP '2024-01-10 00:00:00'")
def j1(f):
    rows = L.scorable(f.labels.drop("published_at"), f.raw, None, ["manual", "rule_based"], F.lit("2024-01-10").cast("timestamp"))
    return rows.select("event_id", "label_source", "event_type", F.unix_micros("published_at").alias("published_us"))


@query("J2_default_deny_gate", "SELECT event_id, label_source, event_type FROM scorable")
def j2(f):
    return f.scorable.select("event_id", "label_source", "event_type")


@query("J3_unlabelled_anti", "SELECT r.id FROM rawev r WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.event_id = r.id AND l.label_source = 'manual') AND r.source = 'rss'")
def j3(f):
    return L.unlabelled(f.raw, f.labels, "rss", "manual").select("id")


@query("J4_not_in_ledger", "SELECT event_id FROM lab WHERE event_id NOT IN (SELECT event_id FROM led) AND event_type <> 'unclassified'")
def j4(f):
    return V.not_in(f.labels.where("event_type <> 'unclassified'"), f.ledger, "event_id").select("event_id")


SCRAPED = {"scr": "SELECT 'http://example.com/' || i AS url, CASE WHEN i % 3 <> 0 THEN 'page ' || i END AS title, CASE WHEN i % 3 <> 0 THEN 'ok' ELSE 'no_title' END AS status FROM (SELECT DISTINCT eid % 997 AS i FROM ev WHERE d < DATE '2024-01-03')"}


def scraped(f):
    i = f.events.where(F.col("published_at") < "2024-01-03").select((F.col("eid") % 997).alias("i")).distinct()
    ok = F.col("i") % 3 != 0
    return i.select(F.concat(F.lit("http://example.com/"), F.col("i").cast("string")).alias("url"),
                    F.when(ok, F.concat(F.lit("page "), F.col("i").cast("string"))).alias("title"),
                    F.when(ok, "ok").otherwise("no_title").alias("status"))


@query("J5_lookup_by_id", "SELECT c.event_id, c.label_source, r.url, r.title FROM clu c LEFT JOIN rawev r ON r.id = c.event_id")
def j5(f):
    return V.lookup(f.clusters.select("event_id", "label_source"), f.raw, "event_id", "id", ["url", "title"])


@query("J6_title_fallback", "SELECT c.event_id, r.url, coalesce(r.title, s.title) AS title FROM (SELECT DISTINCT event_id FROM clu) c LEFT JOIN rawev r ON r.id = c.event_id LEFT JOIN scr s ON s.url = r.url AND s.status = 'ok'", **SCRAPED)
def j6(f):
    return V.with_titles(f.clusters.select("event_id").distinct(), f.raw, scraped(f)).select("event_id", "url", "title")


@query("J7_cluster_impact", f"SELECT cluster_date, event_type, ck AS corridor, stock AS ticker, round(imp, 9) AS imp, {P} AS path FROM clu JOIN cre USING (ck, event_type)")
def j7(f):
    return f.cluster_reach.select("cluster_date", "event_type", F.col("corridor_key").alias("corridor"), "ticker", r9("imp"), path_text().alias("path"))


@query("J8_day_expansion", "SELECT date, days_since, round(tau, 9) AS tau, count(*) AS n FROM con GROUP BY date, days_since, round(tau, 9)")
def j8(f):
    return f.contributions.groupBy("date", "days_since", r9("tau")).agg(F.count("*").alias("n"))


@query("J9_asof_scores", "SELECT ticker, date, round(score, 9) AS score, score_source_date FROM jnd")
def j9(f):
    return FE.asof_scores(f.bars.select("ticker", "date"), f.score_days).select("ticker", "date", r9("score"), "score_source_date")


PROJ = {"req": "SELECT ticker, date AS as_of, CAST(date + CAST(j AS INTEGER) AS DATE) AS target FROM cal CROSS JOIN range(1, 31) b(j)",
        "exp": "SELECT cre.stock AS ticker, cluster_date, CAST(cluster_date + CAST(a AS INTEGER) AS DATE) AS target, k * imp * pow(0.5e0, a / 5e0) AS c FROM clu JOIN cre USING (ck, event_type) CROSS JOIN range(0, 34) t(a)",
        "exq": "SELECT ticker, target, cluster_date, product(1 - c) AS p FROM exp GROUP BY ALL",
        "prj": "SELECT r.ticker, as_of, r.target, 1 - coalesce(product(p), 1e0) AS score FROM req r LEFT JOIN exq e ON e.ticker = r.ticker AND e.target = r.target AND e.cluster_date <= r.as_of GROUP BY ALL"}
HORIZON = 30


def requests(f):
    """Every stock at every day of the span, for each of the next 30 days."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))
    return SC.calendar(f.stocks, *f.span).select("ticker", F.col("date").alias("as_of"), ahead.alias("j")).select(
        "ticker", "as_of", F.date_add("as_of", F.col("j")).alias("target"))


def projected(f):
    return SC.projected_scores(f.cluster_reach, requests(f), f.span[0], F.date_add(f.span[1], HORIZON))


@query("J10_projected_scores", "SELECT ticker, as_of, target, round(score, 8) AS score FROM prj", **PROJ)
def j10(f):
    return projected(f).select("ticker", "as_of", "target", F.round("score", 8).alias("score"))


# -- graph -------------------------------------------------------------------
@query("G1_graph_paths", f"SELECT country, stock, channel, round(w, 9) AS weight, {P} AS path FROM pth")
def g1(f):
    return G.paths(f.edges, f.nodes).select("country", "stock", "channel", r9("weight"), path_text().alias("path"))


@query("G2_reach_table", f"SELECT country, event_type, stock, round(imp, 9) AS imp, {P} AS path FROM rch")
def g2(f):
    return f.reach.select("country", "event_type", "stock", r9("imp"), path_text().alias("path"))


@query("G2_reach_three_hops", f"SELECT country, event_type, stock, round(imp, 9) AS imp, {P} AS path FROM rch WHERE imp > 0")
def g2_three(f):
    """Three hops by the pruned frontier; these graphs end after two."""
    r = G.reach(f.edges, f.nodes, f.activation, 3).where("imp > 0")
    return r.select("country", "event_type", "stock", r9("imp"), path_text().alias("path"))


@query("G3_ranked_stocks", "SELECT country, event_type, stock, round(imp, 9) AS imp, row_number() OVER (PARTITION BY country, event_type ORDER BY imp DESC, stock) AS rank FROM rch")
def g3(f):
    return G.ranked_stocks(f.reach).select("country", "event_type", "stock", r9("imp"), "rank")


@query("G4_bad_queries", """SELECT DISTINCT CASE WHEN user_id % 25 = 0 THEN 'Atlantis' ELSE actor1 END AS country, CASE WHEN raw_type = 'view' THEN 'gossip' ELSE 'natural_disaster' END AS event_type,
    CASE WHEN raw_type = 'view' THEN 'unknown event type' ELSE 'not a country' END AS problem FROM ev WHERE user_id % 25 = 0 OR raw_type = 'view'""")
def g4(f):
    q = f.events.select(F.when(F.col("user_id") % 25 == 0, "Atlantis").otherwise(F.col("actor1")).alias("country"),
                        F.when(F.col("raw_type") == "view", "gossip").otherwise("natural_disaster").alias("event_type")).distinct()
    return G.bad_queries(q, f.nodes, f.activation)


@query("G5_edges_by_pair", "SELECT src, dst, count(*) AS n_edges, string_agg(coalesce(channel, '-'), '|' ORDER BY coalesce(channel, '-')) AS channels, max(weight) AS max_weight FROM edg GROUP BY src, dst")
def g5(f):
    return G.edges_by_pair(f.edges)


SCEN = {"sce": "SELECT DISTINCT user_id AS scenario_id, 'natural_disaster' AS event_type, [actor1, actor2] AS countries, 0.7e0 AS severity, (user_id % 10) / 10e0 AS confidence FROM ev",
        "scb": "SELECT scenario_id, severity, confidence, stock, imp, path FROM (SELECT scenario_id, event_type, severity, confidence, unnest(list_distinct(countries)) AS country FROM sce) JOIN rch USING (country, event_type) QUALIFY row_number() OVER (PARTITION BY scenario_id, stock ORDER BY imp DESC, len(path), path) = 1"}


@query("G6_what_if", f"SELECT scenario_id, stock, round(imp, 9) AS imp, {P} AS path, round(severity * confidence * imp, 9) AS contribution FROM scb", **SCEN)
def g6(f):
    s = f.events.select(F.col("user_id").alias("scenario_id"), F.lit("natural_disaster").alias("event_type"), F.array("actor1", "actor2").alias("countries"),
                        F.lit(0.7).alias("severity"), ((F.col("user_id") % 10) / F.lit(10.0)).alias("confidence")).distinct()
    return G.simulate(s, f.reach).select("scenario_id", "stock", r9("imp"), path_text().alias("path"), r9("contribution"))


HOPS = {"hps": "SELECT a.*, unnest(range(1, len(path))) AS i FROM att a"}


@query("G7_causal_edges", "SELECT DISTINCT h.ticker, h.date, e.src, e.dst, e.channel, e.weight, coalesce(e.channel, 'beta') || ' share' AS note FROM hps h JOIN edg e ON e.src = h.path[h.i] AND e.dst = h.path[h.i + 1]", **HOPS)
def g7(f):
    return G.causal_edges(f.attribution, f.edges, ["ticker", "date"])


@query("G7_causal_nodes", "SELECT DISTINCT ticker, date, name, n.node_type, name = ticker AS is_focus FROM (SELECT ticker, date, unnest(path) AS name FROM att) JOIN nod n USING (name)")
def g7n(f):
    return G.causal_nodes(f.attribution, f.nodes, ["ticker", "date"], "ticker").select("ticker", "date", "name", "node_type", "is_focus")


@query("G8_flow_links", "SELECT path[1] AS origin, CASE WHEN len(path) > 2 THEN path[2] END AS mid, path[-1] AS dest, count(*) AS n, round(max(contribution), 9) AS weight FROM att GROUP BY ALL")
def g8(f):
    links = G.flow_links(f.attribution.withColumn("weight", F.col("contribution")), [])
    return links.groupBy("origin", "mid", "dest").agg(F.count("*").alias("n"), r9(F.max("weight"), "weight"))


GROUND = {"evr": """SELECT ck || '#' || event_type AS event_id, stock, path FROM cre QUALIFY row_number() OVER (PARTITION BY ck, event_type ORDER BY imp DESC, stock, path) = 1""",
          "gnt": """SELECT event_id, stock, note, min(row(i, ch)) AS pos_ FROM (SELECT v.event_id, v.stock, i, coalesce(channel, '') AS ch, coalesce(channel, 'beta') || ' share' AS note
    FROM (SELECT *, unnest(range(1, len(path))) AS i FROM evr) v JOIN edg e ON e.src = v.path[v.i] AND e.dst = v.path[v.i + 1]) GROUP BY ALL"""}


def _event_reach(f):
    e = V.attributed_events(f.attribution)
    cr = G.corridor_reach(e.select("corridor_key", "corridor", "event_type").dropDuplicates(["corridor_key", "event_type"]), f.reach)
    return e, cr


@query("G9_grounding_facts", "SELECT event_id, stock, array_to_string(list_slice(list(note ORDER BY pos_), 1, 3), '; ') AS notes FROM gnt GROUP BY event_id, stock", **GROUND)
def g9(f):
    """Facts depend on corridor and type only, so one case per pair."""
    cr = G.corridor_reach(f.clusters.select("corridor_key", "corridor", "event_type").dropDuplicates(["corridor_key", "event_type"]), f.reach)
    cases = cr.where("imp > 0").select(F.concat("corridor_key", F.lit("#"), "event_type").alias("event_id"), "stock", "imp", "path")
    return G.grounding(cases, f.edges).select("event_id", "stock", F.array_join("notes", "; ").alias("notes"))


@query("G10_tied_impacts", "SELECT country, event_type, round(imp, 4) AS imp, count(*) AS n_stocks FROM rch GROUP BY country, event_type, round(imp, 4) HAVING count(*) > 1")
def g10(f):
    return G.tied_impacts(f.reach, 4)


# -- scores ------------------------------------------------------------------
AT = "TIMESTAMP '2024-01-20 12:00:00'"
INST = {"ins": f"SELECT *, (epoch_us({AT}) - epoch_us(published_at)) / 86400e6 AS age FROM kev WHERE published_at <= {AT}",
        "int0": "SELECT *, pow(0.5e0, age / 5e0) AS tau FROM ins WHERE pow(0.5e0, age / 5e0) >= 0.01e0",
        "icl": "SELECT *, d AS cluster_date FROM int0 WHERE k * tau > 0 QUALIFY row_number() OVER (PARTITION BY d, event_type, ck ORDER BY k * tau DESC, event_id, label_source) = 1",
        "icr": "SELECT ck, event_type, stock, imp, path FROM (SELECT ck, event_type, unnest(corridor) AS country FROM (SELECT DISTINCT ck, event_type, corridor FROM icl)) x JOIN rch USING (country, event_type) WHERE imp > 0 QUALIFY row_number() OVER (PARTITION BY ck, event_type, stock ORDER BY imp DESC, len(path), path) = 1",
        "ico": "SELECT stock AS ticker, icl.*, imp, k * imp * tau AS c FROM icl JOIN icr USING (ck, event_type)"}


def at():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


def instant(f):
    return SC.instant_contributions(f.scorable, FX.NATIONS, f.reach, at())


@query("A1_event_contribution", "SELECT event_id, label_source, round(age, 6) AS age, round(tau, 9) AS tau, round(k * tau, 9) AS k_tau FROM int0", **INST)
def a1(f):
    r = SC.instant_events(f.scorable, FX.NATIONS, at())
    return r.select("event_id", "label_source", r6("age"), r9("tau"), r9(F.col("k") * F.col("tau"), "k_tau"))


@query("A2_instant_score", "SELECT ticker, round(1 - product(1 - c), 8) AS score, round(sum(c * polarity) / sum(c) FILTER (polarity IS NOT NULL), 8) AS direction, round(sum(c) FILTER (polarity IS NOT NULL) / sum(c), 8) AS direction_coverage, count(*) AS n_clusters FROM ico GROUP BY ticker", **INST)
def a2(f):
    s = SC.instant_scores(instant(f), f.stocks)
    return s.select("ticker", *[F.round(c, 8).alias(c) for c in ("score", "direction", "direction_coverage")], "n_clusters")


@query("A3_instant_many", "SELECT count(*) AS n_stocks, round(avg(s), 8) AS mean_score FROM (SELECT ticker, 1 - product(1 - c) AS s FROM ico GROUP BY ticker)", **INST)
def a3(f):
    return SC.instant_scores(instant(f), f.stocks).agg(F.count("*").alias("n_stocks"), F.round(F.avg("score"), 8).alias("mean_score"))


@query("A4_build_clusters", "SELECT cluster_date, event_type, ck AS corridor, round(k, 9) AS k, event_id, label_source, polarity FROM clu")
def a4(f):
    return f.clusters.select("cluster_date", "event_type", F.col("corridor_key").alias("corridor"), r9("k"), "event_id", "label_source", "polarity")


@query("A5_daily_scores", "SELECT ticker, date, round(score, 8) AS score, round(direction, 8) AS direction, round(direction_coverage, 8) AS direction_coverage, n_clusters FROM dly")
def a5(f):
    return f.daily.select("ticker", "date", *[F.round(c, 8).alias(c) for c in ("score", "direction", "direction_coverage")], "n_clusters")


@query("A6_direction", "SELECT ticker, date, round(sum(contribution * polarity) / sum(contribution), 8) AS direction FROM con WHERE polarity IS NOT NULL GROUP BY ALL")
def a6(f):
    return f.daily.where("direction is not null").select("ticker", "date", F.round("direction", 8).alias("direction"))


@query("A7_direction_coverage", "SELECT date, round(avg(direction_coverage), 8) AS mean_coverage FROM dly GROUP BY date")
def a7(f):
    return f.daily.groupBy("date").agg(F.round(F.avg("direction_coverage"), 8).alias("mean_coverage"))


@query("A8_cluster_counts", "SELECT ticker, date, n_clusters FROM dly")
def a8(f):
    return f.daily.select("ticker", "date", "n_clusters")


@query("A9_attribution", f"SELECT ticker, date, rank, event_id, label_source, event_type, ck AS corridor, {P} AS path, cluster_date, round(contribution, 9) AS contribution, round(tau, 9) AS tau, days_since FROM att")
def a9(f):
    return f.attribution.select("ticker", "date", "rank", "event_id", "label_source", "event_type", G.corridor_key("corridor").alias("corridor"),
                                path_text().alias("path"), "cluster_date", r9("contribution"), r9("tau"), "days_since")


@query("A10_event_catalog", "SELECT DISTINCT event_id, label_source, event_type, severity_score, round(confidence, 9) AS confidence, polarity, array_to_string(countries, '|') AS countries, epoch_us(published_at) AS published_us FROM clu")
def a10(f):
    return SC.event_catalog(f.clusters).select("event_id", "label_source", "event_type", "severity_score", r9("confidence"), "polarity",
                                               F.array_join("countries", "|").alias("countries"), F.unix_micros("published_at").alias("published_us"))


@query("A11_series_stats", "SELECT ticker, round(avg(score), 8) AS mean_score, round(min(score), 8) AS min_score, round(max(score), 8) AS max_score, round(stddev_pop(score), 8) AS std_score FROM dly GROUP BY ticker")
def a11(f):
    return SC.series_stats(f.daily).select("ticker", *[F.round(c, 8).alias(c) for c in ("mean_score", "min_score", "max_score", "std_score")])


@query("A12_corpus_counts", "SELECT label_source, event_type, severity, count(*) AS n, count(*) FILTER (confidence < 0.3e0) AS n_low_confidence FROM lab GROUP BY GROUPING SETS ((label_source), (event_type), (severity), ())")
def a12(f):
    return L.corpus_counts(f.labels)


@query("A13_counts_by_source", "SELECT label_source, count(*) AS n FROM scorable GROUP BY label_source")
def a13(f):
    return V.counts_by(f.scorable, "label_source")


@query("A14_count_min_max", "SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker")
def a14(f):
    return V.coverage_by(f.bars, "ticker")


@query("A15_narrative_candidates", "SELECT a.event_id, c.title, c.event_type, a.corridor FROM (SELECT event_id, min(ck) AS corridor FROM att GROUP BY event_id) a JOIN cat c USING (event_id) WHERE c.published_at >= TIMESTAMP '2024-01-15 00:00:00'")
def a15(f):
    done = f.events.where(F.col("published_at") < "2024-01-15").select("event_id")
    return V.narrative_candidates(f.attribution, f.catalog, done)


@query("A16_freshness", "SELECT epoch_us(max(published_at)) AS latest_us FROM ev")
def a16(f):
    return V.freshness(f.events, "published_at").select(F.unix_micros("latest").alias("latest_us"))


@query("A18_review_sample", "SELECT l.event_id, r.title, r.url FROM lab l JOIN rawev r ON r.id = l.event_id WHERE l.label_source = 'rule_based' ORDER BY sha256(l.event_id || '|42') LIMIT 25")
def a18(f):
    return L.review_sample(f.labels, f.raw, "rule_based", 25).select("event_id", "title", "url")


@query("A19_dedup_ratio", "SELECT count(*) AS n_attempted, count(DISTINCT url) AS n_unique, round(count(*) / CAST(count(DISTINCT url) AS DOUBLE), 6) AS ratio FROM rawev")
def a19(f):
    return V.dedup_ratio(f.raw, "url").withColumn("ratio", F.round("ratio", 6))


assert dims.TOP_K == 5
