"""Read queries and the joins behind them."""

from datetime import date

from pyspark.sql import functions as F

from tremor.operators import graph as G
from tremor.operators import scoring as SC
from tremor.operators import views as V
from tremor.plans import fixtures as FX
from tremor.plans.q_scoring import INST, P, SCRAPED, _event_reach, instant, path_text, r9, scraped
from tremor.plans.registry import query
from tremor.session import materialize
from tremor.sources import bars as B


@query("J11_attribution_catalog", "SELECT a.ticker, a.date, a.rank, a.event_id, c.title, CASE WHEN c.published_at < TIMESTAMP '2024-01-15 00:00:00' THEN 'story ' || a.event_id END AS narrative FROM att a JOIN cat c ON c.event_id = a.event_id AND c.label_source = a.label_source")
def j11(f):
    stories = f.events.where(F.col("published_at") < "2024-01-15").select("event_id", F.concat(F.lit("story "), F.col("event_id")).alias("narrative"))
    return V.with_narratives(f.attribution, f.catalog, stories).select("ticker", "date", "rank", "event_id", "title", "narrative")


@query("J12_attributed_catalog", "SELECT c.event_id, c.event_type, a.corridor FROM cat c JOIN (SELECT event_id, min(ck) AS corridor FROM att GROUP BY event_id) a USING (event_id)")
def j12(f):
    return f.catalog.join(V.event_corridors(f.attribution), "event_id").select("event_id", "event_type", "corridor")


@query("J13_path_edges", "SELECT h.ticker, e.src, e.dst, e.channel, count(*) AS n FROM (SELECT *, unnest(range(1, len(path))) AS i FROM att) h JOIN edg e ON e.src = h.path[h.i] AND e.dst = h.path[h.i + 1] GROUP BY ALL")
def j13(f):
    e = G.path_edges(f.attribution, f.edges, ["ticker"])
    return e.groupBy("ticker", "src", "dst", "channel").agg(F.count("*").alias("n"))


IMP = {"evk": "SELECT event_id, ck || '#' || event_type AS ce, k FROM clu WHERE event_id IN (SELECT event_id FROM att) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ck, event_type, k) = 1",
       "evx": "SELECT v.event_id, c.stock AS ticker, c.imp, v.k * c.imp AS g, t.event_id IS NOT NULL AS ever_top FROM evk v JOIN cnp c ON c.ce = v.ce LEFT JOIN (SELECT DISTINCT event_id, ticker FROM att) t ON t.event_id = v.event_id AND t.ticker = c.stock"}


def impacts(f):
    e, cr = _event_reach(f)
    return V.event_impacts(e, cr.where("imp > 0"), f.attribution)


@query("J14_cross_stock_impact", "SELECT event_id, ticker, round(imp, 9) AS imp, round(g, 9) AS gross_contribution, ever_top FROM evx", **IMP)
def j14(f):
    # Paths are checked by the reach and attribution queries.
    return impacts(f).select("event_id", "ticker", r9("imp"), r9("gross_contribution"), "ever_top")


@query("J18_uncached_urls", "SELECT DISTINCT url FROM rawev WHERE url NOT IN (SELECT url FROM scr)", **SCRAPED)
def j18(f):
    return V.uncached_urls(f.raw, scraped(f))


@query("Q1_score_history", "SELECT ticker, date, round(score, 8) AS score, n_clusters FROM dly WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def q1(f):
    rows = f.stored_scores.slice(span=("date", date(2024, 1, 5), date(2024, 1, 20)))
    return V.history(rows).select("ticker", "date", F.round("score", 8).alias("score"), "n_clusters")


@query("Q2_price_history", "SELECT ticker, date, open, high, low, close, volume FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS newest FROM bars) WHERE date >= newest - 730")
def q2(f):
    return V.last_days(f.stored_bars.read()).select("ticker", "date", "open", "high", "low", "close", "volume")


@query("Q3_new_event_dates", "SELECT ticker, date, event_id, event_type, label_source, ck AS corridor FROM att WHERE rank = 1 AND days_since = 0")
def q3(f):
    return V.new_event_dates(f.attribution)


@query("Q4_attribution_latest", f"SELECT ticker, date, rank, event_id, {P} AS path, round(contribution, 9) AS contribution FROM att WHERE date = (SELECT max(date) FROM dly)")
def q4(f):
    return V.at_latest(f.attribution, f.daily).select("ticker", "date", "rank", "event_id", path_text().alias("path"), r9("contribution"))


@query("Q5_recent_events", "SELECT c.event_id, c.event_type, c.label_source, c.title, a.corridor, epoch_us(c.published_at) AS published_us FROM cat c JOIN (SELECT event_id, min(ck) AS corridor FROM att GROUP BY event_id) a USING (event_id) WHERE c.published_at >= TIMESTAMP '2024-01-03 00:00:00' AND c.published_at < TIMESTAMP '2024-01-21 00:00:00' ORDER BY c.published_at DESC, c.event_id LIMIT 50")
def q5(f):
    r = V.recent_events(f.catalog, f.attribution, F.lit("2024-01-03").cast("timestamp"), FX.day("2024-01-20"), 50)
    return r.select("event_id", "event_type", "label_source", "title", "corridor", F.unix_micros("published_at").alias("published_us"))


@query("Q6_event_detail", "SELECT c.event_id, c.label_source, c.severity_score, c.url, c.title, count(*) AS n_stocks, count(*) FILTER (x.ever_top) AS n_top, round(max(x.g), 9) AS max_gross FROM cat c JOIN evx x USING (event_id) GROUP BY ALL", **IMP)
def q6(f):
    per = impacts(f).groupBy("event_id").agg(F.count("*").alias("n_stocks"), F.count_if("ever_top").alias("n_top"), r9(F.max("gross_contribution"), "max_gross"))
    return f.catalog.select("event_id", "label_source", "severity_score", "url", "title").join(per, "event_id")


@query("Q7_latest_prediction", "SELECT ticker, variant, label_date, prior_date, round(predicted, 6) AS predicted FROM prd QUALIFY row_number() OVER (PARTITION BY ticker, variant ORDER BY label_date DESC) = 1")
def q7(f):
    r = V.latest_by(f.predictions, ["ticker", "variant"], "label_date")
    return r.select("ticker", "variant", "label_date", "prior_date", F.round("predicted", 6).alias("predicted"))


@query("Q7_prediction_history", "SELECT ticker, variant, label_date, round(actual, 6) AS actual, round(predicted, 6) AS predicted FROM prd")
def q7h(f):
    r = f.predictions.orderBy("ticker", "variant", "label_date")
    return r.select("ticker", "variant", "label_date", F.round("actual", 6).alias("actual"), F.round("predicted", 6).alias("predicted"))


@query("Q8_latest_forecast", "SELECT ticker, as_of_date, horizon_step, target_date, point_price, hi_price FROM fcs QUALIFY as_of_date = max(as_of_date) OVER (PARTITION BY ticker, variant)")
def q8(f):
    return V.latest_vintage(f.forecasts).select("ticker", "as_of_date", "horizon_step", "target_date", "point_price", "hi_price")


@query("Q9_future_forecast", "SELECT ticker, as_of_date, horizon_step, target_date FROM fcs JOIN (SELECT ticker, max(date) AS last FROM bars GROUP BY ticker) USING (ticker) WHERE target_date > last")
def q9(f):
    return V.after_last_bar(f.forecasts, f.bars).select("ticker", "as_of_date", "horizon_step", "target_date")


@query("Q10_most_recent", "SELECT event_id, epoch_us(published_at) AS published_us FROM ev ORDER BY published_at DESC, event_id DESC LIMIT 25")
def q10(f):
    return V.most_recent(f.events, ["published_at", "event_id"], 25).select("event_id", F.unix_micros("published_at").alias("published_us"))


@query("Q11_sector_listing", "SELECT sector, string_agg(ticker, '|' ORDER BY ticker) AS tickers FROM (SELECT DISTINCT seg AS sector, stock AS ticker FROM rev) GROUP BY sector")
def q11(f):
    return V.sector_listing(f.revenue.select(F.col("seg").alias("sector"), F.col("stock").alias("ticker")))


SEGS = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE"]


@query("Q12_sector_order", "SELECT sector, ticker, round(total, 2) AS total, CAST(list_position(['" + "', '".join(SEGS) + "'], sector) AS BIGINT) AS sector_ord, row_number() OVER (ORDER BY list_position(['" + "', '".join(SEGS) + "'], sector), total DESC, ticker) AS pos FROM (SELECT seg AS sector, stock AS ticker, CAST(sum(rev) AS DOUBLE) AS total FROM rev GROUP BY ALL)")
def q12(f):
    from pyspark.sql import Window

    t = f.revenue.groupBy(F.col("seg").alias("sector"), F.col("stock").alias("ticker")).agg(F.sum("rev").cast("double").alias("total"))
    r = V.by_sector_order(t, SEGS, "total")
    # sectors x stocks rows: the order is checked by numbering it
    w = Window.partitionBy(F.lit(1)).orderBy("sector_ord", F.col("total").desc(), "ticker")
    return r.select("sector", "ticker", F.round("total", 2).alias("total"), "sector_ord", F.row_number().over(w).cast("bigint").alias("pos"))


@query("Q13_report_with_scope", "SELECT 'all_tickers' AS scope, variant, count(*) AS n, round(avg(actual), 6) AS mean_actual FROM prd WHERE variant = 'baseline' GROUP BY variant")
def q13(f):
    reports = materialize(f.predictions.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("actual"), 6).alias("mean_actual")), "reports")
    return V.stored_report(reports, "baseline", "all_tickers")


@query("Q14_instant_top", "SELECT ticker, event_id, round(c, 9) AS contribution, CAST(row_number() OVER (PARTITION BY ticker ORDER BY c DESC, cluster_date DESC, event_id) AS INTEGER) AS rank FROM ico QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY c DESC, cluster_date DESC, event_id) <= 3", **INST)
def q14(f):
    return SC.instant_top(instant(f)).select("ticker", "event_id", r9("contribution"), "rank")


@query("Q15_batch_cap", "SELECT id FROM rawev WHERE source = 'gdelt' AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.event_id = rawev.id AND l.label_source = 'gdelt_derived') ORDER BY published_at, id LIMIT 100")
def q15(f):
    from tremor.operators import labels as L

    return L.unlabelled(f.raw, f.labels, "gdelt", "gdelt_derived").orderBy("published_at", "id").limit(100).select("id")


@query("V13_price_ticker_tape", "SELECT ticker, date, close, prior AS prior_close, round((close - prior) / prior * 100, 6) AS pct, CASE WHEN prior IS NULL THEN '' WHEN close >= prior THEN 'yes' ELSE 'no' END AS direction FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prior FROM bars) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1")
def v13b(f):
    d = V.deltas(B.latest_bars(f.stored_bars.read()))
    return d.withColumn("pct", F.round("pct", 6))

