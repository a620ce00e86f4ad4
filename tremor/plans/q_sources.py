"""Sources, sinks and set operations."""

import uuid
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor import schemas as S
from tremor.functions import exprs as X
from tremor.functions import text as TX
from tremor.operators import features as FE
from tremor.operators import views as V
from tremor.plans import fixtures as FX
from tremor.plans import jobs
from tremor.plans.registry import query
from tremor.sources import bars as B
from tremor.sources import coded as C
from tremor.sources import feeds as FD
from tremor.sources import store as ST
from tremor.session import materialize, shared_dir

NOW = "2024-02-01 00:00:00"

# Export lines as SQL: the cells that matter, by the same rules.
CELLS = {
    "cell": """SELECT eid, eid % 11 <> 0 AS ok, CASE WHEN eid % 6 <> 0 THEN actor1 END AS a1, actor2 AS a2, quad, event_id AS gid,
        CASE WHEN eid % 13 <> 0 THEN goldstein END AS g, k0 AS mentions, published_at, d,
        eid % 17 <> 0 AS stamp_ok, CASE WHEN eid % 5 <> 0 THEN 'HTTP://Example.com/A/' || (eid % 97) || '/#x' END AS u FROM ev""",
    "scoped": """SELECT *, sha256('gdelt|' || coalesce('http://example.com/A/' || (eid % 97), gid)) AS hid0 FROM cell
        WHERE ok AND (a1 IN ('NATION_1', 'NATION_2', 'NATION_3') OR a2 IN ('NATION_1', 'NATION_2', 'NATION_3'))""",
    "ids": """SELECT *, CASE WHEN u IS NULL THEN sha256('gdelt|' || gid) ELSE hid0 END AS hid FROM scoped""",
}
CODES = ["NATION_1", "NATION_2", "NATION_3"]


def live(f):
    return f.coded_lines(C.LIVE.width, C.LIVE.place, C.LIVE.added, C.LIVE.url, daily=False)


def daily(f):
    return f.coded_lines(C.DAILY.width, C.DAILY.place, C.DAILY.added, C.DAILY.url, daily=True)


@query("S1_scan_live_layout", "SELECT count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_malformed FROM cell", **CELLS)
def s1(f):
    return C.malformed_count(live(f), C.LIVE)


@query("S2_scan_daily_layout", """SELECT hid AS id, gid AS source_id, strftime(d, '%Y-%m-%d') AS published,
    CASE WHEN stamp_ok THEN NULL ELSE 'file_date' END AS fallback FROM ids""", **CELLS)
def s2(f):
    r = C.to_raw_events(daily(f), C.DAILY, F.lit(NOW), codes=CODES)
    return r.select("id", "source_id", F.date_format("published_at", "yyyy-MM-dd").alias("published"),
                    F.col("published_at_fallback").alias("fallback"))


@query("S3_typed_projection", """SELECT eid, gid, a1 AS actor1, a2 AS actor2, quad, round(g, 4) AS goldstein, mentions,
    CAST(-1.5e0 AS DOUBLE) AS tone, CAST(NULL AS VARCHAR) AS actor2_code, 'Name' AS actor1_name FROM cell WHERE ok""", **CELLS)
def s3(f):
    rows = C.split_columns(live(f), C.LIVE).where("well_formed")
    t = C.typed_columns(C.LIVE)
    return rows.select(
        "eid", t["GLOBALEVENTID"].alias("gid"), t["Actor1CountryCode"].alias("actor1"), t["Actor2CountryCode"].alias("actor2"),
        t["QuadClass"].alias("quad"), F.round(t["GoldsteinScale"], 4).alias("goldstein"), t["NumMentions"].alias("mentions"),
        t["AvgTone"].alias("tone"), t["Actor2Code"].alias("actor2_code"), t["Actor1Name"].alias("actor1_name"))


@query("S4_stamp_parse", """SELECT hid AS id, epoch_us(date_trunc('second', published_at)) AS published_us FROM ids WHERE stamp_ok""", **CELLS)
def s4(f):
    r = C.to_raw_events(live(f), C.LIVE, F.lit(NOW), codes=CODES)
    return r.select("id", F.unix_micros("published_at").alias("published_us"))


@query("S5_scope_filter", "SELECT actor1, actor2, count(*) AS n FROM ev WHERE actor1 IN ('NATION_1','NATION_2','NATION_3') OR actor2 IN ('NATION_1','NATION_2','NATION_3') GROUP BY ALL")
def s5(f):
    rows = f.events.where(C.in_scope(F.col("actor1"), F.col("actor2"), CODES))
    return rows.groupBy("actor1", "actor2").agg(F.count("*").alias("n"))


def feed_rows(f):
    eid = F.col("eid")
    items = f.events.select(
        F.when(eid % 4 != 0, F.concat(F.lit("http://Feed.example/"), F.col("event_id"))).alias("link"),
        F.concat(F.lit("g"), F.col("event_id")).alias("guid"), F.lit("t").alias("title"),
        F.when(eid % 2 == 0, F.concat(F.lit("sum "), F.col("raw_type"))).otherwise(F.lit("")).alias("summary"),
        F.lit("desc").alias("description"), F.lit(None).cast("string").alias("author"),
        F.array(F.concat(F.lit("tag"), (eid % 5).cast("string")), F.lit("")).alias("category"),
        F.when(eid % 3 == 0, F.concat(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(eid % 3 == 1, F.lit("yesterday")).alias("pubDate"),
        F.when(eid % 3 == 1, F.date_format(F.col("published_at") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"))
    return FD.feed_to_raw_events(items, "fixture", F.lit(NOW).cast("timestamp"), feed_url="http://feed.example/rss")


@query("S6_feed_items", """SELECT sha256('rss|' || CASE WHEN eid % 4 <> 0 THEN 'http://feed.example/' || eid ELSE 'g' || eid END) AS id,
    epoch_us(CASE WHEN eid % 3 = 0 THEN date_trunc('second', published_at) WHEN eid % 3 = 1 THEN date_trunc('second', published_at) + INTERVAL 1 HOUR
      ELSE TIMESTAMP '2024-02-01 00:00:00' END) AS published_us,
    CASE WHEN eid % 3 = 1 THEN 'updated_parsed' WHEN eid % 3 = 2 THEN 'ingested_at' END AS fallback,
    CASE WHEN eid % 2 = 0 THEN 'sum ' || raw_type ELSE 'desc' END AS text, 'tag' || (eid % 5) AS tags FROM ev""")
def s6(f):
    r = feed_rows(f)
    return r.select("id", F.unix_micros("published_at").alias("published_us"), F.col("published_at_fallback").alias("fallback"),
                    "text", F.array_join("tags", ",").alias("tags"))


@query("S6_stored_metadata", """SELECT sha256('rss|' || CASE WHEN eid % 4 <> 0 THEN 'http://feed.example/' || eid ELSE 'g' || eid END) AS id,
    '{"feed_name":"fixture","feed_url":"http://feed.example/rss","author":null,"tags":["tag' || (eid % 5) || '"],"guid":"g' || eid || '"' ||
    CASE eid % 3 WHEN 0 THEN '' WHEN 1 THEN ',"published_at_fallback":"updated_parsed"' ELSE ',"published_at_fallback":"ingested_at"' END || '}' AS raw_metadata FROM ev""")
def s6_stored(f):
    """Feed rows through the ingest job into the stored table and back."""
    store = jobs.Store(f.spark, f"{shared_dir(f.spark)}/s6-{uuid.uuid4().hex}")
    out = jobs.ingest(store, {"rss": feed_rows(f)})
    assert out[0]["error"] is None, out
    return store.raw_events.read().select("id", "raw_metadata")


@query("S7_news_articles", """SELECT sha256('newsapi|http://news.example/a/' || eid || '?p=1') AS id,
    epoch_us(CASE WHEN eid % 4 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE date_trunc('second', published_at) END) AS published_us,
    CASE WHEN eid % 4 = 0 THEN 'ingested_at' END AS fallback, CASE WHEN eid % 2 = 0 THEN 'd' ELSE 'c' || raw_type END AS text
    FROM ev WHERE eid % 9 <> 0 AND eid % 10 <> 3""")
def s7(f):
    eid = F.col("eid")
    article = F.struct(
        F.struct(F.lit("x").alias("id"), F.lit("n").alias("name")).alias("source"), F.lit("a").alias("author"), F.lit("t").alias("title"),
        F.when(eid % 2 == 0, F.lit("d")).alias("description"),
        F.when(eid % 9 != 0, F.concat(F.lit("http://news.example/a/"), F.col("event_id"), F.lit("?p=1#top"))).alias("url"),
        F.when(eid % 4 != 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("publishedAt"),
        F.concat(F.lit("c"), F.col("raw_type")).alias("content"))
    body = F.to_json(F.struct(F.when(eid % 10 == 3, "error").otherwise("ok").alias("status"), F.array(article).alias("articles")))
    payloads = f.events.select(F.from_json(body, S.NEWS_PAYLOAD).alias("p")).select("p.*")
    r = FD.news_to_raw_events(payloads, F.lit(NOW).cast("timestamp"))
    return r.select("id", F.unix_micros("published_at").alias("published_us"), F.col("published_at_fallback").alias("fallback"), "text")


@query("S8_search_string_filter", """SELECT doc_id FROM documents WHERE
    regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(the|des|intel)($|[^\\p{L}\\p{N}_])')""")
def s8(f):
    return FD.mentions_any(f.table("documents"), "text", ["The", "des", "Intel"]).select("doc_id")


BAR_FEED = {
    "feed": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price, l_orderkey AS ok, l_linenumber AS ln,
        l_partkey AS pk, l_suppkey AS sk, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "valid": """SELECT * FROM feed WHERE q <> 7 AND pk % 50 <> 0
        QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY ok, ln, pk, sk, price, q) = 1""",
}


def bar_feed(f):
    """One candidate bar per line item: quantity 7 has low above open, every
    50th part has no close."""
    li = f.table("lineitem")
    p = f.table("part").select("p_partkey", "p_brand")
    x = F.col("l_extendedprice")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), x.alias("open"), (x * 1.5).alias("high"),
        F.when(F.col("l_quantity") == 7, x * 1.2).otherwise(x * 0.5).alias("low"),
        F.when(F.col("l_partkey") % 50 != 0, x).alias("close"), x.alias("adj_close"), F.col("l_quantity").cast("bigint").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("key"))


@query("S9_daily_bars_scan", "SELECT ticker, date, round(price, 4) AS open, round(price * 1.5e0, 4) AS high, CAST(q AS BIGINT) AS volume FROM valid", **BAR_FEED)
def s9(f):
    good, _ = B.scan_bars(bar_feed(f), ["key"])
    return good.select("ticker", "date", F.round("open", 4).alias("open"), F.round("high", 4).alias("high"), "volume")


@query("S10_table_scan", "SELECT ticker, date, adj_close, volume FROM bars WHERE date >= DATE '1998-01-01'")
def s10(f):
    rows = f.stored_bars.slice(span=("date", date(1998, 1, 1), None))
    return V.history(rows).select("ticker", "date", "adj_close", "volume")


@query("S11_unlabelled_scan", "SELECT id FROM rawev r WHERE source = 'gdelt' AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.event_id = r.id AND l.label_source = 'gdelt_derived')")
def s11(f):
    from tremor.operators import labels as L

    return L.unlabelled(f.raw, f.labels, "gdelt", "gdelt_derived").select("id")


@query("S12_json_columns", """SELECT eid, k0 AS k, CASE WHEN eid % 5 = 0 THEN 0 ELSE 2 END AS n_items FROM ev""")
def s12(f):
    bad = F.when(F.col("eid") % 5 == 0, F.lit("[oops")).otherwise(F.lit('["a","b"]'))
    e = f.table("events").select(F.col("event_id").alias("eid"), X.json_object("props", "k int").alias("p"))
    return e.select("eid", F.col("p.k").alias("k"), F.size(X.json_list(bad)).alias("n_items"))


@query("S13_page_titles", """SELECT url, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')), '') AS title,
    CASE WHEN regexp_extract(html, '<title>(.*?)</title>', 1) = '' THEN 'no_title' ELSE 'ok' END AS status FROM pages""")
def s13(f):
    return FD.page_titles(f.pages)


@query("S14_finite_numbers", """SELECT doc_id, CASE WHEN n_chars % 7 = 0 OR n_chars % 5 = 0 THEN NULL ELSE round(n_chars / 3e0, 4) END AS v,
    CASE WHEN n_chars % 7 = 0 OR n_chars % 5 = 0 THEN 1 ELSE 2 END AS n_kept FROM documents""")
def s14(f):
    n = F.col("n_chars")
    raw = F.when(n % 7 == 0, F.lit(float("nan"))).when(n % 5 == 0, F.lit(float("-inf"))).otherwise(n / F.lit(3.0))
    d = f.table("documents").select("doc_id", "n_chars").withColumn("raw", raw)
    arr = F.transform(F.array(F.col("raw"), F.lit(1.0)), X.finite_or_null)
    return d.select("doc_id", F.round(X.finite_or_null("raw"), 4).alias("v"), F.size(F.filter(arr, lambda x: x.isNotNull())).alias("n_kept"))


@query("S14_nested_report", """SELECT doc_id, CASE WHEN b1 THEN NULL ELSE n_chars / 3e0 END AS top, CASE WHEN b2 THEN NULL ELSE n_chars / 4e0 END AS inner_value,
    CAST((NOT b1)::INT + (NOT b2)::INT AS INTEGER) AS n_list, CASE WHEN b3 THEN NULL ELSE n_chars / 5e0 END AS mapped,
    CASE WHEN b1 THEN NULL ELSE n_chars / 6e0 END AS deep, lang FROM
    (SELECT *, n_chars % 7 = 0 AS b1, n_chars % 5 = 0 AS b2, n_chars % 3 = 0 AS b3 FROM documents)""")
def s14_nested(f):
    """A report with bad numbers in a field, a nested struct, an array, a map
    and a struct within an array."""
    n = F.col("n_chars")
    num = lambda k, by, bad: F.when(n % k == 0, F.lit(float(bad))).otherwise(n / F.lit(float(by)))
    report = f.table("documents").select(
        "doc_id", "lang", num(7, 3, "nan").alias("top"), F.struct(num(5, 4, "inf").alias("value"), F.col("lang").alias("name")).alias("inner"),
        F.array(num(7, 3, "nan"), num(5, 4, "-inf")).alias("list"), F.create_map(F.lit("m"), num(3, 5, "nan")).alias("map"),
        F.array(F.struct(F.map_from_arrays(F.array(F.lit("d")), F.array(num(7, 6, "inf"))).alias("x"))).alias("rows"))
    r = X.finite_rows(report)
    return r.select("doc_id", "top", F.col("inner.value").alias("inner_value"), F.size(F.array_compact("list")).alias("n_list"), F.col("map")["m"].alias("mapped"),
                    F.col("rows")[0]["x"]["d"].alias("deep"), F.col("inner.name").alias("lang"))


# -- write semantics: the merge of an old table and a batch -----------------
# Two overlapping pulls: days before the 20th are stored, days from the 10th
# on arrive, each row twice.
def _old(f):
    return f.events.where(F.col("published_at") < "2024-01-20").select("event_id", F.to_date("published_at").alias("d"), F.col("value").alias("v"))


def _batch(f):
    b = f.events.where(F.col("published_at") >= "2024-01-10").select("event_id", F.to_date("published_at").alias("d"), F.col("value").alias("v"))
    return b.select("event_id", "d", F.explode(F.array(F.col("v") + 1, F.col("v") + 2)).alias("v"))


OLD = "SELECT event_id, d, value AS v FROM ev WHERE d < DATE '2024-01-20'"
BATCH = "SELECT event_id, d, unnest([value + 1, value + 2]) AS v FROM ev WHERE d >= DATE '2024-01-10'"
MERGE = {"oldt": OLD, "bat": BATCH, "one": "SELECT event_id, d, min(v) AS v FROM bat GROUP BY ALL"}


@query("W1_insert_or_ignore", """SELECT event_id, d, round(v, 4) AS v FROM oldt UNION ALL
    SELECT event_id, d, round(v, 4) FROM one WHERE event_id NOT IN (SELECT event_id FROM oldt)""", **MERGE)
def w1(f):
    old = _old(f)
    new = ST.new_rows(old, _batch(f), ["event_id"], ["v"])
    return old.unionByName(new).select("event_id", "d", F.round("v", 4).alias("v"))


@query("W2_insert_or_replace", """SELECT event_id, d, round(v, 4) AS v FROM oldt WHERE event_id NOT IN (SELECT event_id FROM one)
    UNION ALL SELECT event_id, d, round(v, 4) FROM one""", **MERGE)
def w2(f):
    batch = ST.first_by(_batch(f), ["event_id"], ["v"])
    return ST.upsert(_old(f), batch, ["event_id"]).select("event_id", "d", F.round("v", 4).alias("v"))


@query("W3_replace_groups", """SELECT event_id, d, round(v, 4) AS v FROM oldt WHERE d NOT IN (SELECT d FROM bat WHERE day(d) % 2 = 0)
    UNION ALL SELECT event_id, d, round(v, 4) FROM bat WHERE day(d) % 2 = 0""", **MERGE)
def w3(f):
    batch = _batch(f).where(F.dayofmonth("d") % 2 == 0)
    return ST.replace_groups(_old(f), batch, ["d"]).select("event_id", "d", F.round("v", 4).alias("v"))


@query("W4_rebuild_window", """SELECT event_id, d, round(v, 4) AS v FROM oldt WHERE d < DATE '2024-01-16'
    UNION ALL SELECT event_id, d, round(v, 4) FROM one WHERE d >= DATE '2024-01-16'""", **MERGE)
def w4(f):
    since = FX.day("2024-01-16")
    batch = ST.first_by(_batch(f), ["event_id"], ["v"]).where(F.col("d") >= since)
    return ST.rebuild_window(_old(f), batch, "d", since).select("event_id", "d", F.round("v", 4).alias("v"))


@query("W5_scoped_delete", "SELECT event_id, label_source FROM lab WHERE NOT (label_source = 'gdelt_derived' AND EXISTS (SELECT 1 FROM led g WHERE g.event_id = lab.event_id AND g.verdict = 'reject_stage2'))")
def w5(f):
    deletes = f.ledger.where("verdict = 'reject_stage2'").select("event_id", F.lit("gdelt_derived").alias("label_source"))
    t = f.labels.select("event_id", "label_source")
    return ST.delete_rows(t, deletes, ["event_id", "label_source"])


@query("W6_run_summary", """SELECT raw_type AS src, CAST(count(*) * 2 AS BIGINT) AS attempted,
    count(*) FILTER (d >= DATE '2024-01-20') AS inserted, CAST(count(*) * 2 - count(*) FILTER (d >= DATE '2024-01-20') AS BIGINT) AS deduplicated
    FROM ev GROUP BY 1""")
def w6(f):
    b = f.events.select("event_id", F.col("raw_type").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return ST.insert_summary(_old(f), b, ["event_id"], ["src"])


@query("W7_day_ledger", f"""SELECT CAST(x AS DATE) AS date, CASE WHEN m IS NULL THEN 'missing' WHEN bad > 0 THEN 'error' ELSE 'ok' END AS status,
    coalesce(m, 0) AS matched, coalesce(i, 0) AS inserted
    FROM (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS x) c LEFT JOIN
    (SELECT d, count(*) AS m, count(*) FILTER (eid % 3 = 0) AS i, count(*) FILTER (eid % 499 = 0) AS bad FROM ev WHERE day(d) % 7 <> 0 GROUP BY d) s ON s.d = c.x""")
def w7(f):
    eid = F.col("eid")
    seen = (f.events.withColumn("date", F.to_date("published_at")).where(F.dayofmonth("date") % 7 != 0).groupBy("date")
            .agg(F.when(F.count_if(eid % 499 == 0) > 0, "error").otherwise("ok").alias("status"),
                 F.count("*").alias("matched"), F.count_if(eid % 3 == 0).alias("inserted")))
    return ST.day_ledger(seen, FX.day("2023-12-30"), FX.day("2024-02-02"), f.spark)


@query("W1_stored_insert", """SELECT event_id, d, round(v, 4) AS v, attempted, inserted FROM
    (SELECT event_id, d, v, (SELECT count(*) FROM oldt) AS attempted, (SELECT count(*) FROM oldt) AS inserted FROM oldt
     UNION ALL SELECT event_id, d, v, (SELECT count(*) FROM bat), (SELECT count(*) FROM one WHERE event_id NOT IN (SELECT event_id FROM oldt))
     FROM one WHERE event_id NOT IN (SELECT event_id FROM oldt))""", **MERGE)
def w1_stored(f):
    """The stored form: the old pull, then the overlapping one, twice; every
    row with the counts of the run that inserted it."""
    schema = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("d", T.DateType())])
    path = f"{shared_dir(f.spark)}/w1-{uuid.uuid4().hex}"
    t = ST.Table(f.spark, path, schema, ["event_id"], ["bucket", "month"], sort_by=["d"], ascending=["month"],
                 derive={"bucket": ("pmod(xxhash64(event_id), 16)", ["event_id"]), "month": ("trunc(d, 'MM')", ["d"])})
    first = t.insert_or_ignore(_old(f), ["v"])
    before = t.read().select("event_id", F.lit(True).alias("was_there"))
    before = materialize(before, "w1-before")
    second = t.insert_or_ignore(_batch(f), ["v"])
    third = t.insert_or_ignore(_batch(f), ["v"])
    assert third["inserted"] == 0 and third["attempted"] == second["attempted"]
    of = lambda c: F.when(F.col("was_there"), F.lit(first[c])).otherwise(F.lit(second[c])).cast("bigint").alias(c)
    return t.read().join(before, "event_id", "left").select("event_id", "d", F.round("v", 4).alias("v"), of("attempted"), of("inserted"))


@query("W1_table_append_twice", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS first_inserted, CAST(0 AS BIGINT) AS second_inserted FROM ev")
def w1_table(f):
    """The stored form: two runs of the same batch, the second inserts none."""
    schema = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("d", T.DateType())])
    path = f"{shared_dir(f.spark)}/w1-{uuid.uuid4().hex}"
    t = ST.Table(f.spark, path, schema, ["event_id"], ["d"])
    batch = f.events.select("event_id", F.col("value").alias("v"), F.to_date("published_at").alias("d"))
    a = t.insert_or_ignore(batch, ["d", "v"])
    b = t.insert_or_ignore(batch, ["d", "v"])
    return t.read().agg(F.count("*").alias("n_rows"), F.lit(a["inserted"]).cast("bigint").alias("first_inserted"),
                        F.lit(b["inserted"]).cast("bigint").alias("second_inserted"))


# -- set operations ---------------------------------------------------------
@query("U1_merge_sources", """SELECT id, min(rk) AS src_rank FROM (SELECT event_id AS id, 1 AS rk FROM ev WHERE raw_type IN ('error', 'click')
    UNION ALL SELECT event_id, 2 FROM ev WHERE raw_type IN ('click', 'view') UNION ALL SELECT event_id, 3 FROM ev) GROUP BY id""")
def u1(f):
    kinds = {1: ["error", "click"], 2: ["click", "view"], 3: ["error", "click", "view", "signup", "purchase"]}
    parts = [f.events.where(F.col("raw_type").isin(k)).select(F.col("event_id").alias("id"), F.lit(r).alias("src_rank"))
             for r, k in kinds.items()]
    return ST.union_sources(parts, "id", ["src_rank"])


@query("U2_scope_union", """SELECT actor1 AS country, count(DISTINCT user_id % 25 || '|' || (user_id % 50)) AS n_codes,
    count(DISTINCT user_id % 25 || '|' || (user_id % 50)) > 1 AS conflict FROM ev GROUP BY actor1""")
def u2(f):
    scope = f.events.select(F.col("actor1").alias("country"), (F.col("user_id") % 25).alias("a"), (F.col("user_id") % 50).alias("b"))
    return V.scope_union(scope, "country", "a", "b")


@query("U3_pooled_windows", "SELECT split, count(*) AS n_windows FROM ftr WHERE rn > 60 GROUP BY split")
def u3(f):
    w = FE.lookback_windows(FE.derived_ratios(f.features), FE.VARIANTS["baseline"])
    return w.groupBy("split").agg(F.count("*").alias("n_windows"))


@query("U4_pooled_folds", "SELECT step, count(*) AS n, round(sum(s), 6) AS total FROM ncf WHERE fold_id IN (0, 1, 2) GROUP BY step")
def u4(f):
    from tremor.operators import evaluate as E

    keys = ["ticker", "window_id", "step", "fold_id"]
    s = E.nonconformity(E.band_quantiles(f.samples, keys), f.path_steps, keys)
    return (E.pool_folds(s, [0, 1, 2]).groupBy("step")
            .agg(F.count("*").alias("n"), F.round(F.sum("s"), 6).alias("total")))


@query("U5_checked_difference", "SELECT event_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM led)")
def u5(f):
    return V.not_in(f.events.select("event_id"), f.ledger, "event_id")


@query("N1_tokenize", """SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS tok FROM documents) GROUP BY tok""")
def n1(f):
    return f.table("documents").select(F.explode(TX.tokenize("text")).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
