"""Readers on landed files, table write modes, streaming sinks."""

import datetime as dt
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.sources import bars as B
from tremor.sources import coded as C
from tremor.sources import feeds as FD
from tremor.sources import store as ST

NOW = dt.datetime(2024, 2, 1)


def line(width, cells):
    return "\t".join(cells.get(i, "") for i in range(width))


def live_row(i, actor="USA", stamp="20240110123000", url="http://X.com/a", quad="4", mentions="7", extra=0):
    cells = {0: str(i), 1: "20240110", 7: actor, 17: "", 29: quad, 30: "-5.0", 31: mentions, 53: "US", 59: stamp, 60: url}
    return line(C.LIVE.width + extra, cells)


def test_zipped_live_export(spark, folder):
    rows = [live_row(1), live_row(2, actor="FRA"), live_row(3, stamp="soon"), live_row(4, url="BBC", mentions=" x "), live_row(5, extra=1), live_row(6, stamp="202401101230001")]
    with zipfile.ZipFile(f"{folder}/20240110.export.CSV.zip", "w") as z:
        z.writestr("20240110.export.CSV", ("\n".join(rows) + "\n").encode() + b"bad \xff line\n")
    lines = C.read_zipped_lines(spark, folder, batch_lines=2)
    assert lines.count() == 7
    assert tuple(C.malformed_count(lines, C.LIVE).first()) == (5, 2)
    got = {r["source_id"]: r for r in C.to_raw_events(lines, C.LIVE, F.lit(NOW)).collect()}
    assert set(got) == {"1", "4"}
    assert got["1"]["published_at"] == dt.datetime(2024, 1, 10, 12, 30) and got["1"]["url"] == "http://X.com/a"
    assert got["4"]["url"] is None and got["4"]["metadata"]["NumMentions"] is None and got["4"]["metadata"]["SOURCEURL"] == "BBC"


def test_members_of_one_archive_are_several_tasks(spark, folder):
    """Members dealt by packed size; nothing but lines leaves a task."""
    from tremor.sources import archives as A

    with zipfile.ZipFile(f"{folder}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("sub")
        for i in range(6):
            z.writestr(f"sub/m{i}.csv", "".join(f"{i}-{j}\t{'x' * (j % 50)}\r\n" for j in range(2000)))
        z.writestr("empty.csv", "")
    with zipfile.ZipFile(f"{folder}/b.zip", "w") as z:
        z.writestr("only.csv", b"one\ntwo \xff")
    open(f"{folder}/notes.txt", "w").close()
    df = A.read_archive_lines(spark, folder, task_bytes=6_000, batch_lines=300)
    assert df.rdd.getNumPartitions() >= 4
    rows_ = df.collect()
    assert len(rows_) == 12_002 and len({(r.file, r.member) for r in rows_}) == 7
    assert sorted(r.value for r in rows_ if r.file.endswith("b.zip")) == ["one", "two \ufffd"]
    assert sum(r.value.startswith("3-") for r in rows_) == 2000 and not any(r.value.endswith("\r") for r in rows_)
    assert A.read_archive_lines(spark, f"file:{folder}/b.zip").count() == 2
    tasks = A.ArchiveReader({"path": folder, "taskBytes": "6000"}).partitions()
    assert sum(len(t.parts) for t in tasks) == 8


def test_daily_export_falls_back_to_file_date(spark, folder):
    rows = [line(58, {0: "1", 7: "TWN", 56: "20240105"}), line(58, {0: "2", 17: "KOR", 56: "n/a"})]
    with open(f"{folder}/20240106.export.CSV", "w") as f:
        f.write("\n".join(rows))
    got = {r["source_id"]: r for r in C.to_raw_events(C.read_lines(spark, folder), C.DAILY, F.lit(NOW)).collect()}
    assert got["1"]["published_at"] == dt.datetime(2024, 1, 5) and got["1"]["published_at_fallback"] is None
    assert got["2"]["published_at"] == dt.datetime(2024, 1, 6) and got["2"]["published_at_fallback"] == "file_date"
    assert got["2"]["published_at_fidelity"] == "date"


def test_feed_files(spark, folder):
    with open(f"{folder}/feed.xml", "w") as f:
        f.write("""<rss><channel><item><title>A</title><link>http://h/a</link><pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate><category>x</category><category>y</category><description>d</description></item>
        <item><title>B</title><link>http://h/b</link><pubDate>Wed, 10 Jan 2024 10:00 EST</pubDate></item>
        <item><guid>g3</guid><updated>2024-01-09T08:00:00Z</updated></item><item><title>no identity</title></item><item><link>http://h/c</link></item></channel></rss>""")
    got = {r["url"] or r["source_id"]: r for r in FD.feed_to_raw_events(FD.read_feed_items(spark, folder), "f", F.lit(NOW)).collect()}
    assert len(got) == 4
    assert got["http://h/a"]["published_at"] == dt.datetime(2024, 1, 10, 10) and got["http://h/a"]["tags"] == ["x", "y"] and got["http://h/a"]["text"] == "d"
    assert got["http://h/b"]["published_at"] == dt.datetime(2024, 1, 10, 15)
    assert got["g3"]["published_at_fallback"] == "updated_parsed" and got["http://h/c"]["published_at"] == NOW


def test_news_files(spark, folder):
    arts = [{"url": "http://n/1", "title": "T", "description": None, "content": "c", "publishedAt": "2024-01-02T03:04:05Z"}, {"url": None, "title": "x"}]
    for name, status in (("a", "ok"), ("b", "error")):
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump({"status": status, "articles": arts}, f)
    rows = FD.news_to_raw_events(FD.read_news_payloads(spark, folder), F.lit(NOW)).collect()
    assert [(r["title"], r["text"], r["published_at"]) for r in rows] == [("T", "c", dt.datetime(2024, 1, 2, 3, 4, 5))]


def test_atom_files(spark, folder):
    with open(f"{folder}/feed.xml", "w") as f:
        f.write("""<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>
        <entry><id>tag:1</id><title type="html">A &amp;amp; B</title><link rel="self" href="http://h/self"/><link href="http://h/a"/><author><name>Ann</name></author>
          <category term="x"/><category term=""/><published>2024-01-09T08:00:00Z</published><updated>2024-01-10T08:00:00Z</updated><content type="text">body</content></entry>
        <entry><id>tag:2</id><title>C</title><updated>2024-01-10T09:00:00+01:00</updated><summary>short</summary></entry></feed>""")
    got = {r["source_id"]: r for r in FD.feed_to_raw_events(FD.read_atom_entries(spark, folder), "f", F.lit(NOW), feed_url="http://f").collect()}
    a, b = got["tag:1"], got["tag:2"]
    assert (a["url"], a["title"], a["text"], a["published_at"]) == ("http://h/a", "A &amp; B", "body", dt.datetime(2024, 1, 9, 8))
    assert json.loads(a["raw_metadata"]) == {"feed_name": "f", "feed_url": "http://f", "author": "Ann", "tags": ["x"], "guid": "tag:1"}
    assert (b["url"], b["text"], b["published_at"]) == (None, "short", dt.datetime(2024, 1, 10, 8))
    assert json.loads(b["raw_metadata"])["published_at_fallback"] == "updated_parsed"


def test_files_reach_the_stored_table(spark, folder):
    """XML, JSON and zipped lines through the ingest job; metadata survives."""
    import os
    import zipfile

    from tremor.plans import jobs

    for d in ("rss", "news", "zip"):
        os.makedirs(f"{folder}/{d}")
    with open(f"{folder}/rss/f.xml", "w") as f:
        f.write("<rss><channel><item><title>A</title><link>http://h/a</link><pubDate>Wed, 10 Jan 2024 10:00:00 GMT</pubDate></item><item><link>http://h/b</link></item></channel></rss>")
    with open(f"{folder}/news/a.json", "w") as f:
        json.dump({"status": "ok", "articles": [{"url": "http://n/1", "title": "T", "author": "me", "urlToImage": "http://i", "source": {"id": "s", "name": "S"}, "publishedAt": "2024-01-02T03:04:05Z"}]}, f)
    with zipfile.ZipFile(f"{folder}/zip/20240106.export.CSV.zip", "w") as z:
        z.writestr("one.csv", line(58, {0: "1", 7: "TWN", 29: "4", 56: "20240105"}))
        z.writestr("two.csv", line(58, {0: "2", 17: "KOR", 56: "n/a"}))
    store = jobs.Store(spark, f"{folder}/store")
    sources = {"rss": FD.feed_to_raw_events(FD.read_feed_items(spark, f"{folder}/rss"), "f", F.lit(NOW)),
               "newsapi": FD.news_to_raw_events(FD.read_news_payloads(spark, f"{folder}/news"), F.lit(NOW), query="chips"),
               "gdelt": C.to_raw_events(C.read_zipped_lines(spark, f"{folder}/zip"), C.DAILY, F.lit(NOW))}
    for k in range(2):
        out = jobs.ingest(store, sources)
        assert [(r["inserted"], r["error"]) for r in out] == [(2 - 2 * k, None), (1 - k, None), (2 - 2 * k, None)]
    meta = {(r["source"], r["url"] or r["source_id"]): json.loads(r["raw_metadata"]) for r in store.raw_events.read().collect()}
    assert meta["newsapi", "http://n/1"] == {"query": "chips", "author": "me", "source_name": "S", "source_id": "s", "url_to_image": "http://i"}
    assert meta["rss", "http://h/b"]["published_at_fallback"] == "ingested_at"
    assert meta["gdelt", "1"]["QuadClass"] == 4 and meta["gdelt", "1"]["granularity"] == "daily" and "published_at_fallback" not in meta["gdelt", "1"]
    assert meta["gdelt", "2"]["published_at_fallback"] == "file_date"
    assert jobs.label(store)["gdelt"]["inserted"] == 2


def test_only_touched_partitions_are_read(spark, folder):
    t = ST.Table(spark, f"{folder}/t", SCHEMA, ["k", "d"], ["d", "b"], {"b": ("pmod(xxhash64(k), 4)", ["k"])})
    t.insert_or_ignore(spark.createDataFrame([(f"k{i}", i, d) for i in range(8) for d in (D1, D2, D3)], SCHEMA), ["v"])
    some = t.read(F.col("d") >= F.lit(D3))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan and some.count() == 8
    before = {f: os.stat(f.removeprefix("file:")).st_mtime_ns for f in t.read().inputFiles()}
    t.delete(spark.createDataFrame([("k1", D1)], "k string, d date"), ["k", "d"])
    after = {f: os.stat(f.removeprefix("file:")).st_mtime_ns for f in t.read().inputFiles()}
    assert t.read().count() == 23
    changed = {f for f in before if before[f] != after.get(f)}
    assert changed and all("d=2024-01-01" in f for f in changed) and len({f.rsplit("/", 1)[0] for f in changed}) == 1
    with pytest.raises(ValueError):
        ST.Table(spark, f"{folder}/u", SCHEMA, ["k"], ["d"]).insert_or_replace(t.read())


def scan(df):
    """The file scan of a plan: its partition filters, and the folders it read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters: ["):].split("]")[0], {os.path.dirname(f).rsplit("/t/")[-1] for f in df.inputFiles()}


def test_insert_looks_keys_up_in_their_buckets_only(spark, folder):
    bucket = "pmod(xxhash64(k), 512)"
    t = ST.Table(spark, f"{folder}/t", SCHEMA, ["k"], ["b", "m"], {"b": (bucket, ["k"]), "m": ("trunc(d, 'MM')", ["d"])}, sort_by=["d"], ascending=["m"])
    many = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("v"), F.date_add(F.lit(D1), (F.col("id") % 60).cast("int")).alias("d"))
    assert t.insert_or_ignore(many, ["v"]) == {"attempted": 4000, "inserted": 4000, "deduplicated": 0}
    batch = many.limit(60).unionByName(spark.createDataFrame([(f"n{i}", 2, D2) for i in range(40)], SCHEMA))
    want = {r[0] for r in batch.select(F.expr(bucket)).distinct().collect()}
    looked_up = t.stored_keys(batch)
    filters, folders = scan(looked_up)
    assert f"b#" in filters and len(want) < 101
    read = {r[0] for r in looked_up.select(F.expr(bucket)).distinct().collect()}
    assert read <= want
    assert {f.split("/")[0] for f in {os.path.dirname(x).split("/t/")[-1] for x in t._stored().where(F.col("b").isin(list(want))).inputFiles()}} >= {f"b={b}" for b in read}
    assert t.insert_or_ignore(batch, ["v"]) == {"attempted": 100, "inserted": 40, "deduplicated": 60}
    assert t.insert_or_ignore(batch, ["v"])["inserted"] == 0 and t.read().count() == 4040


def test_slice_reads_one_bucket_and_its_months(spark, folder):
    t = ST.Table(spark, f"{folder}/t", SCHEMA, ["k", "d"], ["b", "m"], {"b": ("pmod(xxhash64(k), 8)", ["k"]), "m": ("trunc(d, 'MM')", ["d"])}, sort_by=["k", "d"], ascending=["m"])
    rows_ = spark.range(0, 3000).select(F.concat(F.lit("k"), (F.col("id") % 20)).alias("k"), F.col("id").cast("int").alias("v"), F.date_add(F.lit(D1), F.floor(F.col("id") / 20).cast("int")).alias("d"))
    t.insert_or_ignore(rows_, ["v"])
    one = t.slice({"k": "k3"}, ("d", D2, dt.date(2024, 2, 10)))
    filters, _ = scan(one)
    assert "(b#" in filters and "m#" in filters
    assert one.count() == 40 and {r.k for r in one.collect()} == {"k3"}
    assert t.slice(span=("d", None, D1)).count() == 20 and t.slice().count() == 3000


def test_compaction_follows_size(spark, folder):
    t = ST.Table(spark, f"{folder}/t", SCHEMA, ["k"], ["b"], {"b": ("pmod(xxhash64(k), 2)", ["k"])}, sort_by=["d"])
    for i in range(5):
        t.insert_or_ignore(spark.createDataFrame([(f"{i}-{j}", j, D1) for j in range(20)], SCHEMA), ["v"])
    before = rows(t)
    assert min(r.files for r in t.file_counts().collect()) >= 5
    assert t.compact() == 2 and rows(t) == before
    assert [r.files for r in t.file_counts().collect()] == [1, 1] and t.compact() == 0
    assert ST.Table(spark, f"{folder}/none", SCHEMA, ["k"], ["d"]).compact() == 0


def test_failure_between_commit_and_removal_is_reported_and_repaired(spark, table, monkeypatch):
    """A folder that loses its last row goes after the commit of the others: if
    that fails the call fails, and running it again ends the work."""
    gone = spark.createDataFrame([("c", D2), ("a", D1)], "k string, d date")
    monkeypatch.setattr(table, "_path", lambda p: (_ for _ in ()).throw(OSError("lost")) if "d=2024" in p else ST.Table._path(table, p))
    with pytest.raises(OSError):
        table.delete(gone, ["k", "d"])
    monkeypatch.undo()
    table.delete(gone, ["k", "d"])
    assert rows(table) == [("b", 2, D1)]


@pytest.mark.parametrize("bad", ["<![foo[ x", "<![ ]><title>t</title>"])
def test_bad_markup_costs_one_title(spark, bad):
    pages = spark.createDataFrame([("a", bad), ("b", "<title>fine</title>")], "url string, html string")
    got = {r["url"]: (r["title"], r["status"]) for r in FD.page_titles(pages).collect()}
    assert got["b"] == ("fine", "ok") and got["a"][0] is None and got["a"][1] in ("error", "no_title")


def test_titles(spark):
    pages = [("a", '<head><meta property="og:title" content=" Og &amp; co "><title>T</title></head>'), ("b", "<title> Plain\n</title>"), ("c", "<title> </title>"),
             ("d", "<p>none</p>"), ("e", None), ("f", '<meta property="og:title" content=""><title>Back &lt;up&gt;</title>'), ("g", "<!-- <title>no</title> --><title>yes</title>")]
    got = {r["url"]: (r["title"], r["status"]) for r in FD.page_titles(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got == {"a": ("Og & co", "ok"), "b": ("Plain", "ok"), "c": (None, "no_title"), "d": (None, "no_title"), "e": (None, "no_title"),
                   "f": ("Back <up>", "ok"), "g": ("yes", "ok")}


def test_a_cut_reference_in_a_title_stays_text():
    for title, want in [("a&&& b&amp", "a&&& b&amp"), ("x&lt y &ampz; &#38", "x&lt y &ampz; &#38"), ("a &amp;lt; &amp; &#39;b&#x27; &quot;", "a &lt; & 'b' \""), ("&amp", "&amp")]:
        assert FD.title_of(f"<title>{title}</title>") == (want, "ok")
        assert FD.title_of(f"<meta property='og:title' content='{title}'>") == (want, "ok")


def test_bars_keep_first_valid(spark):
    d = dt.date(2024, 1, 2)
    rows = [("A", d, 5., 4., 3., 3.5, 3.5, 1, 0), ("A", d, 3., 4., 3., 3.5, 3.5, 2, 1), ("A", d, 3., 4., 3., 3.5, 3.5, 3, 2), ("B", d, 1., 1., 1., None, 1., 1, 0)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume long, pos int")
    good, bad = B.scan_bars(df, ["pos"])
    assert [(r["ticker"], r["volume"]) for r in good.collect()] == [("A", 2)]
    assert {(r["ticker"], r["problem"], r["count"]) for r in bad.collect()} == {("A", "inconsistent range", 1), ("A", "repeated day", 1), ("B", "missing price", 1)}


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("d", T.DateType())])
D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)


@pytest.fixture()
def table(spark, folder):
    t = ST.Table(spark, f"{folder}/t", SCHEMA, ["k", "d"], ["d"])
    assert t.read().count() == 0
    first = t.insert_or_ignore(spark.createDataFrame([("a", 1, D1), ("a", 9, D1), ("b", 2, D1), ("c", 3, D2)], SCHEMA), ["v"])
    assert first == {"attempted": 4, "inserted": 3, "deduplicated": 1}
    return t


def rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_insert_twice(spark, table):
    before = rows(table)
    again = table.insert_or_ignore(spark.createDataFrame([("a", 7, D1), ("c", 8, D2)], SCHEMA), ["v"])
    assert again["inserted"] == 0 and rows(table) == before == [("a", 1, D1), ("b", 2, D1), ("c", 3, D2)]


def test_replace(spark, table):
    batch = spark.createDataFrame([("a", 5, D1), ("e", 6, D3)], SCHEMA)
    for _ in range(2):
        table.insert_or_replace(batch)
        assert rows(table) == [("a", 5, D1), ("b", 2, D1), ("c", 3, D2), ("e", 6, D3)]


def test_replace_groups(spark, table):
    table.replace_groups(spark.createDataFrame([("z", 1, D1)], SCHEMA), ["d"])
    assert rows(table) == [("c", 3, D2), ("z", 1, D1)]


def test_rebuild_window_drops_stale(spark, table):
    table.rebuild_window(spark.createDataFrame([("n", 1, D3)], SCHEMA), "d", F.lit(D2))
    assert rows(table) == [("a", 1, D1), ("b", 2, D1), ("n", 1, D3)]


def test_delete_can_empty_a_partition(spark, table):
    table.delete(spark.createDataFrame([("c", D2), ("a", D1)], "k string, d date"), ["k", "d"])
    assert rows(table) == [("b", 2, D1)]


def test_failing_source_does_not_stop_others(spark, table):
    bad = spark.createDataFrame([("x", 1, D1)], SCHEMA).withColumn("v", F.raise_error(F.lit("boom")).cast("int"))
    good = spark.createDataFrame([("y", 1, D1)], SCHEMA)
    out = {r["source"]: r for r in ST.ingest_all(table, {"bad": bad, "good": good}, ["v"])}
    assert out["bad"]["error"] and out["good"]["inserted"] == 1


def test_stream_dedup_and_replay(spark, folder):
    from tremor.streaming import streams as S

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("published_at", T.TimestampType()), T.StructField("d", T.DateType())])
    rows_ = [(i, dt.datetime(2024, 1, 1, h), D1) for h, i in enumerate(["a", "b", "a", "a", "c"])]
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{folder}/in")
    t = ST.Table(spark, f"{folder}/t", schema, ["id"], ["d"])
    for run in range(2):  # a second query without the first one's progress replays everything
        q = S.start(S.deduplicated(S.landing(spark, f"{folder}/in", schema)), S.insert_sink(t, ["published_at"]), f"{folder}/cp{run}", f"q{run}")
        q.awaitTermination()
        assert sorted(r["id"] for r in t.read().collect()) == ["a", "b", "c"]


def test_cycle_status_tells_queries_apart(spark, folder):
    """Two queries, one of which fails; more cycles than the history keeps."""
    from tremor.plans.q_streaming import wait_for
    from tremor.streaming import streams as S

    schema = T.StructType([T.StructField("x", T.LongType())])
    for i in range(6):
        spark.range(i, i + 2).toDF("x").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    keep = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    watch = S.CycleStatus()
    spark.streams.addListener(watch)
    try:
        def fail(batch, _):
            raise ValueError("lost " + "x" * 900)

        good = S.start(S.landing(spark, f"{folder}/in", schema, max_files=1), lambda b, _: b.count(), f"{folder}/cp1", "good")
        bad = S.start(S.landing(spark, f"{folder}/in", schema), fail, f"{folder}/cp2", "bad")
        good.awaitTermination()
        with pytest.raises(Exception):
            bad.awaitTermination()
        wait_for(lambda: all(watch.status.get(q.id, {}).get("ended") for q in (good, bad)))
    finally:
        spark.streams.removeListener(watch)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", keep)
    g, b = watch.status[good.id], watch.status[bad.id]
    assert (g["name"], g["rows"], g["error"]) == ("good", 12, None) and g["cycles"] >= 6 > len(good.recentProgress)
    assert b["name"] == "bad" and "x" * 900 in b["error"]
    table = S.status_table(spark, f"{folder}/status")
    for _ in range(2):
        watch.save(table)
    assert {r["name"]: r["rows"] for r in table.read().collect() if r["query_id"] in (good.id, bad.id)}["good"] == 12
