"""Streaming forms, each run to completion over the landed events file.

Results are written through keyed tables in the shared folder and read back.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor import dims
from tremor.functions import exprs as X
from tremor.operators import graph as G
from tremor.operators import labels as L
from tremor.plans import fixtures as FX
from tremor.plans import jobs
from tremor.plans.fixtures import Fixture
from tremor.plans.oracle import band
from tremor.plans.registry import query
from tremor.session import shared_dir
from tremor.sources.store import Table
from tremor.streaming import streams as ST

RAW = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


class StreamFixture(Fixture):
    """The same adapters over the file as a stream."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        return ST.landing(self.spark, self.dir, RAW, glob="events.parquet")


def _place(f: Fixture, name: str) -> str:
    return f"{shared_dir(f.spark)}/{name}-{uuid.uuid4().hex}"


def _table(f: Fixture, place: str, schema: T.StructType, keys: list[str], part: list[str], bucket_of: str | None = None) -> Table:
    """``bucket_of``: a key column whose buckets bound a batch's look-up."""
    derive = {"bucket": (f"pmod(xxhash64({bucket_of}), 16)", [bucket_of])} if bucket_of else {}
    return Table(f.spark, f"{place}/table", schema, keys, [*derive, *part], derive)


IDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("d", T.DateType()), T.StructField("published_us", T.LongType())])


def _repeated(s: StreamFixture) -> DataFrame:
    """Every event arrives three times."""
    e = s.events.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return e.select(F.concat(F.lit("e"), F.col("event_id")).alias("id"), "published_at", F.to_date("published_at").alias("d"),
                    F.unix_micros("published_at").alias("published_us"))


def _ingest(f: Fixture):
    place = _place(f, "r1")
    table = _table(f, place, IDS, ["id"], [], "id")
    stream = ST.deduplicated(_repeated(StreamFixture(f.spark, f.dir)))
    # The keyed sink runs a shuffle per micro-batch, as a batch job would.
    q = ST.start(stream, ST.insert_sink(table, ["published_us"]), f"{place}/checkpoint", place.rsplit("/", 1)[-1])
    q.awaitTermination()
    return table, q


@query("R1_streaming_ingest", "SELECT 'e' || event_id AS id, d, epoch_us(published_at) AS published_us FROM ev")
def r1(f):
    table, _ = _ingest(f)
    return table.read()


LABELS = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("severity", T.IntegerType()),
                       T.StructField("severity_score", T.DoubleType()), T.StructField("label_source", T.StringType())])


@query("R2_streaming_labels", f"""SELECT event_id, event_type, CAST({band('s')} AS INTEGER) AS severity, s AS severity_score, 'gdelt_derived' AS label_source FROM
    (SELECT event_id, CASE WHEN quad >= 3 THEN 'geopolitical_military_tension' ELSE 'unclassified' END AS event_type,
     round(greatest(0e0, least(1e0, 0.65e0 * greatest(0e0, least(1e0, -goldstein / 10e0)) + 0.35e0 * greatest(0e0, least(1e0, ln(1e0 + k0) / ln(21e0))))), 4) AS s FROM ev)""")
def r2(f):
    place = _place(f, "r2")
    s = StreamFixture(f.spark, f.dir).events
    lab = L.label_coded(s, F.col("event_id"), F.col("quad"), F.col("goldstein"), F.col("k0"),
                        X.coded_countries("actor1", "actor2", F.lit("-"), FX.NATION_MAP, {"x": "x"}))
    table = _table(f, place, LABELS, ["event_id", "label_source"], ["label_source"], "event_id")
    ST.start(lab.select(*LABELS.fieldNames()), ST.insert_sink(table, ["event_id"]), f"{place}/checkpoint", place.rsplit("/", 1)[-1]).awaitTermination()
    return table.read()


@query("R3_streaming_clusters", """SELECT cluster_date, event_type, ck AS corridor_key, event_id, label_source, round(k, 9) AS k, polarity FROM
    (SELECT d AS cluster_date, event_type, array_to_string(countries, '|') AS ck, event_id, label_source, polarity,
     severity_score * confidence * CASE label_source WHEN 'manual' THEN 1.0e0 WHEN 'rule_based' THEN 1.0e0 WHEN 'llm_assisted' THEN 0.85e0 WHEN 'ollama_assisted' THEN 0.65e0 ELSE 0.5e0 END AS k
     FROM lab WHERE event_type <> 'unclassified') QUALIFY row_number() OVER (PARTITION BY cluster_date, event_type, ck ORDER BY k DESC, event_id, label_source) = 1""")
def r3(f):
    place = _place(f, "r3")
    clusters = ST.daily_clusters(StreamFixture(f.spark, f.dir).labels, FX.NATIONS, "40 days")
    table = _table(f, place, ST.CLUSTERS, ["cluster_date", "event_type", "corridor_key"], ["cluster_date"])
    ST.start(clusters, ST.upsert_sink(table), f"{place}/checkpoint", place.rsplit("/", 1)[-1], mode="update").awaitTermination()
    return table.read().withColumn("k", F.round("k", 9))


PARTS = 2


def _maintained(f: Fixture):
    """Scores kept up to date by micro-batches: the events land in parts by a
    hash of their id, so every batch holds days of the whole span, and most of
    its rows are late.  A part lands in as many files as tasks read the events,
    and the one-shot query is started again for it."""
    place = _place(f, "upkeep")
    parts = f.spark.read.schema(RAW).parquet(f"{f.dir}/events.parquet").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)))

    class Landed(StreamFixture):
        def table(self, name: str) -> DataFrame:
            if name != "events":
                return Fixture.table(self, name)
            return ST.landing(self.spark, f"{place}/in", RAW)

    # The gate's verdicts are those of the ledger; each event meets its own only.
    confirmed = f.ledger.where(F.col("verdict") == dims.CONFIRMED).select("event_id", F.lit(True).alias("ok"))
    store, reach, stocks = f.store, f.reach, f.stocks
    start, end = f.span
    jobs.extend_days(store, stocks, reach, start, end)

    def refresh(batch: DataFrame) -> None:
        gated = (F.col("label_source") == dims.CODED_SOURCE) & (F.col("event_type") == dims.TENSION)
        rows = batch.join(confirmed, "event_id", "left").where(~gated | F.col("ok")).drop("ok", "eid")
        jobs.refresh_scores(store, rows, reach, FX.NATIONS, start, end)

    for i in range(PARTS):
        parts.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{place}/in")
        events = Landed(f.spark, f.dir).labels
        ST.start(events, ST.refresh_sink(refresh), f"{place}/checkpoint", place.rsplit("/", 1)[-1]).awaitTermination()
    return store


@query("R3_maintained_scores", "SELECT ticker, date, round(score, 8) AS score, round(direction, 8) AS direction, round(direction_coverage, 8) AS direction_coverage, n_clusters FROM dly")
def r3_scores(f):
    r = _maintained(f).scores.read()
    return r.select("ticker", "date", *[F.round(c, 8).alias(c) for c in ("score", "direction", "direction_coverage")], "n_clusters")


@query("R3_maintained_attribution", "SELECT ticker, date, rank, event_id, label_source, event_type, ck AS corridor, cluster_date, round(contribution, 9) AS contribution, days_since FROM att")
def r3_attribution(f):
    r = _maintained(f).attribution.read()
    return r.select("ticker", "date", "rank", "event_id", "label_source", "event_type", G.corridor_key("corridor").alias("corridor"), "cluster_date",
                    F.round("contribution", 9).alias("contribution"), "days_since")


@query("R4_one_shot_trigger", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_id) AS BIGINT) AS n_ids FROM ev")
def r4(f):
    """The one-shot mode stops by itself once the landed files are read."""
    table, q = _ingest(f)
    assert not q.isActive
    return table.read().agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


@query("R5_cycle_status", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_queries, true AS ended, CAST(0 AS BIGINT) AS n_errors FROM ev")
def r5(f):
    """Status of the ingest query as its listener counted it, stored and read back."""
    watch = ST.CycleStatus()
    f.spark.streams.addListener(watch)
    try:
        _, q = _ingest(f)
        wait_for(lambda: watch.status.get(q.id, {}).get("ended"))
    finally:
        f.spark.streams.removeListener(watch)
    table = ST.status_table(f.spark, f"{_place(f, 'r5')}/status")
    watch.status = {q.id: watch.status[q.id]}  # other queries of the session report to the listener too
    watch.save(table)
    return table.read().agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_queries"), F.bool_and("ended").alias("ended"),
                            F.count("error").alias("n_errors"))


def wait_for(done, seconds: float = 30.0) -> None:
    """Listener events arrive on their own thread."""
    end = time.monotonic() + seconds
    while not done() and time.monotonic() < end:
        time.sleep(0.05)
