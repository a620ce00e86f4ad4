"""The batch jobs over stored tables, in the order they are run:

ingest -> label -> score -> re-check -> score again -> features -> forecasts.

Each job reads tables, composes operators and writes through the table's own
write mode; running a job twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor import dims
from tremor import schemas as S
from tremor.functions import exprs as X
from tremor.operators import evaluate as EV
from tremor.operators import features as FE
from tremor.operators import forecast as FC
from tremor.operators import graph as G
from tremor.operators import labels as L
from tremor.operators import scoring as SC
from tremor.session import materialize
from tremor.sources import bars as BR
from tremor.sources.store import Table, ingest_all

_ARRAY = T.ArrayType(T.StringType())
ATTRIBUTION = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("event_id", T.StringType()),
    T.StructField("label_source", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("corridor", _ARRAY),
    T.StructField("path", _ARRAY), T.StructField("cluster_date", T.DateType()), T.StructField("contribution", T.DoubleType()),
    T.StructField("imp", T.DoubleType()), T.StructField("tau", T.DoubleType()), T.StructField("days_since", T.IntegerType()),
    T.StructField("k_value", T.DoubleType()), T.StructField("date", T.DateType())])
CATALOG = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("label_source", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("severity_score", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("polarity", T.DoubleType()),
    T.StructField("countries", _ARRAY), T.StructField("published_at", T.TimestampType()), T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("published_date", T.DateType())])
CLUSTERS = T.StructType([
    T.StructField("cluster_date", T.DateType()), T.StructField("event_type", T.StringType()), T.StructField("corridor_key", T.StringType()),
    T.StructField("k", T.DoubleType()), T.StructField("corridor", _ARRAY), T.StructField("event_id", T.StringType()),
    T.StructField("label_source", T.StringType()), T.StructField("polarity", T.DoubleType()), T.StructField("severity_score", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("countries", _ARRAY), T.StructField("published_at", T.TimestampType())])
FEATURES = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("adj_close", T.DoubleType()), T.StructField("daily_return", T.DoubleType()),
    T.StructField("sma_short", T.DoubleType()), T.StructField("sma_long", T.DoubleType()), T.StructField("volatility_10", T.DoubleType()),
    T.StructField("score", T.DoubleType()), T.StructField("score_source_date", T.DateType()), T.StructField("rn", T.IntegerType()),
    T.StructField("split", T.StringType()), T.StructField("date", T.DateType())])
PREDICTIONS = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("variant", T.StringType()), T.StructField("actual", T.DoubleType()),
    T.StructField("predicted", T.DoubleType()), T.StructField("split", T.StringType()), T.StructField("label_date", T.DateType())])


#: folders of ids: inserts look keys up in the buckets of their ids, deletes and rewrites touch those
BUCKETS = 32
#: folders of tickers: a history reads one
TICKER_BUCKETS = 8


SPLIT_BOUNDS = T.StructType([
    T.StructField("fold_id", T.IntegerType()), T.StructField("ticker", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("start_date", T.DateType()), T.StructField("end_date", T.DateType()), T.StructField("n_label_days", T.LongType())])
CALIBRATION = T.StructType([
    T.StructField("variant", T.StringType()), T.StructField("step", T.IntegerType()), T.StructField("n_cal", T.LongType()),
    T.StructField("q_hat", T.DoubleType()), T.StructField("raw_pct", T.DoubleType()), T.StructField("calibrated_pct", T.DoubleType())])
FORECAST = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("variant", T.StringType()), T.StructField("as_of_date", T.DateType()),
    T.StructField("horizon_step", T.IntegerType()), T.StructField("target_date", T.DateType()), T.StructField("point_return", T.DoubleType()),
    T.StructField("lo_return", T.DoubleType()), T.StructField("hi_return", T.DoubleType()), T.StructField("point_price", T.DoubleType()),
    T.StructField("lo_price", T.DoubleType()), T.StructField("hi_price", T.DoubleType())])


@dataclass
class Graph:
    """Edges, nodes and activation; the built-in dimensions by default."""

    edges: DataFrame
    nodes: DataFrame
    activation: DataFrame
    country_nodes: Sequence[str]

    @classmethod
    def builtin(cls, spark: SparkSession) -> Graph:
        return cls(dims.edges_df(spark), dims.nodes_df(spark), dims.activation_df(spark), dims.COUNTRY_NAMES)

    def reach(self) -> DataFrame:
        return G.reach(self.edges, self.nodes, self.activation)

    def stocks(self) -> DataFrame:
        return self.nodes.where("node_type = 'stock'").select(F.col("name").alias("ticker"))


class Store:
    """The tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, ticker_buckets: int = TICKER_BUCKETS) -> None:
        def of(name: str, made_of: str, n: int) -> dict:
            return {name: (f"pmod(xxhash64({made_of}), {n})", [made_of])}

        def table(name: str, schema: T.StructType, keys: list[str], part: list[str], **layout) -> Table:
            return Table(spark, f"{root.rstrip('/')}/{name}", schema, keys, part, **layout)

        def series(name: str, schema: T.StructType, keys: list[str], period: str, date: str = "date", lead: tuple = ()) -> Table:
            """Folders of a ticker bucket and a period, rows by ticker and date."""
            step = {"year": f"year({date})", "month": f"trunc({date}, 'MM')"}[period]
            return table(name, schema, keys, [*lead, "bucket", period], derive={**of("bucket", "ticker", ticker_buckets), period: (step, [date])},
                         sort_by=[k for k in keys if k not in lead], ascending=[period])

        event = of("bucket", "event_id", buckets)
        self.spark = spark
        self.raw_events = table("raw_events", S.RAW_EVENTS, ["id"], ["bucket", "month"], sort_by=["published_at"], ascending=["month"],
                                derive={**of("bucket", "id", buckets), "month": ("trunc(published_at, 'MM')", ["published_at"])})
        self.labels = table("classified_events", S.CLASSIFIED, ["event_id", "label_source"], ["label_source", "bucket"], derive=event)
        self.ledger = table("content_checked", S.CONTENT_LEDGER, ["event_id"], ["bucket"], derive=event)
        self.bars = series("daily_prices", S.DAILY_BARS, ["ticker", "date"], "year")
        self.clusters = table("event_clusters", CLUSTERS, SC.CLUSTER_KEY, ["month"], sort_by=["cluster_date"], ascending=["month"],
                              derive={"month": ("trunc(cluster_date, 'MM')", ["cluster_date"])})
        self.scores = series("scores_daily", S.DAILY_SCORES, ["ticker", "date"], "month")
        self.attribution = series("attribution_daily", ATTRIBUTION, ["ticker", "date", "rank"], "month")
        self.catalog = table("event_catalog", CATALOG, ["event_id", "label_source", "published_date"], ["month"], sort_by=["published_at"], ascending=["month"],
                             derive={"month": ("trunc(published_date, 'MM')", ["published_date"])})
        self.features = series("features_daily", FEATURES, ["ticker", "date"], "year")
        self.bounds = table("walk_forward_bounds", SPLIT_BOUNDS, ["fold_id", "ticker", "split"], ["fold_id"])
        self.calibration = table("calibration", CALIBRATION, ["variant", "step"], ["variant"])
        self.forecasts = table("forecasts", FORECAST, ["ticker", "variant", "as_of_date", "horizon_step"], ["as_of_date"], sort_by=["ticker"])
        self.predictions = series("predictions", PREDICTIONS, ["variant", "ticker", "label_date"], "year", "label_date", ("variant",))

    def tables(self) -> dict[str, Table]:
        return {name: t for name, t in vars(self).items() if isinstance(t, Table)}


def compact(store: Store, max_files: int = 4) -> dict[str, int]:
    """Folds the files of folders that many inserts have filled; a table's
    number of files then follows its size.  Gives the folders rewritten."""
    return {name: t.compact(max_files) for name, t in store.tables().items()}


def ingest(store: Store, sources: dict[str, DataFrame]) -> list[dict]:
    """Each source on its own; the first row of an id stays."""
    return ingest_all(store.raw_events, sources, ["published_at", "ingested_at", "source"])


def ingest_bars(store: Store, feed: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The first valid bar of each (ticker, day) is inserted; rejected rows
    come back as (ticker, problem, count)."""
    good, rejected = BR.scan_bars(feed, list(order_by))
    store.bars.insert_or_ignore(good, ["volume"])
    return rejected


def label(store: Store, dictionary: L.Dictionary | None = None, text_sources: Sequence[str] = ("rss", "newsapi"),
          coded_source: str = "gdelt") -> dict[str, dict]:
    """Labels every row no labeller of its kind has labelled or checked.  Each
    labeller runs on its own: one that fails reports its whole error."""
    raw, done, checked = store.raw_events.read(), store.labels.read(), store.ledger.read()

    def by_rules(source: str) -> DataFrame:
        return L.label_by_rules(L.unlabelled(raw, done, source, dims.RULE_SOURCE, checked), dictionary)

    def by_codes(source: str) -> DataFrame:
        rows = L.unlabelled(raw, done, source, dims.CODED_SOURCE, checked).withColumn("m", F.from_json("raw_metadata", S.CODED_METADATA))
        m = lambda c: F.col(f"m.{c}")
        return L.label_coded(rows, F.col("id"), m("QuadClass"), m("GoldsteinScale"), m("NumMentions"),
                             X.coded_countries(m("Actor1CountryCode"), m("Actor2CountryCode"), m("ActionGeo_CountryCode")))

    out: dict[str, dict] = {}
    for source, labeller in [*[(t, by_rules) for t in text_sources], (coded_source, by_codes)]:
        try:
            out[source] = {**store.labels.insert_or_ignore(labeller(source), ["labeler_version"]), "error": None}
        except Exception as exc:  # one bad labeller must not stop the others
            out[source] = {"attempted": 0, "inserted": 0, "deduplicated": 0, "error": str(exc)}
    return out


def rebuild_scores(store: Store, graph: Graph, start: Column, end: Column, since: Column | None = None,
                   titles: DataFrame | None = None) -> None:
    """Clusters once; then catalog, daily scores and attribution from them."""
    ledger = store.ledger.read() if store.ledger.exists() else None
    # the month folder bounds what is read; the scorable filter then cuts at the instant
    raw = store.raw_events.read(None if since is None else F.col("month") >= F.trunc(since, "MM"))
    events = L.scorable(store.labels.read(), raw, ledger, since=since)
    clusters = materialize(SC.build_clusters(events, graph.country_nodes), "clusters")

    first = F.lit("1900-01-01").cast("timestamp") if since is None else since
    store.clusters.rebuild_window(clusters, "cluster_date", F.to_date(first), F.col("month") >= F.trunc(first, "MM"))
    store.catalog.rebuild_window(catalog_rows(clusters, raw, titles), "published_at", first, F.col("month") >= F.trunc(first, "MM"))

    spread = materialize(SC.spread_days(SC.cluster_reach(clusters, graph.reach()), start, end), "contributions")
    store.scores.insert_or_replace(SC.daily_scores(spread, graph.stocks(), start, end))
    store.attribution.replace_groups(SC.attribution(spread), ["ticker", "date"])


def catalog_rows(clusters: DataFrame, raw: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Catalog of the clusters' representatives; scraped titles fill gaps."""
    own = raw.select(F.col("id").alias("event_id"), "url", F.col("title").alias("own_title"))
    catalog = SC.event_catalog(clusters).join(own, "event_id", "left")
    if titles is not None:
        catalog = catalog.join(titles.where("status = 'ok'").select("url", F.col("title").alias("scraped")), "url", "left")
    else:
        catalog = catalog.withColumn("scraped", F.lit(None).cast("string"))
    return (catalog.withColumn("title", F.coalesce("own_title", "scraped"))
            .withColumn("published_date", F.to_date("published_at")).select(*CATALOG.fieldNames()))


def refresh_scores(store: Store, events: DataFrame, reach: DataFrame, country_nodes: Sequence[str], start: Column, end: Column,
                   titles: DataFrame | None = None) -> dict[str, int]:
    """Brings clusters, catalog, scores and attribution up to date with events
    that became scorable, however late they are.

    Only what they change is computed again: the clusters they win, and the
    (stock, day) pairs those reach until decay ends.  Of the stored clusters the
    months that those days can see are read, and only folders that hold changed
    rows are written.  The clusters are stored last: if a run is lost on the
    way, running it again finds the same changes and ends the work, and a batch
    seen before changes nothing.
    """
    fresh = materialize(SC.build_clusters(events, country_nodes), "fresh-clusters")
    changed = materialize(SC.changed_clusters(store.clusters.near(fresh), fresh), "changed-clusters")
    replaced = changed.where("old_event_id is not null")
    pairs = materialize(SC.reached_days(changed, reach, start, end), "changed-days")
    n = {"clusters": changed.count(), "replaced": replaced.count(), "days": pairs.count()}
    if n["clusters"]:
        _score_days(store, pairs, lambda stored: SC.with_changes(stored, changed), reach, start, end)
        # a cluster's date is the day its representative was published
        gone = replaced.select(F.col("old_event_id").alias("event_id"), F.col("old_label_source").alias("label_source"),
                               F.col("cluster_date").alias("published_date"))
        store.catalog.delete(gone, store.catalog.keys)
        ids = changed.select(F.col("event_id").alias("id"))
        store.catalog.insert_or_replace(catalog_rows(changed, store.raw_events.near(ids), titles))
        store.clusters.insert_or_replace(changed.drop("old_event_id", "old_label_source"))
    return n


def extend_days(store: Store, stocks: DataFrame, reach: DataFrame, start: Column, end: Column) -> int:
    """Scores and attribution of the days in [start, end] that have none yet,
    for every stock; gives the number of (stock, day) pairs added."""
    days = SC.calendar(stocks, start, end)
    pairs = materialize(days.join(store.scores.near(days), ["ticker", "date"], "left_anti"), "new-days")
    n = pairs.count()
    if n:
        _score_days(store, pairs, lambda stored: stored, reach, start, end)
    return n


def _score_days(store: Store, pairs: DataFrame, clusters_now, reach: DataFrame, start: Column, end: Column) -> None:
    """Scores and attribution of (ticker, date) pairs from the clusters that
    their days can see: those of the day itself and of the days before it
    until decay ends."""
    back = F.sequence(F.date_sub("date", dims.lookback_days()), F.col("date"))
    seen = pairs.select("date").distinct().select(F.explode(back).alias("cluster_date")).distinct()
    clusters = clusters_now(store.clusters.near(seen, ["cluster_date"])).join(seen, "cluster_date", "left_semi")
    spread = SC.spread_days(SC.cluster_reach(clusters, reach), start, end).join(pairs, ["ticker", "date"], "left_semi")
    spread = materialize(spread, "changed-contributions")
    store.scores.insert_or_replace(SC.scores_of(pairs, spread))
    store.attribution.replace_groups(SC.attribution(spread), ["ticker", "date"])


def recheck(store: Store, answers: DataFrame) -> dict[str, int]:
    """Screens unchecked headlines, folds the model's answers in, then writes
    new labels, deletes refused ones and records what was checked."""
    cand = L.screen_headlines(L.recheck_candidates(store.catalog.read(), store.ledger.read()))
    verdicts = L.fold_verdicts(answers)
    outcome = materialize(L.recheck(cand, verdicts), "recheck")
    new, delete, checked = L.recheck_outputs(outcome, verdicts)
    added = store.labels.insert_or_ignore(new, ["labeler_version"])
    store.labels.delete(delete, ["event_id", "label_source"])
    noted = store.ledger.insert_or_ignore(checked.withColumn("checked_at", F.current_timestamp()), ["verdict"])
    return {"confirmed": added["inserted"], "checked": noted["inserted"]}


def build_features(store: Store) -> None:
    rows = FE.build_features(store.bars.read(), store.scores.read())
    store.features.insert_or_replace(rows)


def forecast(store: Store, lookback: int = FE.LOOKBACK) -> None:
    """Fits both variants on the train windows and stores test predictions."""
    rows = FE.derived_ratios(store.features.read())
    rows = materialize(FE.apply_standard(rows, FE.fit_standard(rows, FE.BASE_COLS), FE.BASE_COLS), "scaled")
    for variant, cols in FE.VARIANTS.items():
        xs = [c if c in FE.UNSCALED else f"{c}_z" for c in cols]
        windows = FE.lookback_windows(rows, xs, lookback)
        model = FC.fit(windows, xs)
        pred = FC.predict(model, windows.where("split = 'test'"), xs)
        store.predictions.insert_or_replace(
            pred.select("ticker", F.lit(variant).alias("variant"), F.col("y").alias("actual"), "predicted", "split", "label_date"))


def walk_forward(store: Store, n_folds: int = 4, test_days: int = 50) -> DataFrame:
    """Expanding folds over the shared usable days, stored per ticker."""
    features = store.features.read()
    first = features.agg(F.min("date").alias("first_date"))
    usable = features.where(F.col("rn") > FE.LOOKBACK).select("date")
    folds = FE.walk_forward_folds(usable, first, n_folds, test_days)
    store.bounds.insert_or_replace(FE.fold_bounds(folds, features.select("ticker")).select(*SPLIT_BOUNDS.fieldNames()))
    return store.bounds.read()


def project_paths(store: Store, reach: DataFrame, lookback: int = FE.LOOKBACK, horizon: int = FE.HORIZON) -> DataFrame:
    """(ticker, as_of, target, score): for every step of every path of the
    stored features, and of the path ahead, the score from the stored clusters
    that were known when the path began."""
    asked = materialize(FC.projection_requests(FE.derived_ratios(store.features.read()), lookback, horizon), "requests")
    first, last = asked.agg(F.min("target"), F.max("target")).first()
    if first is None:
        return asked.withColumn("score", F.lit(0.0))
    start, end = (F.lit(d).cast("date") for d in (first, last))
    # only clusters whose decay has not ended by the first target count
    clusters = store.clusters.slice(span=("cluster_date", first - timedelta(days=dims.lookback_days()), last))
    return materialize(SC.projected_scores(SC.cluster_reach(clusters, reach), asked, start, end), "projected")


def calibrate_and_forecast(store: Store, reach: DataFrame | None = None, projected: DataFrame | None = None, lookback: int = FE.LOOKBACK,
                           horizon: int = FE.HORIZON, n_samples: int = 50) -> None:
    """``reach``: the graph's reach table, from which the projected scores of
    all paths are built; ``projected`` gives them ready made instead.

    Multi-step chain: per stored fold a model on its train paths, sample
    paths and bands on its test paths; conformal widths from all folds but the
    last, coverage on the last; then the stored forecast of each ticker's next
    ``horizon`` days with calibrated bands.

    The loops run over folds and variants (a handful), each turn one set of
    Spark jobs.
    """
    features = store.features.read()
    rows = FE.derived_ratios(features)
    if projected is None and reach is not None:
        projected = project_paths(store, reach, lookback, horizon)
    bounds = store.bounds.read()
    folds = sorted(r["fold_id"] for r in bounds.select("fold_id").distinct().collect())
    keys = ["ticker", "window_id", "step"]
    for variant, cols in FE.VARIANTS.items():
        xs = [c if c in FE.UNSCALED else f"{c}_z" for c in cols]
        scored = None
        for fold in folds:
            own = FE.split_by_bounds(rows.drop("split"), bounds.where(F.col("fold_id") == fold).drop("n_label_days"))
            own = own.select(*[c for c in rows.columns if c != "split"], "split")
            own = FE.apply_standard(own, FE.fit_standard(own, FE.BASE_COLS), FE.BASE_COLS)
            steps = materialize(FC.sequence_steps(own, xs, lookback, horizon, projected), "sequence-steps")
            model = FC.fit_steps(steps, xs)
            pred = materialize(FC.predict_steps(model, steps, xs).withColumn("window_id", F.unix_date("label_start").cast("bigint")), "step-predictions")
            # residuals of the first step on train: one per day, as the draw needs
            residuals = pred.where("split = 'train' and step = 1").select("ticker", F.col("target").alias("date"), (F.col("y") - F.col("predicted")).alias("residual"))
            test = pred.where("split = 'test'")
            bands = EV.band_quantiles(FC.bootstrap_paths(test, residuals, n_samples), keys)
            s = EV.nonconformity(bands, test.select(*keys, F.col("y").alias("actual")), keys).withColumn("fold_id", F.lit(fold))
            scored = s if scored is None else scored.unionByName(s)
        scored = materialize(scored, "nonconformity")
        calibration = EV.fit_calibration(scored.where(F.col("fold_id") < folds[-1]), ["step"])
        held = EV.apply_calibration(scored.where(F.col("fold_id") == folds[-1]), calibration, ["step"])
        table = calibration.join(EV.coverage(held, ["step"]).drop("n"), "step", "left").withColumn("variant", F.lit(variant))
        store.calibration.insert_or_replace(table.select(*[F.col(c).cast(CALIBRATION[c].dataType) for c in CALIBRATION.fieldNames()]))

        full = materialize(FE.apply_standard(rows, FE.fit_standard(rows, FE.BASE_COLS), FE.BASE_COLS), "scaled")
        steps = materialize(FC.sequence_steps(full, xs, lookback, horizon, projected), "sequence-steps")
        model = FC.fit_steps(steps, xs)
        past = FC.predict_steps(model, steps.where("split = 'train' and step = 1"), xs)
        residuals = past.select("ticker", F.col("target").alias("date"), (F.col("y") - F.col("predicted")).alias("residual"))
        ahead = materialize(FC.predict_steps(model, FC.future_steps(full, xs, lookback, horizon, projected), xs)
                            .withColumn("window_id", F.lit(0).cast("bigint")), "future-steps")
        bands = EV.band_quantiles(FC.bootstrap_paths(ahead, residuals, n_samples), keys)
        wide = EV.apply_calibration(ahead.join(bands, keys), calibration, ["step"])
        priced = FC.price_paths(wide, "lo_cal", "hi_cal")
        store.forecasts.insert_or_replace(priced.select(
            "ticker", F.lit(variant).alias("variant"), F.col("feature_end").alias("as_of_date"), F.col("step").cast("int").alias("horizon_step"),
            F.col("target").alias("target_date"), F.col("predicted").alias("point_return"), F.col("lo_cal").alias("lo_return"),
            F.col("hi_cal").alias("hi_return"), "point_price", "lo_price", "hi_price"))
