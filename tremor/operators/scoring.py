"""Event pressure scores.

Plan shape: the corpus is reduced once to one representative per (date,
event_type, corridor) -- exact, because impact and decay are the same for all
events of such a cluster, so the largest ``k`` wins for every stock and day.
Only clusters are joined to the graph and spread over days.  Shuffles: the
cluster key, and (ticker, date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor import dims
from tremor.functions import exprs as X
from tremor.operators import graph as G
from tremor.session import materialize

CLUSTER_KEY = ["cluster_date", "event_type", "corridor_key"]


def reliability(label_source: Column | str, table: dict[str, float] | None = None) -> Column:
    """Reliability of a label source; unknown -> 0."""
    pairs = [F.lit(x) for kv in (table or dims.RELIABILITY).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), X.col(label_source)), F.lit(0.0))


def with_k(events: DataFrame, country_nodes: Sequence[str], table: dict[str, float] | None = None) -> DataFrame:
    """Scorable events with k = severity * confidence * reliability and their
    corridor; excluded types, unknown sources and empty corridors drop out."""
    rel = reliability("label_source", table)
    return (events.where((F.col("event_type") != dims.UNCLASSIFIED) & (rel > 0))
            .withColumn("corridor", X.corridor("countries", country_nodes))
            .where(F.col("corridor").isNotNull())
            .withColumn("corridor_key", G.corridor_key("corridor"))
            .withColumn("cluster_date", F.to_date("published_at"))
            .withColumn("k", F.col("severity_score") * F.col("confidence") * rel))


def build_clusters(events: DataFrame, country_nodes: Sequence[str],
                   table: dict[str, float] | None = None) -> DataFrame:
    """One row per cluster: the max-k event (ties: event id, then source).

    A hot (type, corridor) is split by date in the key and shrunk map-side:
    the partial aggregate forwards one row per key and task, so the shuffle
    follows the number of clusters, not of events.
    """
    scored = with_k(events, country_nodes, table)
    cols = ["event_id", "label_source", "polarity", "severity_score", "confidence", "countries", "published_at"]
    rep = F.struct((-F.col("k")).alias("neg_k"), *cols, "corridor")
    order = F.struct((-F.col("k")).alias("neg_k"), "event_id", "label_source")
    return (scored.groupBy(*CLUSTER_KEY).agg(F.min_by(rep, order).alias("r"))
            .select(*CLUSTER_KEY, (-F.col("r.neg_k")).alias("k"), "r.corridor", *[f"r.{c}" for c in cols]))


def changed_clusters(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The clusters of new events that have no stored representative or beat
    it (larger k, then event id and source), with the one they replace as
    ``old_event_id``, ``old_label_source``.  What ties with the stored one is
    the same event again and changes nothing."""
    old = stored.select(*CLUSTER_KEY, F.col("k").alias("old_k"), F.col("event_id").alias("old_event_id"), F.col("label_source").alias("old_label_source"))
    new_is = F.struct((-F.col("k")).alias("n"), F.col("event_id").alias("e"), F.col("label_source").alias("l"))
    old_is = F.struct((-F.col("old_k")).alias("n"), F.col("old_event_id").alias("e"), F.col("old_label_source").alias("l"))
    return fresh.join(old, CLUSTER_KEY, "left").where(F.col("old_k").isNull() | (new_is < old_is)).drop("old_k")


def with_changes(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """The stored clusters with the changed ones in their place."""
    return stored.join(changed.select(*CLUSTER_KEY), CLUSTER_KEY, "left_anti").unionByName(changed.select(*stored.columns))


def reached_days(changed: DataFrame, reach_table: DataFrame, start: Column, end: Column,
                 half_life: float = dims.HALF_LIFE_DAYS, epsilon: float = dims.EPSILON) -> DataFrame:
    """(ticker, date) pairs whose score the changed clusters enter: the stocks
    they reach, on the days from their own date until decay ends."""
    return spread_days(cluster_reach(changed, reach_table), start, end, half_life, epsilon).select("ticker", "date").distinct()


def cluster_reach(clusters: DataFrame, reach_table: DataFrame) -> DataFrame:
    """Clusters x the stocks they reach with a non-zero impact."""
    pairs = clusters.select("corridor_key", "corridor", "event_type").dropDuplicates(["corridor_key", "event_type"])
    # Written, so that its measured size decides: it follows the corridors seen,
    # while the clusters grow with the days.
    cr = materialize(G.corridor_reach(pairs, reach_table).where("imp > 0"), "corridor-reach")
    return clusters.join(cr.withColumnRenamed("stock", "ticker"), ["corridor_key", "event_type"])


def spread_days(cr: DataFrame, start: Column, end: Column,
                half_life: float = dims.HALF_LIFE_DAYS, epsilon: float = dims.EPSILON) -> DataFrame:
    """A cluster contributes to the days from its own date on until decay
    falls below epsilon (34 ages, 0..33, by default), clipped to [start, end].

    The interval becomes a bounded ``explode``; no range join.
    """
    window = dims.lookback_days(half_life, epsilon)
    first = F.greatest(F.col("cluster_date"), start)
    last = F.least(F.date_add("cluster_date", window), end)
    rows = cr.where(first <= last).withColumn("date", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("days_since", F.datediff("date", "cluster_date"))
    rows = rows.withColumn("tau", X.decay_factor("days_since", half_life)).where(F.col("tau") >= epsilon)
    rows = rows.withColumn("contribution", F.col("k") * F.col("imp") * F.col("tau"))
    return rows.where("contribution > 0")


def score_columns() -> list[Column]:
    """Noisy-OR, direction, coverage and count over contribution rows."""
    c, pol = F.col("contribution"), F.col("polarity")
    mass = F.sum(F.when(pol.isNotNull(), c))
    return [
        (F.lit(1.0) - F.product(F.lit(1.0) - c)).alias("score"),
        (F.sum(c * pol) / F.nullif(mass, F.lit(0.0))).alias("direction"),
        F.coalesce(mass / F.nullif(F.sum(c), F.lit(0.0)), F.lit(0.0)).alias("direction_coverage"),
        F.count("*").alias("n_clusters"),
    ]


def calendar(stocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every (ticker, day): the calendar is exploded inside each stock row."""
    return stocks.select("ticker", F.explode(F.sequence(start, end)).alias("date"))


def daily_scores(contributions: DataFrame, stocks: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per (stock, calendar day), also where nothing contributes."""
    return scores_of(calendar(stocks, start, end), contributions)


def scores_of(pairs: DataFrame, contributions: DataFrame) -> DataFrame:
    """Scores of given (ticker, date) pairs; 0 where nothing contributes."""
    agg = contributions.groupBy("ticker", "date").agg(*score_columns())
    return (pairs.join(agg, ["ticker", "date"], "left")
            .select("ticker", "date", F.coalesce("score", F.lit(0.0)).alias("score"), "direction",
                    F.coalesce("direction_coverage", F.lit(0.0)).alias("direction_coverage"),
                    F.coalesce("n_clusters", F.lit(0)).alias("n_clusters")))


def attribution(contributions: DataFrame, top_k: int = dims.TOP_K) -> DataFrame:
    """Top-k clusters per (stock, day).  The rank filter becomes a
    WindowGroupLimit, which prunes to k rows per group before the shuffle."""
    w = Window.partitionBy("ticker", "date").orderBy(
        F.col("contribution").desc(), F.col("cluster_date").desc(), "event_id", "label_source")
    return (contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
            .select("ticker", "date", "rank", "event_id", "label_source", "event_type", "corridor", "path",
                    "cluster_date", "contribution", "imp", "tau", "days_since", F.col("k").alias("k_value")))


def event_catalog(clusters: DataFrame) -> DataFrame:
    """One row per distinct representative, keyed (event_id, label_source).
    The cluster carries its winner's own fields, so no join back is needed."""
    return clusters.select("event_id", "label_source", "event_type", "severity_score", "confidence", "polarity",
                           "countries", "published_at").dropDuplicates(["event_id", "label_source"])


# -- scores at an instant (fractional days) ---------------------------------
def instant_events(events: DataFrame, country_nodes: Sequence[str], at: Column,
                   half_life: float = dims.HALF_LIFE_DAYS, epsilon: float = dims.EPSILON,
                   table: dict[str, float] | None = None) -> DataFrame:
    """Events visible at ``at`` with their fractional age and decay."""
    rows = with_k(events, country_nodes, table).withColumn("age", X.fractional_days(at, F.col("published_at")))
    rows = rows.where("age >= 0").withColumn("tau", X.decay_factor("age", half_life))
    return rows.where(F.col("tau") >= epsilon)


def instant_contributions(events: DataFrame, country_nodes: Sequence[str], reach_table: DataFrame, at: Column,
                          half_life: float = dims.HALF_LIFE_DAYS, epsilon: float = dims.EPSILON) -> DataFrame:
    """Per (stock, cluster) the strongest event at the instant.  Within a
    cluster the impact is common, so k * tau is maximised before the join."""
    rows = instant_events(events, country_nodes, at, half_life, epsilon).withColumn("kt", F.col("k") * F.col("tau"))
    rows = rows.where("kt > 0")
    order = F.struct((-F.col("kt")).alias("n"), "event_id", "label_source")
    rep = F.struct("event_id", "label_source", "k", "tau", "age", "polarity", "corridor")
    clusters = (rows.groupBy(*CLUSTER_KEY).agg(F.min_by(rep, order).alias("r"))
                .select(*CLUSTER_KEY, "r.*"))
    return cluster_reach(clusters, reach_table).withColumn("contribution", F.col("k") * F.col("imp") * F.col("tau"))


def instant_scores(contributions: DataFrame, stocks: DataFrame) -> DataFrame:
    agg = contributions.groupBy("ticker").agg(*score_columns())
    return (stocks.select("ticker").join(agg, "ticker", "left")
            .select("ticker", F.coalesce("score", F.lit(0.0)).alias("score"), "direction",
                    F.coalesce("direction_coverage", F.lit(0.0)).alias("direction_coverage"),
                    F.coalesce("n_clusters", F.lit(0)).alias("n_clusters")))


def instant_top(contributions: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("contribution").desc(), F.col("cluster_date").desc(), "event_id")
    return contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -- projection of known events onto future days ----------------------------
def projected_scores(cr: DataFrame, requests: DataFrame, start: Column, end: Column,
                     half_life: float = dims.HALF_LIFE_DAYS, epsilon: float = dims.EPSILON) -> DataFrame:
    """``requests``: (ticker, as_of, target), targets within [start, end].
    Score on the target day from clusters dated at or before ``as_of`` only.

    Per (ticker, target) the survival of each cluster date, at most one per
    age, is multiplied up in the order of dates; requests lie among them at
    their ``as_of`` and read off what has been reached.  A request costs one
    row of one sort, whatever the number of dates before it, and a group is
    bounded by the look-back and the horizon.
    """
    survive = (spread_days(cr, start, end, half_life, epsilon)
               .groupBy("ticker", F.col("date").alias("target"), F.col("cluster_date").alias("at"))
               .agg(F.product(F.lit(1.0) - F.col("contribution")).alias("survive")))
    asked = requests.select("ticker", "target", F.col("as_of").alias("at"), F.lit(None).cast("double").alias("survive"), F.lit(True).alias("asks")).distinct()
    rows = survive.withColumn("asks", F.lit(False)).unionByName(asked)
    upto = Window.partitionBy("ticker", "target").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("left", F.product(F.coalesce("survive", F.lit(1.0))).over(upto))
    return known.where("asks").select("ticker", F.col("at").alias("as_of"), "target", (F.lit(1.0) - F.col("left")).alias("score"))


def series_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("ticker").agg(
        F.avg("score").alias("mean_score"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"), F.stddev_pop("score").alias("std_score"))
