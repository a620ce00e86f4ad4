"""Read queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import exprs as X
from tremor.operators import graph as G

QUICK_RANGES = {"1M": 30, "3M": 91, "6M": 182, "1Y": 365}
DEFAULT_PRICE_DAYS = 730


def history(table: DataFrame, ticker: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of [start, end], oldest first; the filters reach the scan."""
    if ticker is not None:
        table = table.where(F.col("ticker") == ticker)
    if start is not None:
        table = table.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        table = table.where(F.col("date") <= F.lit(end).cast("date"))
    return table.orderBy("ticker", "date")


def last_days(table: DataFrame, days: int = DEFAULT_PRICE_DAYS) -> DataFrame:
    """Rows at most ``days`` before each ticker's newest row.  The newest date
    is a small aggregate joined back, not a window over the table."""
    newest = table.groupBy("ticker").agg(F.max("date").alias("newest"))
    return table.join(newest, "ticker").where(F.col("date") >= F.date_sub("newest", days)).drop("newest")


def at_latest(table: DataFrame, latest_of: DataFrame) -> DataFrame:
    """Rows of the latest scored date of each ticker."""
    newest = latest_of.groupBy("ticker").agg(F.max("date").alias("date"))
    return table.join(newest, ["ticker", "date"])


def last_points(table: DataFrame, n: int) -> DataFrame:
    """Last ``n`` points per ticker, ascending (n rows survive per group and
    task, by WindowGroupLimit)."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return table.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn").orderBy("ticker", "date")


def sparkline(points: DataFrame, value: str) -> DataFrame:
    """Min-max scaled values per ticker (range 0 -> 1) of bounded point sets."""
    w = Window.partitionBy("ticker")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return points.withColumn("scaled", (F.col(value) - lo) / F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0)))


def new_event_dates(attribution: DataFrame) -> DataFrame:
    return attribution.where("rank = 1 and days_since = 0").select(
        "ticker", "date", "event_id", "event_type", "label_source", G.corridor_key("corridor").alias("corridor"))


def event_corridors(attribution: DataFrame) -> DataFrame:
    """One corridor per attributed event (the smallest)."""
    return attribution.groupBy("event_id").agg(F.min(G.corridor_key("corridor")).alias("corridor"))


def recent_events(catalog: DataFrame, attribution: DataFrame, start: Column | None, end: Column | None,
                  limit: int) -> DataFrame:
    """Attributed events of [start, end of day], newest first.  The date filter
    comes before the join; the order + limit is a per-task top-k."""
    c = catalog
    if start is not None:
        c = c.where(F.col("published_at") >= start)
    if end is not None:
        c = c.where(F.col("published_at") < F.date_add(end, 1).cast("timestamp"))
    return c.join(event_corridors(attribution), "event_id").orderBy(F.col("published_at").desc(), "event_id").limit(limit)


def event_impacts(events: DataFrame, corridor_reach: DataFrame, attribution: DataFrame) -> DataFrame:
    """Every stock an event reaches, its contribution before decay and whether
    it was ever among that stock's top rows."""
    ever = attribution.select("event_id", "ticker").distinct().withColumn("ever_top", F.lit(True))
    rows = events.join(corridor_reach.withColumnRenamed("stock", "ticker"), ["corridor_key", "event_type"])
    return (rows.join(ever, ["event_id", "ticker"], "left")
            .select("event_id", "ticker", "imp", "path", (F.col("k_value") * F.col("imp")).alias("gross_contribution"),
                    F.coalesce("ever_top", F.lit(False)).alias("ever_top")))


def attributed_events(attribution: DataFrame) -> DataFrame:
    """(event_id, corridor, event_type, k_value) of attributed events, one row
    each (smallest corridor)."""
    return (attribution.groupBy("event_id")
            .agg(F.min(F.struct(G.corridor_key("corridor").alias("corridor_key"), "event_type", "k_value", "corridor")).alias("r"))
            .select("event_id", "r.*"))


def with_narratives(attribution: DataFrame, catalog: DataFrame, narratives: DataFrame | None) -> DataFrame:
    rows = attribution.join(catalog.select("event_id", "label_source", "title"), ["event_id", "label_source"])
    if narratives is None:
        return rows.withColumn("narrative", F.lit(None).cast("string"))
    return rows.join(narratives.select("event_id", "narrative"), "event_id", "left")


def narrative_candidates(attribution: DataFrame, catalog: DataFrame, narratives: DataFrame) -> DataFrame:
    return (event_corridors(attribution).join(catalog.select("event_id", "title", "event_type"), "event_id")
            .join(narratives.select("event_id"), "event_id", "left_anti"))


def with_titles(catalog: DataFrame, raw: DataFrame, scraped: DataFrame) -> DataFrame:
    """URL and title by id; a missing title falls back to the scraped one."""
    own = raw.select(F.col("id").alias("event_id"), "url", F.col("title").alias("own_title"))
    ok = scraped.where("status = 'ok'").select("url", F.col("title").alias("scraped_title"))
    j = catalog.join(own, "event_id", "left").join(ok, "url", "left")
    return j.withColumn("title", F.coalesce("own_title", "scraped_title")).drop("own_title", "scraped_title")


def uncached_urls(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct URLs absent from the cache in any status (failures count)."""
    return urls.where("url is not null").select("url").distinct().join(cache.select("url"), "url", "left_anti")


def latest_by(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Newest row per key: partial aggregation, no window."""
    cols = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(*keys, "r.*")


def latest_vintage(forecast: DataFrame) -> DataFrame:
    newest = forecast.groupBy("ticker", "variant").agg(F.max("as_of_date").alias("as_of_date"))
    return forecast.join(newest, ["ticker", "variant", "as_of_date"])


def after_last_bar(forecast: DataFrame, bars: DataFrame) -> DataFrame:
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_bar"))
    return forecast.join(last, "ticker").where(F.col("target_date") > F.col("last_bar"))


def most_recent(table: DataFrame, order: list[str], n: int) -> DataFrame:
    return table.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sector_listing(stocks: DataFrame, sector_ord: dict[str, int] | None = None) -> DataFrame:
    return (stocks.select("sector", "ticker").distinct().groupBy("sector")
            .agg(F.array_join(F.array_sort(F.collect_list("ticker")), "|").alias("tickers")))


def by_sector_order(rows: DataFrame, sectors: list[str], value: str) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in sectors]), F.col("sector"))
    return rows.withColumn("sector_ord", order).orderBy("sector_ord", F.col(value).desc())


def deltas(latest: DataFrame) -> DataFrame:
    return latest.select("ticker", "date", "close", "prior_close", X.price_delta_pct("close", "prior_close").alias("pct"),
                         X.price_delta_dir("close", "prior_close").alias("direction"))


# -- look-ups and small aggregates --------------------------------------------
def lookup(rows: DataFrame, source: DataFrame, key: str, source_key: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``source`` by id; rows without a match keep nulls."""
    return rows.join(source.select(F.col(source_key).alias(key), *columns), key, "left")


def not_in(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key a ledger lacks (an anti join: nulls in it match nothing)."""
    return rows.join(ledger.select(key), key, "left_anti")


def sector_of(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Adds the sector of each ticker: the smallest name if ``scope``
    (sector, ticker) lists several, null if none."""
    one = scope.groupBy("ticker").agg(F.min("sector").alias("sector"))
    return rows.join(one, "ticker", "left")


def scope_union(scope: DataFrame, name: str, *values: str) -> DataFrame:
    """Union of all sectors' entries: one row per ``name`` with the number of
    different ``values`` that sectors give it, and whether they conflict."""
    return (scope.select(name, F.struct(*values).alias("_v")).distinct().groupBy(name)
            .agg(F.count("*").alias("n_codes")).withColumn("conflict", F.col("n_codes") > 1))


def require_no_conflict(union: DataFrame, name: str) -> DataFrame:
    """The union, or an error that names an entry on which sectors disagree."""
    text = F.concat(F.lit("sectors disagree on "), F.col(name))
    return union.withColumn("conflict", F.when(F.col("conflict"), F.raise_error(text).cast("boolean")).otherwise(F.lit(False)))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def coverage_by(rows: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Rows, first and last date of each key."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def freshness(rows: DataFrame, time: str) -> DataFrame:
    return rows.agg(F.max(time).alias("latest"))


def dedup_ratio(rows: DataFrame, key: str) -> DataFrame:
    """Rows per distinct key.  Distinct by grouping, so that a hot key is
    counted in each task first."""
    per = rows.groupBy(key).agg(F.count("*").alias("_c"))
    t = per.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_attempted"), F.count("*").alias("n_unique"))
    return t.withColumn("ratio", F.col("n_attempted") / F.nullif(F.col("n_unique"), F.lit(0)))


def stored_report(reports: DataFrame, variant: str, scope: str) -> DataFrame:
    """Rows of a stored report of one variant as they are, numbers that JSON
    cannot hold as null, with the scope they speak of in front."""
    return X.finite_rows(reports.where(F.col("variant") == variant)).select(F.lit(scope).alias("scope"), "*")
