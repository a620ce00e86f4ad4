"""Coded-event exports: tab-separated lines in one of two column layouts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor import dims
from tremor.functions import exprs as X
from tremor.sources import archives

# Zero-based column positions shared by both layouts.
POSITIONS = {
    "GLOBALEVENTID": 0, "SQLDATE": 1, "Actor1Code": 5, "Actor1Name": 6, "Actor1CountryCode": 7,
    "Actor2Code": 15, "Actor2Name": 16, "Actor2CountryCode": 17, "IsRootEvent": 25,
    "EventCode": 26, "EventBaseCode": 27, "EventRootCode": 28, "QuadClass": 29,
    "GoldsteinScale": 30, "NumMentions": 31, "NumSources": 32, "NumArticles": 33, "AvgTone": 34,
}
TYPES = {"QuadClass": "int", "GoldsteinScale": "double", "NumMentions": "int",
         "NumSources": "int", "NumArticles": "int", "AvgTone": "double"}


@dataclass(frozen=True)
class Layout:
    width: int
    place: int
    added: int
    url: int
    added_format: str

    @property
    def positions(self) -> dict[str, int]:
        return {**POSITIONS, "ActionGeo_CountryCode": self.place,
                "SOURCEURL": self.url, "DATEADDED": self.added}


# The two published layouts.
LIVE = Layout(width=61, place=53, added=59, url=60, added_format="yyyyMMddHHmmss")
DAILY = Layout(width=58, place=51, added=56, url=57, added_format="yyyyMMdd")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain (or gzip) exports as (value, file)."""
    return spark.read.text(path).select("value", F.input_file_name().alias("file"))


def read_zipped_lines(spark: SparkSession, path: str, batch_lines: int = archives.BATCH_LINES) -> DataFrame:
    """Zipped exports, all members, as (value, file)."""
    return archives.read_archive_lines(spark, path, batch_lines=batch_lines).select("value", "file")


def split_columns(lines: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """Adds ``cols`` and ``well_formed`` (exactly ``layout.width`` columns)."""
    return (lines.withColumn("cols", F.split(F.col(value), "\t", -1))
            .withColumn("well_formed", F.size("cols") == layout.width))


def typed_columns(layout: Layout, cols: str = "cols") -> dict[str, Column]:
    """Trimmed, empty -> null, unparseable number -> null."""
    out = {}
    for name, pos in layout.positions.items():
        c = X.null_if_blank(F.col(cols)[pos])
        out[name] = c.try_cast(TYPES[name]) if name in TYPES else c
    return out


def in_scope(actor1: Column, actor2: Column, codes: Sequence[str]) -> Column:
    return F.coalesce(actor1.isin(list(codes)), F.lit(False)) | F.coalesce(actor2.isin(list(codes)), F.lit(False))


def parse_added(added: Column, layout: Layout) -> Column:
    # try_to_timestamp is lenient about trailing text, so pin the length too.
    ok = added.rlike("^[0-9]{%d}$" % len(layout.added_format))
    return F.when(ok, F.try_to_timestamp(added, F.lit(layout.added_format)))


def file_date(file: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(file, r"(\d{8})[^/]*$", 1), F.lit("yyyyMMdd"))


def to_raw_events(lines: DataFrame, layout: Layout, ingested_at: Column,
                  source: str = "gdelt", codes: Sequence[str] | None = None,
                  value: str = "value", file: str | None = "file") -> DataFrame:
    """Well-formed, in-scope lines as raw events.

    Live layout: a bad added-timestamp drops the row.  Daily layout: it falls
    back to the date in the file name and the fallback is recorded.
    """
    codes = list(dims.CAMEO_TO_NAME) if codes is None else codes
    rows = split_columns(lines, layout, value).where("well_formed")
    rows = rows.select("*", F.struct(*[c.alias(n) for n, c in typed_columns(layout).items()]).alias("m"))
    rows = rows.where(in_scope(F.col("m.Actor1CountryCode"), F.col("m.Actor2CountryCode"), codes))
    stamp = parse_added(F.col("m.DATEADDED"), layout)
    daily = layout.added_format == "yyyyMMdd"
    fallback = F.lit(None).cast("string")
    if daily and file is not None:
        fallback = F.when(stamp.isNull(), F.lit("file_date"))
        stamp = F.coalesce(stamp, file_date(F.col(file)))
    url = X.http_only("m.SOURCEURL")
    return (rows.select(
        X.event_id(F.lit(source), url, F.col("m.GLOBALEVENTID")).alias("id"),
        F.lit(source).alias("source"),
        F.col("m.GLOBALEVENTID").alias("source_id"),
        stamp.alias("published_at"),
        ingested_at.cast("timestamp").alias("ingested_at"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("text"),
        url.alias("url"),
        F.col("m").alias("metadata"),
        _raw_metadata(fallback, daily).alias("raw_metadata"),
        F.lit("date" if daily else "time").alias("published_at_fidelity"),
        fallback.alias("published_at_fallback"),
    ).where(F.col("id").isNotNull() & F.col("published_at").isNotNull()))


def _raw_metadata(fallback: Column, daily: bool) -> Column:
    """JSON of the typed columns with their nulls; rows of the daily layout are
    tagged as such, and a fallback is named where one was used."""
    fields = [F.col(f"m.{n}").alias(n) for n in LIVE.positions]
    if daily:  # fixed values: provenance tags of date-only rows
        fields += [F.lit(True).alias("backfill"), F.lit("daily").alias("granularity"), F.lit("1.0").alias("gdelt_version"),
                   F.lit("date").alias("published_at_fidelity")]
    text = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return F.when(fallback.isNull(), text(fields)).otherwise(text([*fields, fallback.alias("published_at_fallback")]))


def malformed_count(lines: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    ok = F.size(F.split(F.col(value), "\t", -1)) == layout.width
    return lines.agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_malformed"))
