"""Explicit table schemas.  Readers use these instead of inference."""

from pyspark.sql import types as T

EDGES = T.StructType([
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), False),
    T.StructField("channel", T.StringType(), True),
    T.StructField("weight", T.DoubleType(), False),
    T.StructField("note", T.StringType(), True),
])
NODES = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("node_type", T.StringType(), False),
])
ACTIVATION = T.StructType([
    T.StructField("event_type", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("activation", T.DoubleType(), False),
])
CODED_METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "GLOBALEVENTID", "SQLDATE", "Actor1Code", "Actor1Name", "Actor1CountryCode",
        "Actor2Code", "Actor2Name", "Actor2CountryCode", "IsRootEvent", "EventCode",
        "EventBaseCode", "EventRootCode")]
    + [T.StructField("QuadClass", T.IntegerType()),
       T.StructField("GoldsteinScale", T.DoubleType()),
       T.StructField("NumMentions", T.IntegerType()),
       T.StructField("NumSources", T.IntegerType()),
       T.StructField("NumArticles", T.IntegerType()),
       T.StructField("AvgTone", T.DoubleType()),
       T.StructField("ActionGeo_CountryCode", T.StringType()),
       T.StructField("SOURCEURL", T.StringType()),
       T.StructField("DATEADDED", T.StringType())])
RAW_EVENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("source_id", T.StringType()),
    T.StructField("published_at", T.TimestampType(), False),
    T.StructField("ingested_at", T.TimestampType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("raw_metadata", T.StringType()),
])
CLASSIFIED = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("label_source", T.StringType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("severity", T.IntegerType(), False),
    T.StructField("severity_score", T.DoubleType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("polarity", T.DoubleType()),
    T.StructField("countries", T.ArrayType(T.StringType())),
    T.StructField("sector", T.StringType()),
    T.StructField("companies", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType()),
    T.StructField("labeler_version", T.StringType()),
])
CONTENT_LEDGER = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("verdict", T.StringType(), False),
    T.StructField("checked_at", T.TimestampType()),
])
DAILY_BARS = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
])
DAILY_SCORES = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("direction", T.DoubleType()),
    T.StructField("direction_coverage", T.DoubleType(), False),
    T.StructField("n_clusters", T.LongType(), False),
])
MODEL_VERDICT = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("severity_score", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("polarity", T.DoubleType()),
    T.StructField("countries", T.ArrayType(T.StringType())),
    T.StructField("sector", T.StringType()),
    T.StructField("companies", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType()),
])
NEWS_PAYLOAD = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("articles", T.ArrayType(T.StructType([
        T.StructField("source", T.StructType([
            T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("urlToImage", T.StringType()),
        T.StructField("publishedAt", T.StringType()),
        T.StructField("content", T.StringType()),
    ]))),
])
FEED_ITEM = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("guid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("category", T.ArrayType(T.StringType())),
    T.StructField("pubDate", T.StringType()),
    T.StructField("updated", T.StringType()),
])
_TEXT = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType())])
ATOM_ENTRY = T.StructType([
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())]))),
    T.StructField("id", T.StringType()),
    T.StructField("title", _TEXT),
    T.StructField("summary", _TEXT),
    T.StructField("content", _TEXT),
    T.StructField("author", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
])
