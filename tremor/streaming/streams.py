"""Structured Streaming forms of ingest, labelling and clustering.

The file source stands for the landing zone; ``available_now`` is the one-shot
mode, a processing-time trigger the polling mode (15 minutes by default).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tremor.operators import scoring
from tremor.sources.store import Table

POLL = "15 minutes"


def landing(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
            max_files: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files).parquet(folder))


def deduplicated(stream: DataFrame, key: str = "id", time: str = "published_at", delay: str = "2 days") -> DataFrame:
    """First row per id within the watermark; state is dropped behind it.
    Repeats older than that are still caught by the keyed table."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str,
          poll: str | None = None, mode: str = "append") -> StreamingQuery:
    """``poll`` None = one shot over what has landed."""
    w = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if poll is None else w.trigger(processingTime=poll)).start()


def insert_sink(table: Table, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: a replayed batch inserts nothing."""

    def sink(batch: DataFrame, _batch_id: int) -> None:
        table.insert_or_ignore(batch, order)

    return sink


def upsert_sink(table: Table) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, _batch_id: int) -> None:
        table.insert_or_replace(batch)

    return sink


def refresh_sink(refresh: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
    """Keeps derived tables up to date with each batch of new rows; ``refresh``
    must give the same tables when a batch comes again (``jobs.refresh_scores``)."""

    def sink(batch: DataFrame, _batch_id: int) -> None:
        refresh(batch)

    return sink


def daily_clusters(labelled: DataFrame, country_nodes: Sequence[str], delay: str = "3 days") -> DataFrame:
    """Running max-k representative per (day, type, corridor).  In update mode
    a late row within the watermark may replace the winner."""
    s = scoring.with_k(labelled, country_nodes).withWatermark("published_at", delay)
    order = F.struct((-F.col("k")).alias("n"), "event_id", "label_source")
    rep = F.struct("event_id", "label_source", "k", "polarity")
    return (s.groupBy(F.window("published_at", "1 day").alias("w"), "event_type", "corridor_key")
            .agg(F.min_by(rep, order).alias("r"))
            .select(F.to_date("w.start").alias("cluster_date"), "event_type", "corridor_key", "r.*"))


CLUSTERS = T.StructType([
    T.StructField("cluster_date", T.DateType()), T.StructField("event_type", T.StringType()),
    T.StructField("corridor_key", T.StringType()), T.StructField("event_id", T.StringType()),
    T.StructField("label_source", T.StringType()), T.StructField("k", T.DoubleType()),
    T.StructField("polarity", T.DoubleType())])


STATUS = T.StructType([
    T.StructField("query_id", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("cycles", T.LongType()),
    T.StructField("rows", T.LongType()), T.StructField("last_batch", T.LongType()), T.StructField("last_run", T.StringType()),
    T.StructField("ended", T.BooleanType()), T.StructField("error", T.StringType())])


class CycleStatus(StreamingQueryListener):
    """One status per query: cycles, rows read, last batch and time, whether it
    has ended, and its own error as a whole.  Counts every cycle from the start
    of the listener on, unlike the progress history, which is bounded.  A query
    started again keeps its id and its counts."""

    def __init__(self) -> None:
        self.status: dict[str, dict] = {}

    def _of(self, query_id, name=None) -> dict:
        s = self.status.setdefault(str(query_id), {"name": None, "cycles": 0, "rows": 0, "last_batch": None,
                                                   "last_run": None, "ended": False, "error": None})
        if name:
            s["name"] = name
        return s

    def onQueryStarted(self, event) -> None:
        self._of(event.id, event.name).update(ended=False, error=None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        s = self._of(p.id, p.name)
        s.update(cycles=s["cycles"] + 1, rows=s["rows"] + p.numInputRows, last_batch=p.batchId, last_run=p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(event.id).update(ended=True, error=event.exception)

    def rows(self) -> list[tuple]:
        """Rows of ``STATUS``: as many as there are queries."""
        return [(i, *[s[c] for c in STATUS.fieldNames()[1:]]) for i, s in list(self.status.items())]

    def save(self, table: Table) -> None:
        """Writes the present status, a row per query, through a keyed table."""
        table.insert_or_replace(table.spark.createDataFrame(self.rows(), STATUS))


def status_table(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, STATUS, ["query_id"], ["bucket"], {"bucket": ("pmod(xxhash64(query_id), 8)", ["query_id"])})
