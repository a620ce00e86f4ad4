"""Write semantics of the stored tables, as merges of DataFrames.

Each merge is a plan (anti join, union), so it can be tested and composed;
``Table`` applies them to a partitioned Parquet folder with Spark's own append
and dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.session import cut_lineage, materialize

#: partitions that a key look-up names one by one; beyond, it reads the whole table
LISTED = 4096


# -- merges -----------------------------------------------------------------
def first_by(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key under an explicit order (``dropDuplicates`` has none).
    A hot key shrinks to one row per task before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    return (batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, "_r.*").select(*batch.columns))


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: rows of the batch whose key the target lacks."""
    return first_by(batch, keys, order).join(target.select(*keys), list(keys), "left_anti").select(*batch.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-replace by key (the batch is unique by key)."""
    kept = target.join(batch.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(batch)


def replace_groups(target: DataFrame, batch: DataFrame, group: Sequence[str]) -> DataFrame:
    """Delete every group the batch touches, then insert the batch."""
    touched = batch.select(*group).distinct()
    return target.join(touched, list(group), "left_anti").select(*target.columns).unionByName(batch)


def rebuild_window(target: DataFrame, batch: DataFrame, column: str, since: Column | None) -> DataFrame:
    """Delete all rows from ``since`` on, then insert: stale winners go."""
    kept = target.where(F.col(column) < since) if since is not None else target
    return kept.unionByName(batch)


def delete_rows(target: DataFrame, deletes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(deletes.select(*keys).distinct(), list(keys), "left_anti").select(*target.columns)


def insert_summary(target: DataFrame, batch: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """attempted / inserted / deduplicated of an insert-or-ignore."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    per_key = batch.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count("*").alias("_n"))
    j = per_key.join(known, list(keys), "left")
    agg = j.groupBy(*by) if by else j.groupBy()
    out = agg.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("attempted"), F.count_if(F.col("_known").isNull()).alias("inserted"))
    return out.withColumn("deduplicated", F.col("attempted") - F.col("inserted"))


def union_sources(parts: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Several sources as one table, first row per key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_by(out, [key], order)


def day_ledger(seen: DataFrame, start: Column, end: Column, spark: SparkSession) -> DataFrame:
    """Expected days against days seen (date, status, matched, inserted):
    missing days get status ``missing``."""
    days = spark.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    return (days.join(seen, "date", "left")
            .select("date", F.coalesce("status", F.lit("missing")).alias("status"),
                    F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("inserted", F.lit(0)).alias("inserted")))


# -- tables -----------------------------------------------------------------
class Table:
    """A keyed Parquet folder, partitioned by ``partition_by``.

    A partition column is a column of the schema or derived: ``derive`` maps
    its name to (SQL expression, columns it is made of), e.g. the month of a
    time stamp or a bucket of an id.  Derived columns exist as folders only;
    those named in ``ascending`` never fall as their one column rises, so that
    a range of that column is a range of folders (see ``slice``).

    Rows are dealt to tasks by partition before a write, so a folder gets few
    files, and lie sorted by ``sort_by`` within them, so that a filter on those
    columns skips row groups.  Inserts append; every other mode rewrites only
    the partitions it touches, by dynamic partition overwrite (staged and
    committed by Spark, so a failed job leaves the old partitions in place).
    ``compact`` folds the files that many small inserts leave.

    An insert looks its keys up only in the partitions that they can lie in:
    where a partition column follows from the key (a bucket of it), the batch's
    values of that column are a partition filter on the stored rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str],
                 partition_by: Sequence[str], derive: dict[str, tuple[str, Sequence[str]]] | None = None,
                 sort_by: Sequence[str] = (), ascending: Sequence[str] = ()) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.partition_by, self.derive = list(keys), list(partition_by), dict(derive or {})
        self.sort_by, self.ascending = list(sort_by), list(ascending)
        unknown = [c for c in self.partition_by if c not in schema.fieldNames() and c not in self.derive]
        if unknown:
            raise ValueError(f"partition columns {unknown} are neither in the schema nor derived")

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def exists(self) -> bool:
        # Dynamic overwrite leaves no _SUCCESS at the root: test the folder.
        p = self._path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _with_partitions(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.schema.fieldNames())
        return rows.withColumns({c: F.expr(e) for c, (e, _) in self.derive.items()})

    def _stored(self) -> DataFrame:
        """All columns, the derived ones as the folders have them."""
        empty = self._with_partitions(self.spark.createDataFrame([], self.schema))
        return self.spark.read.schema(empty.schema).parquet(self.path) if self.exists() else empty

    def read(self, partitions: Column | None = None) -> DataFrame:
        """``partitions``: a condition on partition columns; folders outside
        are not listed as input."""
        rows = self._stored()
        if partitions is not None:
            rows = rows.where(partitions)
        return rows.select(*self.schema.fieldNames())

    def _derived(self, column: str, values: dict) -> object:
        """A partition column's value for given values of what it is made of."""
        fields = [self.schema[c] for c in self._made_of(column)]
        row = self.spark.createDataFrame([tuple(values[f.name] for f in fields)], T.StructType(fields))
        return row.select(F.expr(self.derive[column][0]) if column in self.derive else F.col(column)).first()[0]

    def slice(self, equal: dict | None = None, span: tuple | None = None) -> DataFrame:
        """Rows whose columns have the values of ``equal`` and, for ``span`` =
        (column, low, high), whose column lies in [low, high], an open end being
        None.  Folders that cannot hold such rows are not read, row groups
        outside are skipped by the rows' order."""
        equal, rows = dict(equal or {}), self._stored()
        for c in self.partition_by:
            if self._made_of(c) <= set(equal):
                rows = rows.where(F.col(c) == F.lit(self._derived(c, equal)))
        for name, value in equal.items():
            rows = rows.where(F.col(name) == F.lit(value))
        if span:
            name, low, high = span
            for c in [name, *[c for c in self.ascending if self._made_of(c) == {name}]]:
                at = lambda v: F.lit(v if c == name else self._derived(c, {name: v}))  # noqa: B023, E731
                if low is not None:
                    rows = rows.where(F.col(c) >= at(low))
                if high is not None:
                    rows = rows.where(F.col(c) <= at(high))
        return rows.select(*self.schema.fieldNames())

    def _files(self, rows: DataFrame) -> DataFrame:
        """Rows of a partition in one task, or several if it is large; sorted."""
        dealt = rows.hint("rebalance", *[F.col(c) for c in self.partition_by])
        return dealt.sortWithinPartitions(*self.partition_by, *self.sort_by) if self.sort_by else dealt

    def _append(self, rows: DataFrame) -> None:
        self._files(self._with_partitions(rows)).write.mode("append").partitionBy(*self.partition_by).parquet(self.path)

    def _touched(self, rows: DataFrame) -> DataFrame:
        return self._with_partitions(rows).select(*self.partition_by).distinct()

    def _rewrite(self, touched: DataFrame, merge) -> None:
        """``touched``: distinct partition values; ``merge``: old rows -> rows.
        The merge runs once; its result decides both the new content and which
        partitions are left empty."""
        touched = cut_lineage(touched)
        # A partition's values may be null (its folder then has Hive's name for it).
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in self.partition_by]
        old = self._stored().alias("o").join(touched.alias("t"), same, "left_semi").select(*self.schema.fieldNames())
        rows = materialize(self._with_partitions(merge(old)), "merged")
        (self._files(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.partition_by).parquet(self.path))
        # A partition left without rows is not overwritten: remove its folder.
        # Only partition values reach the driver, as they do for any listing.
        full = rows.select(*self.partition_by).distinct()
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.partition_by]
        for r in touched.alias("t").join(full.alias("n"), same, "left_anti").toLocalIterator():
            p = self._path(self.path + "/" + "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else r[c]}" for c in self.partition_by))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _made_of(self, column: str) -> set[str]:
        return set(self.derive[column][1]) if column in self.derive else {column}

    def near(self, batch: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The stored rows of the partitions in which rows with the batch's
        values of ``columns`` (by default the key) can lie."""
        columns, stored = list(columns or self.keys), self._stored()
        batch = batch.select(*columns)
        own = [c for c in self.partition_by if self._made_of(c) <= set(columns)]
        for c in own:
            value = F.expr(self.derive[c][0]) if c in self.derive else F.col(c)
            values = batch.select(value.alias(c)).distinct().limit(LISTED + 1).collect()  # partition values, at most LISTED + 1
            if len(values) <= LISTED:
                known = [F.lit(r[c]) for r in values if r[c] is not None]
                here = F.col(c).isin(known) if known else F.lit(False)
                stored = stored.where(here | F.col(c).isNull() if len(known) < len(values) else here)
        return stored.select(*self.schema.fieldNames())

    def stored_keys(self, batch: DataFrame) -> DataFrame:
        return self.near(batch).select(*self.keys)

    def insert_or_ignore(self, batch: DataFrame, order: Sequence[str]) -> dict[str, int]:
        """Appends new keys only.  The batch is computed once, into one row per
        key with the number of its repeats; the stored keys are read from the
        batch's partitions."""
        batch = batch.select(*self.schema.fieldNames())
        rest = [c for c in batch.columns if c not in self.keys]
        first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r") if rest else F.lit(None).alias("_r")
        grouped = batch.groupBy(*self.keys).agg(first, F.count("*").alias("_times"))
        once = materialize(grouped, "insert")
        attempted = once.agg(F.coalesce(F.sum("_times"), F.lit(0))).first()[0]
        rows = once.select(*self.keys, *([f"_r.{c}" for c in rest])).select(*batch.columns)
        if self.exists():
            rows = rows.join(self.stored_keys(rows), self.keys, "left_anti").select(*batch.columns)
        kept = Observation()
        self._append(rows.observe(kept, F.count("*").alias("inserted")))
        inserted = _observed(kept, "inserted")
        return {"attempted": attempted, "inserted": inserted, "deduplicated": attempted - inserted}

    def file_counts(self) -> DataFrame:
        """(partition columns, files): one row per folder."""
        if not self.exists():
            return self._stored().groupBy(*self.partition_by).agg(F.count("*").alias("files"))
        rows = self._stored().select(*self.partition_by, F.col("_metadata.file_path").alias("file"))
        return rows.groupBy(*self.partition_by).agg(F.count_distinct("file").alias("files"))

    def compact(self, max_files: int = 1) -> int:
        """Rewrites the folders with more files than ``max_files`` into as many
        as their size asks for; returns how many folders there were."""
        crowded = materialize(self.file_counts().where(F.col("files") > max_files).select(*self.partition_by), "crowded")
        n = crowded.count()
        if n:
            self._rewrite(crowded, lambda old: old)
        return n

    def _require_key_partitions(self) -> None:
        """Replacing by key looks into the batch's partitions only, so the key
        has to determine the partition."""
        for c in self.partition_by:
            if not self._made_of(c) <= set(self.keys):
                raise ValueError(f"partition column {c} does not follow from the key {self.keys}")

    def insert_or_replace(self, batch: DataFrame) -> None:
        self._require_key_partitions()
        batch = cut_lineage(batch.select(*self.schema.fieldNames()))
        self._rewrite(self._touched(batch), lambda old: upsert(old, batch, self.keys))

    def replace_groups(self, batch: DataFrame, group: Sequence[str]) -> None:
        for c in self.partition_by:
            if not self._made_of(c) <= set(group):
                raise ValueError(f"partition column {c} does not follow from the group {list(group)}")
        batch = cut_lineage(batch.select(*self.schema.fieldNames()))
        self._rewrite(self._touched(batch), lambda old: replace_groups(old, batch, group))

    def rebuild_window(self, batch: DataFrame, column: str, since: Column, partitions: Column | None = None) -> None:
        """``partitions``: the same bound on partition columns, if there is
        one, so that older folders are not read."""
        batch = cut_lineage(batch.select(*self.schema.fieldNames()))
        touched = self._touched(batch).unionByName(self._touched(self.read(partitions).where(F.col(column) >= since))).distinct()
        self._rewrite(touched, lambda old: rebuild_window(old, batch, column, since))

    def delete(self, deletes: DataFrame, keys: Sequence[str]) -> None:
        """Where the delete keys determine the partition, no other is read."""
        deletes = cut_lineage(deletes)
        own = [c for c in self.partition_by if self._made_of(c) <= set(keys)]
        if own == self.partition_by:
            exprs = {c: F.expr(self.derive[c][0]) for c in own if c in self.derive}
            touched = deletes.withColumns(exprs).select(*own).distinct()
        else:
            touched = self._touched(self.read().join(deletes.select(*keys).distinct(), list(keys), "left_semi"))
        self._rewrite(touched, lambda old: delete_rows(old, deletes, keys))


def _observed(observation: Observation, name: str) -> int:
    """A count of the rows a write job kept.  Where adaptive execution finds
    that none are left, it drops the rest of the plan with its counters, and
    asking for them fails in the JVM: none were kept."""
    try:
        return observation.get[name]
    except Py4JJavaError:
        return 0


def ingest_all(table: Table, sources: dict[str, DataFrame], order: Sequence[str]) -> list[dict]:
    """Runs each source on its own; a failing source is reported with its whole
    error, not fatal."""
    out = []
    for name, df in sources.items():
        try:
            out.append({"source": name, **table.insert_or_ignore(df, order), "error": None})
        except Exception as exc:  # one bad source must not stop the others
            out.append({"source": name, "attempted": 0, "inserted": 0, "deduplicated": 0, "error": str(exc)})
    return out
