"""Helpers shared by the operators of this subpackage.

Rules that hold for every operator here:

* Only the columns an operator names are read; extra columns, whatever they
  are called, neither disturb it nor reach its result.  Stages that return the
  documents themselves (``annotate``) keep every column.
* Rows are never joined on a position; repeated rows stay repeated rows.
* Results of one pass that a later pass needs are written to the folder in
  ``spark.checkpoint.dir`` (see ``session.materialize``), so a lost executor
  costs a re-read, never a different answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator on documents needs, under fixed names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of the text column each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(s, e - s)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, slice_on: int | None = None) -> DataFrame:
    """``fn`` turns a record batch into columns; each task streams its batches,
    so memory follows the batch and not the partition.  Where many rows come
    of one, ``slice_on`` names the text column by which batches are cut."""
    arrow = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for part in [b] if slice_on is None else slices(b, slice_on):
                    yield pa.RecordBatch.from_pydict(fn(part), schema=arrow)

    return df.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary()}


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL string of the types above and arrays of them."""
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        if kind.startswith("array<"):
            fields.append(pa.field(name, pa.list_(_ARROW[kind[6:-1]])))
        else:
            fields.append(pa.field(name, _ARROW[kind]))
    return pa.schema(fields)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list:
    return [F.col(quoted(c)) for c in df.columns]


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``keys``: the same rows in every
    run.  A first cut by hash leaves about twice ``n`` rows, the exact cut
    sorts only those."""
    total = df.count()
    h = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    slots = 1 << 30
    below = slots if total <= 2 * n else max(1, 2 * n * slots // total)
    mark = fresh(df, "order")
    return (df.withColumn(mark, h).filter(F.pmod(F.col(mark), F.lit(slots)) < below)
            .orderBy(mark, *keys).limit(n).drop(mark))
