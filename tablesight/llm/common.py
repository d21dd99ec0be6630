"""Helpers the corpus operators share: readers, Arrow batch mapping, scratch tables.

Column rules every operator here follows.  An operator reads only the columns
it is told to (``id_col``, ``text_col``...).  Where rows pass through, an input
column whose name equals one of the operator's outputs (ignoring case) is
replaced by that output; every other column is kept as it came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.session import checkpoint_dir

#: Text bytes handled at once inside one Python task, whatever the batch size:
#: a worker's arrays are a small multiple of this.
SLICE_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_uri(spark: SparkSession) -> str:
    """The shared checkpoint folder as a URI, for readers other than Spark."""
    base = checkpoint_dir(spark).rstrip("/")
    return base if "://" in base else f"file://{base.removeprefix('file:')}"


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """Whole rows as one struct column ``__doc`` beside the columns an operator
    reads, so that no name of the operator's own can meet one of the rows'.
    ``select("__doc.*")`` gives the rows back."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("__doc"), *[df[c] for c in columns])


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def passed_columns(df: DataFrame, outputs: list[str]) -> list[str]:
    """Input columns that an operator with these outputs keeps."""
    taken = {c.lower() for c in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of text
    (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_texts(df: DataFrame, text_col: str, outputs: T.StructType,
              make: Callable[[], Callable[[list], list]], keep: list[str]) -> DataFrame:
    """Add columns computed from whole texts.

    ``make()`` runs once per task and returns a function from a list of texts
    (``None`` for null) to one list per output column.  ``keep`` names the input
    columns carried through; no shuffle takes place.
    """
    names = [f.name for f in outputs]
    keep = [c for c in keep if c in passed_columns(df, names)]
    held = text_col if text_col in keep else unused([*keep, *names], "__text_of_row")
    source = df.select(*[df[c] for c in keep],
                       *([] if held == text_col else [df[text_col].alias(held)]))
    schema = T.StructType([source.schema[c] for c in keep] + list(outputs))

    def run(batches):
        work = make()
        types = None
        for part in slices(batches, held):
            if types is None:
                from pyspark.sql.pandas.types import to_arrow_type
                types = [to_arrow_type(f.dataType) for f in outputs]
            columns = work(part.column(held).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in keep]
                + [pa.array(c, type=t) for c, t in zip(columns, types)],
                names=keep + names)

    return source.mapInArrow(run, schema)
