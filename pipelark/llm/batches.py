"""Arrow batches in and out of Python workers, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .session import ready

#: Bytes of text that are worked on at once; one longer text makes a piece of its own.
PIECE_BYTES = 4_000_000


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (in the ``column``-th column) together have about ``most`` bytes, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


#: Bytes of a table for each core up to which it is spread over the cores.
SPREAD_BYTES = 4_000_000


def spread(table: DataFrame) -> DataFrame:
    """A small table's rows over all cores; a large one as it is.

    A scan has no more tasks than the files have row groups, and a small file has
    one, behind which Python would work on one core.  Same rows either way.
    """
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size < cores * SPREAD_BYTES else table


def free(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name (case apart)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` that doesn't stumble over dots in names; batches have the columns by position."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(work, schema)


def extended(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    keep_text: bool = True,
) -> DataFrame:
    """``df`` with columns that a Python function computes from one column.

    ``make()`` is called once in a task and returns the function, which gets the
    values of ``text`` as an Arrow array and returns an array for each field.  A
    column of ``df`` that has the name of a new one is replaced.  Without
    ``keep_text`` the column ``text`` isn't sent back.
    """
    ready(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names and (keep_text or c.lower() != text.lower())]
    stays = next((c for c in kept if c.lower() == text.lower()), None)
    source = stays or free([*df.columns, *names], "source_text")
    extra = [] if stays else [df[f"`{text}`"].alias(source)]
    sent = df.select(*[df[f"`{c}`"] for c in kept], *extra)
    schema = T.StructType([*sent.schema.fields[: len(kept)], *fields])
    at = sent.columns.index(source)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in pieces(batch, at):
                made = function(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=schema.names)

    return mapped(sent, work, schema)
