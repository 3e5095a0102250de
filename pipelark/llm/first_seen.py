"""Which rows of a key come after its first one, where one key may have a third of all rows.

Keys are two hashes (128 bits together), rows are ordered by document and
position.  The keys of most rows are found first with a frequent-items sketch,
whose size is fixed; their first rows are found by aggregation, which combines
before it shuffles, and are few enough to be broadcast.  Every row looks its key
up there; those that find nothing are range-partitioned by hash and sorted by
document and position within, and a window streams over each key with the first
row at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are treated as frequent at most, items that the sketch tracks, and rows of a frequent key at least.
FREQUENT_KEYS, TRACKED, FREQUENT_ROWS = 10_000, 20_000, 2_000

#: Groups of tasks whose sketches meet first.
SKETCH_GROUPS = 1024


def key(text: Column) -> list[Column]:
    """The two hashes of a text, as ``h1`` and ``h2``."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def frequent(rows: DataFrame) -> DataFrame:
    """Values of ``h1`` with very many rows, ``FREQUENT_KEYS`` of them at most."""
    spark = rows.sparkSession
    # Sketches of tasks meet in groups first, so that no task reads those of all.
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))
    sketches = rows.groupBy(group.alias("part")).agg(F.expr(f"approx_top_k_accumulate(h1, {TRACKED})").alias("sketch"))
    top = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {FREQUENT_KEYS})")
    found = sketches.groupBy(F.expr("part < 0")).agg(top.alias("top")).collect()  # grouped: without sketches there is no row
    return spark.createDataFrame([(x["item"],) for row in found for x in row["top"] if x["count"] >= FREQUENT_ROWS], "h1 long")


def later(rows: DataFrame, whole_document: bool) -> DataFrame:
    """Rows (``h1``, ``h2``, ``doc``, ``at``, others) that aren't the first of their key.

    The first row is the one of the smallest ``doc``, then of the smallest
    ``at``; a null ``doc`` comes last.  With ``whole_document`` all rows of the
    first document count as first.  ``rows`` is read several times and should be
    settled.
    """
    many = frequent(rows).withColumnRenamed("h1", "frequent_h1")
    place = [F.col("doc").isNull().alias("none"), "doc", "at"]
    # Look-ups are left outer joins with unique keys: they give each row back once.
    some = rows.join(F.broadcast(many), rows["h1"] == many["frequent_h1"], "left").filter("h1 <=> frequent_h1")
    firsts = some.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"))
    firsts = firsts.select("h1", "h2", F.col("first.none").alias("none1"), F.col("first.doc").alias("doc1"), F.col("first.at").alias("at1"))
    # As few as ``frequent`` found, so that they are broadcast.
    known = rows.join(F.broadcast(firsts), ["h1", "h2"], "left")
    rare = known.filter("at1 is null").select(*rows.columns)
    # The number of partitions is left to the session and to adaptive execution.
    rare = rare.repartitionByRange("h1", "h2")
    in_order = [F.col("doc").asc_nulls_last(), F.col("at").asc()]
    so_far = Window.partitionBy("h1", "h2").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = rare.select("*", F.first(F.col("doc").isNull()).over(so_far).alias("none1"), F.first("doc").over(so_far).alias("doc1"), F.first("at").over(so_far).alias("at1"))
    # Behind the first row; null for a row that found none.
    behind = (F.col("doc").isNull() & ~F.col("none1")) | (F.col("doc") > F.col("doc1"))
    if not whole_document:
        behind |= F.col("doc").eqNullSafe(F.col("doc1")) & (F.col("at") > F.col("at1"))
    return streamed.unionByName(known.select(*streamed.columns)).filter(behind).select(*rows.columns)
