"""Joins of positions and intervals, and the segments and depths that overlapping intervals make.

Spark has no operator for inequalities between two tables but the nested loop. Here both sides are dealt to bins of the
axis, so that the join has an equality to hash or sort by; an overlap that spans several bins is kept in the first one
that both sides share, so no distinct is needed after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Width of a bin. Intervals much longer than this are repeated once per bin.
BIN = 16_384


def _bin(pos: Column, width: int) -> Column:
    return F.floor(pos / width).cast("long")


def points_in(points: DataFrame, intervals: DataFrame, *, on: str = "chr", pos: str = "pos", start: str = "start", end: str = "end", how: str = "inner", width: int = BIN) -> DataFrame:
    """``points`` joined with the intervals that hold their position (start <= pos < end); ``how``: inner, left_semi, left_anti or left."""
    bins = intervals.withColumn("__b", F.explode(F.when(F.col(end) > F.col(start), F.sequence(_bin(F.col(start), width), _bin(F.col(end) - 1, width))))).alias("i")
    p = points.withColumn("__b", _bin(F.col(pos), width)).alias("p")
    hit = (F.col(f"p.{on}") == F.col(f"i.{on}")) & (F.col("p.__b") == F.col("i.__b")) & (F.col(f"p.{pos}") >= F.col(f"i.{start}")) & (F.col(f"p.{pos}") < F.col(f"i.{end}"))
    found = p.join(bins, hit, how)
    if how in ("left_semi", "left_anti"):
        return found.drop("__b")
    return found.select("p.*", *(F.col(f"i.{c}") for c in intervals.columns if c != on)).drop("__b")


def in_regions(points: DataFrame, regions: DataFrame, **options) -> DataFrame:
    """The points inside of any region; all of them if there is no region."""
    return points if regions.isEmpty() else points_in(points, regions, how="left_semi", **options)


def overlaps(a: DataFrame, b: DataFrame, *, on: str = "chr", a_range: tuple[str, str] = ("a_start", "a_end"), b_range: tuple[str, str] = ("b_start", "b_end"), pad: int = 0, width: int = BIN) -> DataFrame:
    """All pairs of intervals that overlap (a.start < b.end and b.start < a.end), those of ``b`` widened by ``pad`` on both sides.

    Columns of the two sides must differ but for ``on``.
    """
    (s, e), (s2, e2) = a_range, b_range
    low, high = F.col(s2) - pad, F.col(e2) + pad
    left = a.withColumn("__b", F.explode(F.when(F.col(e) > F.col(s), F.sequence(_bin(F.col(s), width), _bin(F.col(e) - 1, width)))))
    right = b.withColumn("__b", F.explode(F.when(high > low, F.sequence(_bin(low, width), _bin(high - 1, width)))))
    met = left.join(right, [on, "__b"])
    first = _bin(F.greatest(F.col(s), low), width)
    return met.where((F.col(s) < high) & (low < F.col(e)) & (F.col("__b") == first)).drop("__b")


def _edges(intervals: DataFrame, on: str, start: str, end: str) -> DataFrame:
    edge = F.array(F.struct(F.col(start).alias("at"), F.lit(1).cast("long").alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).cast("long").alias("d")))
    return intervals.where(F.col(end) > F.col(start)).select(on, F.explode(edge).alias("__e")).groupBy(on, "__e.at").agg(F.sum("__e.d").alias("d"))


def depths(intervals: DataFrame, *, on: str = "chr", start: str = "start", end: str = "end", stretch: int = 1 << 22) -> DataFrame:
    """(on, start, end, depth) of the segments between neighbouring borders that some interval covers.

    Equal borders are summed first. The running sum is taken within stretches of the axis, to which the sum of all
    earlier stretches is added, so that a chromosome is not one task's work.
    """
    edges = _edges(intervals, on, start, end).withColumn("__s", _bin(F.col("at"), stretch))
    per = edges.groupBy(on, "__s").agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    w = Window.partitionBy(on).orderBy("__s")
    base = per.select(on, "__s", F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("first").over(w).alias("after"))
    inside = Window.partitionBy(on, "__s").orderBy("at")
    # The stretch's first border carries what lies before it.
    found = edges.join(base, [on, "__s"]).select(on, F.col("at").alias("start"), F.coalesce(F.lead("at").over(inside), "after").alias("end"), (F.col("base") + F.sum("d").over(inside)).alias("depth"))
    return found.where("depth > 0 and end is not null")


def segments(intervals: DataFrame, label: str, *, on: str = "chr", start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """(on, start, end, labels): segments as depths() gives them, with the sorted labels of the intervals over each."""
    cut = depths(intervals, on=on, start=start, end=end).select(on, F.col("start").alias("__a"), F.col("end").alias("__z"))
    named = intervals.select(on, F.col(start).alias("__s"), F.col(end).alias("__e"), label)
    met = overlaps(cut, named, on=on, a_range=("__a", "__z"), b_range=("__s", "__e"), width=width)
    return met.groupBy(on, F.col("__a").alias("start"), F.col("__z").alias("end")).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def depth_histogram(intervals: DataFrame, **columns: str) -> DataFrame:
    """(depth, bases) over all segments."""
    return depths(intervals, **columns).groupBy("depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def runs(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, first, last): stretches of consecutive numbers."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.select(*by, value).distinct().withColumn("__g", F.col(value) - F.row_number().over(w)).groupBy(*by, "__g").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("__g")


def save(intervals: DataFrame, path: str, *, on: str = "chr", start: str = "start") -> None:
    """Write intervals, and whatever they are annotated with, in order of their places, so that readers skip what lies elsewhere."""
    intervals.repartitionByRange(on, start).sortWithinPartitions(on, start).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Intervals that save() has written."""
    return spark.read.parquet(path)
