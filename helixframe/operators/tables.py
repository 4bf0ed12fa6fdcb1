"""Operators on ordered tables: positional pairing, combining merges, order checks, dealing out rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def zipped(a: DataFrame, b: DataFrame, on: str = "idx") -> DataFrame:
    """Rows of two tables side by side by their ordinal; a row without a partner is an error. Other columns must differ."""
    lone = F.raise_error(F.lit("tables of unequal length")).cast("long")
    met = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), on, "full")
    return met.withColumn(on, F.when(F.col("__a").isNull() | F.col("__b").isNull(), lone).otherwise(F.col(on))).drop("__a", "__b")


def combined(a: DataFrame, b: DataFrame, on: list[str], how: Callable[[str, Column, Column], Column]) -> DataFrame:
    """All keys of two tables of one schema; where both have a key, each other column is ``how(name, left, right)``."""
    rest = [c for c in a.columns if c not in on]
    met = a.select(*on, F.struct(*rest).alias("l")).join(b.select(*on, F.struct(*rest).alias("r")), on, "full")
    pick = lambda c: F.when(F.col("l").isNull(), F.col(f"r.{c}")).when(F.col("r").isNull(), F.col(f"l.{c}")).otherwise(how(c, F.col(f"l.{c}"), F.col(f"r.{c}")))
    return met.select(*on, *(pick(c).alias(c) for c in rest))


def out_of_order(df: DataFrame, by: list[str], ordinal: str, key: list[str]) -> DataFrame:
    """The rows whose key isn't greater than that of the row before them, by ``ordinal``, in their group."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    now = F.struct(*key)
    return df.withColumn("__before", F.lag(now).over(w)).where(F.col("__before") >= now).drop("__before")


def in_order(df: DataFrame, by: list[str], ordinal: str, key: list[str]) -> DataFrame:
    """``df``, where a row out of order is an error."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    now = F.struct(*key)
    wrong = F.raise_error(F.concat(F.lit("out of order at "), F.col(ordinal).cast("string"))).cast("boolean")
    return df.withColumn("__ok", F.when(F.lag(now).over(w) >= now, wrong).otherwise(True)).where("__ok").drop("__ok")


def dealt(df: DataFrame, parts: int, ordinal: str = "idx") -> DataFrame:
    """``df`` with part, in turn by the ordinal: the same part for a row however the table is divided."""
    return df.withColumn("part", (F.col(ordinal) % parts).cast("int"))


def columns_copied(df: DataFrame, first: int, last: int, *, at: int = 0, onto: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Columns ``first`` up to ``last`` of a table, alone or put at place ``at`` of another one's, matched by ``on``."""
    names = df.columns[first:last]
    if onto is None:
        return df.select(*names)
    own = onto.columns
    return onto.join(df.select(on, *(n for n in names if n != on)), on).select(*own[:at], *names, *own[at:])


def ranks(values: DataFrame, queries: DataFrame, value: str = "value", query: str = "query") -> DataFrame:
    """(query, rank): how many distinct values are smaller than each query.

    Queries and values are put in one order in stretches: sums over stretches, then within each.
    """
    both = values.select(F.col(value).alias("x"), F.lit(1).alias("v")).distinct().unionByName(queries.select(F.col(query).alias("x"), F.lit(0).alias("v")).distinct())
    width = F.lit(1 << 20)
    both = both.withColumn("__s", F.floor(F.col("x") / width))
    per = both.groupBy("__s").agg(F.sum("v").alias("n"))
    base = per.select("__s", F.coalesce(F.sum("n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("__s").orderBy("x", "v").rowsBetween(Window.unboundedPreceding, -1)
    return both.join(base, "__s").withColumn("rank", F.col("base") + F.coalesce(F.sum("v").over(w), F.lit(0))).where("v = 0").select(F.col("x").alias(query), "rank")


def selected(values: DataFrame, places: DataFrame, value: str = "value", place: str = "place") -> DataFrame:
    """(place, value): the distinct value with so many smaller ones."""
    own = values.select(F.col(value)).distinct()
    found = ranks(own, own.withColumnRenamed(value, "query"), value)
    return found.select(F.col("query").alias(value), F.col("rank").alias(place)).join(places.select(place).distinct(), place).select(place, value)
