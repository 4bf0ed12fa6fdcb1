"""Delimited text: typed columns, key=value lists, order-preserving attribute lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def parts(text: Column, mark: str, skip_empty: bool = False) -> Column:
    """The pieces of a text between marks; the empty text is one empty piece."""
    found = F.split(text, "\\Q" + mark + "\\E", -1)
    return F.filter(found, lambda x: x != "") if skip_empty else found


def pairs(text: Column, mark: str = ";", lone: bool = True) -> Column:
    """array<struct<key, value>> in order; a key ends at the first "=". Without ``lone``, pieces without one are left out."""
    found = parts(text, mark, skip_empty=True)
    if not lone:
        found = F.filter(found, lambda x: x.contains("="))
    return F.transform(found, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x))).otherwise(F.lit("")).alias("value")))


def pairs_text(value: Column, mark: str = ";") -> Column:
    return F.array_join(F.transform(value, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), mark)


def formatted(pattern: str, value: Column) -> Column:
    """Numbers as the C library writes them, such as "%2.2g": its rounding is of the binary value, and its %g drops zeros.

    An Arrow UDF, for files that have to agree with others to the letter; format_string rounds and pads differently.
    """

    @F.pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else pattern % v for v in values], dtype=object)

    return written(value.cast("double"))


def joined(*texts: Column) -> Column:
    """Texts one after the other."""
    return F.concat(*texts)


def sliced(text: Column, begin: Column, end: Column) -> Column:
    """The characters from ``begin`` (from 0) up to ``end``; what lies outside of the text is left out."""
    first = F.greatest(begin, F.lit(0))
    return F.substring(text, (first + 1).cast("int"), F.greatest(F.least(end, F.length(text)) - first, F.lit(0)).cast("int"))


def split_at(text: Column, at: Column) -> Column:
    """struct<left, right>: the characters before a place (from 0), and those from it on."""
    return F.struct(sliced(text, F.lit(0), at).alias("left"), sliced(text, at, F.length(text)).alias("right"))


def found_at(text: Column, what: Column) -> Column:
    """The first place (from 0) of a text in another; the other's length where there is none."""
    at = F.instr(text, what)
    return F.when(at > 0, at - 1).otherwise(F.length(text))


@dataclass(frozen=True)
class ColumnType:
    """How a column of a named type is read from text and written to it."""

    read: Callable[[Column], Column]
    write: Callable[[Column], Column]


def _plain(name: str) -> ColumnType:
    return ColumnType(lambda c: c.cast(name), lambda c: c.cast("string"))


def _unsigned(c: Column) -> Column:
    value = c.cast("decimal(20,0)")
    return F.when(value < 0, F.raise_error(F.concat(F.lit("not an unsigned number: "), c)).cast("long")).otherwise(value.cast("long"))


#: Types by name; users may add their own. "[t]" is a ;-list of t, "str=t" a key with a value of t.
TYPES: dict[str, ColumnType] = {"int": _plain("long"), "uint": ColumnType(_unsigned, lambda c: c.cast("string")), "flt": _plain("double"), "str": _plain("string")}


def column_type(name: str) -> ColumnType:
    if name in TYPES:
        return TYPES[name]
    if name.startswith("[") and name.endswith("]"):
        inner = column_type(name[1:-1])
        return ColumnType(lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(parts(c, ";")) if name == "[str]" else F.transform(parts(c, ";", skip_empty=True), inner.read), lambda c: F.array_join(F.transform(c, inner.write), ";"))
    if name.startswith("str="):
        value = column_type(name[4:])
        return ColumnType(
            lambda c: F.struct(F.substring_index(c, "=", 1).alias("key"), value.read(F.substring(c, F.instr(c, F.lit("=")) + 1, F.length(c))).alias("value")),
            lambda c: F.concat(c["key"], F.lit("="), value.write(c["value"])),
        )
    raise ValueError(f"no column type called {name}")


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns of text read as the named types."""
    return df.select(*(column_type(t).read(F.col(c)).alias(c) for c, t in types.items()))


def untyped(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns written as text."""
    return df.select(*(column_type(t).write(F.col(c)).alias(c) for c, t in types.items()))
