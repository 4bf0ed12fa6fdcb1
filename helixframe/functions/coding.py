"""Byte codes of numbers and texts."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, StringType


def vbyte(value: Column) -> Column:
    """array<int>: a number of zero or more in groups of seven bits, the highest first, each followed by a bit that tells whether more come."""
    groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7).cast("int"))
    group = lambda i: F.call_function("shiftright", value, (groups - 1 - i) * 7).bitwiseAND(F.lit(127))
    return F.transform(F.sequence(F.lit(0), groups - 1), lambda i: (group(i) * 2 + F.when(i < groups - 1, 1).otherwise(0)).cast("int"))


def from_vbyte(code: Column) -> Column:
    """The number that vbyte() gave ``code`` for."""
    return F.aggregate(code, F.lit(0).cast("long"), lambda a, b: a * 128 + F.call_function("shiftright", b, F.lit(1)))


@F.pandas_udf(BinaryType())
def gzipped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text as gzip; the same text always gives the same bytes."""
    for texts in parts:
        yield texts.map(lambda t: None if t is None else gzip.compress(t.encode(), mtime=0))


@F.pandas_udf(StringType())
def gunzipped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for raw in parts:
        yield raw.map(lambda b: None if b is None else gzip.decompress(b).decode())
