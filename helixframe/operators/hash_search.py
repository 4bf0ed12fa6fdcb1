"""A search for coefficients of the multiply-rotate hash, judged by how evenly it spreads numbers."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from helixframe.functions.kmers import multiply_rotate
from helixframe.functions.stats import upper_gamma

SCHEMA = "id long, multipliers array<decimal(20,0)>, lefts array<int>, rights array<int>, worst_bit double, p_bits double, p_bins double"


def scores(values: np.ndarray, bins: int = 1024, *, compat: bool = False) -> tuple[float, float, float]:
    """(largest chi-squared of a bit, upper tail over all bits, upper tail over bins) of hashed values.

    A bit's statistic counts both its values, and all bits have 64 degrees of freedom. With ``compat`` only ones are
    counted, with 63 degrees, as in older tools of this kind.
    """
    n = len(values)
    ones = np.array([((values >> np.uint64(b)) & np.uint64(1)).sum() for b in range(64)], dtype=float)
    bits = (ones - n / 2) ** 2 / (n / 2) * (1 if compat else 2)
    counts = np.bincount((values % np.uint64(bins)).astype(np.int64), minlength=bins)
    spread = float(((counts - n / bins) ** 2).sum() / (n / bins))
    tail = lambda degrees, x: float(upper_gamma(np.array([degrees / 2]), np.array([x / 2]))[0])
    return float(bits.max()), tail(63 if compat else 64, float(bits.sum())), tail(bins - 1, spread)


def search(spark: SparkSession, candidates: int, *, rounds: int = 2, values: int = 100_000, seed: int = 1, compat: bool = False) -> DataFrame:
    """A row to each random candidate: its coefficients and how it hashes the first numbers. Candidates are judged in parallel."""

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.arange(values, dtype=np.uint64)
        for part in parts:
            out = []
            for i in part["id"]:
                rng = np.random.default_rng((seed, i))
                spec = [(int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1, int(rng.integers(1, 63)), int(rng.integers(1, 63))) for _ in range(rounds)]
                out.append((i, [Decimal(m) for m, _, _ in spec], [a for _, a, _ in spec], [b for _, _, b in spec], *scores(multiply_rotate(x, spec), compat=compat)))
            yield pd.DataFrame(out, columns=["id", "multipliers", "lefts", "rights", "worst_bit", "p_bits", "p_bins"])

    return spark.range(candidates).mapInPandas(judge, SCHEMA)
