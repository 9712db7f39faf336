"""Privacy budget and noise.

Budgets are counted in zero-concentrated differential privacy (rho). Neighbouring
tables differ by one added or removed row; the row count is taken as public.

Two sources of noise exist. ``seed=None`` draws from the operating system and is
the one that protects people. A seed derives noise from the cell's name, so that
a run can be checked; such output is NOT private. Either way the noise is of
ordinary floating-point numbers, whose low bits can leak (Mironov 2012).
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabveil.functions.hashing import row_uniform


def zcdp_budget(epsilon: float, delta: float) -> float:
    """The rho whose zCDP guarantee implies (epsilon, delta)-DP."""
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("epsilon must be positive and delta between 0 and 1")
    log_term = math.log(1 / delta)
    return (math.sqrt(log_term + epsilon) - math.sqrt(log_term)) ** 2


def gaussian_scale(k: int, rho: float) -> float:
    """Noise scale for k marginals under rho; a row touches one cell of each."""
    return math.sqrt(k / (2 * rho))


def selection_epsilon(rounds: int, rho: float) -> float:
    """Parameter of each of some exponential-mechanism choices under rho."""
    return math.sqrt(8 * rho / max(rounds, 1))


def seeded_normal(keys: Sequence[str | Column], seed: int) -> Column:
    """A standard normal value derived from the row (Box–Muller); for checks only."""
    u = row_uniform(keys, f"{seed}-u")
    v = row_uniform(keys, f"{seed}-v")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(2 * math.pi) * v)


def add_gaussian(df: DataFrame, value: str, scale: float, name: str, keys: Sequence[str],
                 seed: int | None = None) -> DataFrame:
    """Add ``name`` = value + Gaussian noise.

    With ``seed=None`` each evaluation draws anew; write the result down before
    it is used twice, because averaging draws would undo the protection.
    """
    if seed is not None:
        return df.withColumn(name, F.col(value) + F.lit(scale) * seeded_normal(keys, seed))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = np.random.default_rng()
        for batch in batches:
            yield batch.assign(**{name: batch[value] + generator.normal(0.0, scale, len(batch))})

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.mapInPandas(draw, schema)


def gumbel_choice(scores: Sequence[float], epsilon: float, generator: random.Random) -> int:
    """Exponential mechanism for scores of sensitivity 1, by the Gumbel-max trick."""
    best, chosen = -math.inf, 0
    for i, score in enumerate(scores):
        u = max(generator.random(), 2.0**-53)
        value = epsilon * score / 2 - math.log(-math.log(u) if u < 1 else 2.0**-53)
        if value > best:
            best, chosen = value, i
    return chosen
