"""Repeatable draws: values that depend on the row, not on its partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = float(2**32)


def row_digest(ids: Sequence[str | Column], seed: int | str) -> Column:
    """MD5 of ``id|…|seed``: a uniform, repeatable sort key."""
    parts = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def leading_int(digest: Column, digits: int = 8) -> Column:
    """The first hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def row_uniform(ids: Sequence[str | Column], seed: int | str) -> Column:
    """A uniform number in [0, 1) per row."""
    return leading_int(row_digest(ids, seed)) / F.lit(UNIT)


def fast_uniform(id_column: Column, salt: str) -> Column:
    """A uniform number in [0, 1) from a 64-bit hash; cheaper than a digest."""
    return F.shiftrightunsigned(F.xxhash64(id_column, F.lit(salt)), 11) / F.lit(float(2**53))
