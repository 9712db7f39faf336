"""Long constant lists as one expression each.

A Python call per element costs milliseconds; these cost one call per list and
are folded into a single literal by the optimizer.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_array(values: Iterable[int]) -> Column:
    """A constant array of integers."""
    return F.expr("array(" + ", ".join(str(int(v)) for v in values) + ")")


def text_array(values: Sequence[str]) -> Column:
    """A constant array of texts."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_one_of(name: str, values: Sequence[str]) -> Column:
    """Whether a column, as text, is among the values; null stays null."""
    if not values:
        return F.lit(False)
    column = "`" + name.replace("`", "``") + "`"
    return F.expr(f"cast({column} as string) IN ({', '.join(map(_quoted, values))})")
