"""Repeat rows once per set of columns, with few and short expressions.

The columns travel as one array, and number tables say which element belongs to
which set. The generated code stays small for hundreds of sets, where one
expression per set would no longer compile into a single stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.functions.literals import number_array

ROWS_AT_ONCE = 200_000
TEXT_AT_ONCE = 64 * 1024 * 1024  # bytes
DENSE = 1 << 16  # so many cells are counted by place, more by sorting


def per_set(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], keep: Sequence[str] = (),
            number=None, absent: str | None = "") -> DataFrame:
    """Columns ``set_no``, ``k0``, ``k1``, … and those in ``keep``.

    ``k0`` is the value of the set's first column and so on; sets shorter than
    the longest one are filled with ``absent``. ``number`` picks one set per row
    instead of all sets.
    """
    columns, width = list(columns), max(len(s) for s in sets)
    values = F.array(*[F.col(c).cast("string") for c in columns], F.lit(absent).cast("string"))
    place = {c: i for i, c in enumerate(columns)}
    every = F.explode(F.sequence(F.lit(0), F.lit(len(sets) - 1))) if number is None else number
    rows = df.select(*keep, values.alias("values"), every.alias("set_no"))
    keys = []
    for j in range(width):
        element = number_array([place[s[j]] if j < len(s) else len(columns) for s in sets])
        keys.append(F.get("values", F.get(element, F.col("set_no"))).alias(f"k{j}"))
    return rows.select(*keep, "set_no", *keys)


def key_columns(sets: Sequence[Sequence[str]]) -> list[str]:
    return ["set_no", *[f"k{j}" for j in range(max(len(s) for s in sets))]]


def set_counts(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], absent: str | None = "") -> DataFrame:
    """``per_set`` with its equal rows counted: ``set_no``, ``k0``, … and ``n``.

    Values become small numbers per stretch of rows, so a row costs a few integer
    steps per set. Stretches are added up by one shuffle of cells.
    """
    columns, keys = list(columns), key_columns(sets)
    place = {c: i for i, c in enumerate(columns)}
    members = [[place[c] for c in s] for s in sets]
    at_once, text_at_once, dense, width = ROWS_AT_ONCE, TEXT_AT_ONCE, DENSE, len(keys) - 1

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = [pa.concat_arrays([b.column(i) for b in batches]).dictionary_encode(null_encoding="encode") for i in range(len(columns))]
        codes = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
        for number, chosen in enumerate(members):
            # Cells seen so far are numbered anew with each column, so the numbers stay small.
            cells, firsts, n = codes[chosen[0]], None, None
            for i in chosen[1:]:
                k = len(coded[i].dictionary)
                cells = cells * k + codes[i]
                if i != chosen[-1] and int(cells.max()) > len(cells):
                    cells = np.unique(cells, return_inverse=True)[1]
            if int(cells.max()) < dense:
                n = np.bincount(cells)
                seen = np.flatnonzero(n)
                n, firsts = n[seen], np.zeros(int(cells.max()) + 1, dtype=np.int64)
                firsts[cells] = np.arange(len(cells))
                firsts = firsts[seen]
            else:
                firsts, n = np.unique(cells, return_index=True, return_counts=True)[1:]
            values = [coded[i].dictionary.take(pa.array(codes[i][firsts])) for i in chosen]
            values += [pa.array([absent] * len(firsts), pa.string())] * (width - len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(firsts), number, dtype=np.int32)), *values, pa.array(n.astype(np.int64))], names=[*keys, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= at_once or size >= text_at_once:
                yield from counted(held)
                held, rows, size = [], 0, 0
        if held:
            yield from counted(held)

    texts = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = "set_no int, " + ", ".join(f"{k} string" for k in keys[1:]) + ", n long"
    return texts.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"))
