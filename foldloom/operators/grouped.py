"""Steps that need a whole group in Python: groups come as lists of rows, many in one Arrow batch.

A Python group of its own for each block or gap costs milliseconds, whatever it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foldloom.session import small_batches, spread

Group = dict[str, np.ndarray]


def lists(batch: pa.RecordBatch, name: str) -> tuple[list[int], Group]:
    """Row borders and the fields' values of a column that holds lists of structs."""
    column = batch.column(batch.schema.get_field_index(name))
    values = column.flatten()
    fields = {f.name: values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(values.type)}
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).tolist(), fields


def map_groups(
    rows: DataFrame, keys: Sequence[str], function: Callable[[tuple, Group], Iterable[tuple]], schema: str, least: int = 1,
) -> DataFrame:
    """Rows that ``function`` makes of every group of ``least`` rows or more; it takes the keys and the other columns as arrays.

    Rows of a group come in any order; NULL numbers are NaN, other NULLs None.
    """
    names = [c for c in rows.columns if c not in keys]
    groups = spread(rows, list(keys)).groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("rows"))
    if least > 1:
        groups = groups.where(F.size("rows") >= least)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            border, fields = lists(batch, "rows")
            found: list[tuple] = []
            for r, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True)):
                found.extend(function(key, {c: v[border[r]:border[r + 1]] for c, v in fields.items()}))
            columns = zip(*found, strict=True) if found else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    small_batches(rows.sparkSession)
    return groups.mapInArrow(run, schema)


def ordered(group: Group, *by: str) -> Group:
    """The group in order of columns, the first the most important."""
    order = np.lexsort([group[c] for c in reversed(by)])
    return {c: v[order] for c, v in group.items()}


def points_of(group: Group, row: int) -> np.ndarray:
    """Points (n,3) of a row with coordinate lists; NaN where missing."""
    return np.stack([np.asarray(group[c][row], dtype=float) for c in ("xs", "ys", "zs")], axis=1)
