"""Folds over sorted rows of a key, a task holding no more than the key's state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def folded(rows: DataFrame, by: str, order: list[str], value: str, added: str, start: Any, step: Callable[[Any, Any], tuple[Any, tuple]]) -> DataFrame:
    """``rows`` with the columns ``added`` (a schema), which ``step`` makes of the key's state and a row's ``value``.

    Rows are dealt by key, sorted, and streamed through, so a key with many rows costs time but no memory.
    A null key is a key; ``start`` is the state before a key's first row.
    """
    more = StructType.fromDDL(added)
    columns = [f.name for f in rows.schema]
    types = [to_arrow_type(f.dataType) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, start, False
        for b in batches:
            out: list[tuple] = []
            for k, v in zip(b.column(by).to_pylist(), b.column(value).to_pylist(), strict=True):
                if not begun or k != key:
                    key, state, begun = k, start, True
                state, made = step(state, v)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], [*columns, *more.names])

    sorted_rows = rows.repartition(by).sortWithinPartitions(by, *order)
    return sorted_rows.mapInArrow(run, StructType([*rows.schema, *more]))
