"""Ordered folds: state carried from row to row of a key, in one streaming pass over sorted partitions."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], new_state: Callable[[], Any], step: Callable[[Any, Any], dict], schema: str) -> DataFrame:
    """Calls step(state, row) for each row of a key in order; its dict joins the key columns as an output row.

    Partitions are sorted by key and order, and a task holds one state and one Arrow batch at a
    time, so a key's length bounds no memory. A key is worked on by one task: its state
    depends on every row before. Keys with null are keys like others.
    """
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = namedtuple("Row", names)._make
        at, state = None, None
        for batch in batches:
            out = []
            for row in map(make, zip(*(c.to_pylist() for c in batch.columns))):
                key = tuple(getattr(row, k) for k in keys)
                if state is None or key != at:
                    at, state = key, new_state()
                out.append({**dict(zip(keys, key)), **step(state, row)})
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
