"""Sequential kernels over sorted rows, streamed with constant memory.

Some results depend on every earlier row of a key (an accept-only limiter, a
smoothed value rounded at each step). Rows are hash-partitioned by key, sorted
inside the partition and streamed through a small step function; only the
state of the current key is held. Where a key can be cut at points that reset
the state, callers pass the piece number as part of ``by``, so that one key
spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold_sorted(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    step: Callable[[object, dict], tuple[object, tuple]],
    out_schema: str,
) -> DataFrame:
    """Add columns computed by ``step(state, row) -> (state, values)``; state starts as None per key.

    The step sees Python values (whole numbers stay whole, nulls are None); the
    columns themselves are passed on as they came.
    """
    by, order = list(by), list(order)
    added = T.StructType.fromDDL(out_schema)
    schema = T.StructType([*df.schema.fields, *added.fields])
    columns = df.columns
    key_at = [columns.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        fields = list(to_arrow_schema(added))
        for batch in batches:
            values = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                k = tuple(row[i] for i in key_at)
                if k != key:
                    key, state = k, None
                state, out = step(state, dict(zip(columns, row, strict=True)))
                values.append(out)
            results = [pa.array([v[i] for v in values], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *results], [*batch.schema.names, *(f.name for f in fields)]
            )

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema=schema)
