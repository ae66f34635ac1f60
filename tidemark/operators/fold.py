"""Folds over the rows of a key in their order, with a small state that tasks carry from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: (state, row) -> (state, the rows that this row gives); the state is None where a key begins, the row None where it ends.
Step = Callable[[object, dict | None], tuple[object, list[dict]]]


def folded(df: DataFrame, by: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """What step gives for the rows of each key `by`, sorted by `order`; rows hold `by`, then the columns of schema.

    Spark sorts the rows of a partition (and spills); a task holds one batch and one state, so a key may be of any size.
    Its rows go through one task, so pass numbers, not texts. Null keys are keys of their own, one for each column's null.
    """
    out = StructType([*[df.schema[c] for c in by], *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows: list[dict] = []
            for row in batch.to_pylist():
                now = tuple(row[c] for c in by)
                if now != key:
                    if key is not None:
                        rows += [dict(zip(by, key, strict=True)) | r for r in step(state, None)[1]]
                    key, state = now, None
                state, given = step(state, row)
                rows += [dict(zip(by, key, strict=True)) | r for r in given]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(by, key, strict=True)) | r for r in step(state, None)[1]], schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out)
