"""Row mappers with a life cycle, for what no column expression can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def rich_map(df: DataFrame, schema: str, mapper: Callable, opened: Callable | None = None, closed: Callable | None = None) -> DataFrame:
    """``mapper(batch, resource)`` on Arrow batches. ``opened()`` makes the resource once a task, before its first
    batch; ``closed(resource)`` runs after its last one, also when the task fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resource = opened() if opened else None
        try:
            for batch in batches:
                yield mapper(batch, resource)
        finally:
            if closed:
                closed(resource)

    return df.mapInArrow(run, schema)
