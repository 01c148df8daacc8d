"""Result streaming: rows of a query one by one, a partition at a time on the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def stream(df: DataFrame, prefetch: bool = True) -> Iterator[dict]:
    for row in df.toLocalIterator(prefetchPartitions=prefetch):
        yield row.asDict(recursive=True)
