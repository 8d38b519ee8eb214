"""Copy counts of rows that arrive on two streams, for extracts that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowproof.operators.compare import counts


def arriving_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """h, an, bn over two streams of hashed rows; the state is one small row for each distinct hash. Use output mode "update" or "complete"."""
    return counts(a, b)
