"""User functions over rows, with failures kept as rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_items(df: DataFrame, func: Callable, result_type: str, column: str) -> DataFrame:
    """``func`` on each value of ``column``; a failed item gives NULL and its ``error`` text.

    Every partition is processed in Arrow batches; nothing is gathered.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for batch in batches:
            results, errors = [], []
            for item in batch[column]:
                try:
                    results.append(func(item))
                    errors.append(None)
                except Exception as e:  # kept as data
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(result=pd.Series(results, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    return df.mapInPandas(run, f"{schema}, result {result_type}, error string")


def outcome_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("error").isNull()).alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
