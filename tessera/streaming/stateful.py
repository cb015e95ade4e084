"""Streaming forms of the per-field reference and the dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_cross_record(stream: DataFrame, order: str, field: str, key: str, keys: int = 64) -> DataFrame:
    """(key, order, field, same_flag) as rows arrive: whether a field repeats its key's row before.

    State is one value a key; rows of a batch are taken in the given order.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        seen = state.exists
        g = pd.concat(list(batches)).sort_values(order)
        values = g[field].astype(object).where(g[field].notna(), None).tolist()
        flags = []
        for v in values:
            flags.append(int(seen and v == last))
            last, seen = v, True
        state.update((last,))
        yield pd.DataFrame({"key": k[0], "ord": g[order].to_numpy(), "field": values, "same_flag": flags})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias(order), F.col(field).cast("string").alias(field))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ord long, field string, same_flag int", "last string", "append", GroupStateTimeout.NoTimeout)


def stream_dictionary(stream: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, value, cnt), running counts; ids are ranks over the result table."""
    return stream.groupBy(F.col(kind).alias("kind"), F.col(value).alias("value")).agg(F.count("*").alias("cnt"))
