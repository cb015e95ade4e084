"""Explicit row order: row_idx and chunk_id without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 8192


def with_row_idx(df: DataFrame, keys: list[str], chunk: int = CHUNK, buckets: int = 64) -> DataFrame:
    """df with row_idx (rank by keys, from 0) and chunk_id.

    keys must order rows totally; the first must be numeric. Rows are dealt to ranges of the first
    key, ranked inside a range and shifted by the sizes of the ranges below: two shuffles by range,
    no task sees the whole table. The bounds are a few quantiles, the only thing on the driver.
    """
    lead = F.col(keys[0])
    qs = df.agg(F.percentile_approx(lead.cast("double"), [i / buckets for i in range(1, buckets)], 10000).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(float(q)) for q in sorted(set(qs))]) if qs else F.array().cast("array<double>")
    dealt = df.withColumn("_b", F.coalesce(F.size(F.filter(bounds, lambda b: b < lead.cast("double"))), F.lit(0)))
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sizes.select(F.col("_b").alias("_b2"), (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_off"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*keys)))
    out = ranked.join(F.broadcast(offsets), F.col("_b") == F.col("_b2"))  # one row a bucket
    idx = (F.col("_r") - 1 + F.col("_off")).cast("long")
    return out.withColumn("row_idx", idx).withColumn("chunk_id", (idx - idx % chunk) / chunk).withColumn("chunk_id", F.col("chunk_id").cast("long")).drop("_b", "_b2", "_off", "_r")


def in_chunk() -> Window:
    return Window.partitionBy("chunk_id").orderBy("row_idx")
