"""Ordered operators: delta, pattern, period, run-length, cross-record and back-reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .ordering import in_chunk

MAX_PERIOD = 512


def delta_encode(df: DataFrame, col: str) -> DataFrame:
    """(row_idx, chunk_id, delta): differences inside a chunk, whose first row keeps its value; 64-bit wrap-around."""
    before = F.lag(col).over(in_chunk())
    return df.select("row_idx", "chunk_id", F.when(before.isNull(), F.col(col).cast("long")).otherwise(S.minus(F.col(col), before)).alias("delta"))


def delta_decode(df: DataFrame) -> DataFrame:
    """(row_idx, v) from (row_idx, chunk_id, delta)."""
    total = F.sum(F.col("delta").cast("decimal(20,0)")).over(in_chunk())
    # wrapped differences sum to the value modulo 2^64
    whole = F.lit(str(S.TWO64)).cast("decimal(38,0)")
    return df.select("row_idx", S.wrapping(F.pmod(total.cast("decimal(38,0)"), whole)).alias("v"))


def path_delta(df: DataFrame, group: str, order: str, col: str) -> DataFrame:
    """Differences along a path that start from 0 and never restart."""
    before = F.coalesce(F.lag(col).over(Window.partitionBy(group).orderBy(order)), F.lit(0))
    return df.withColumn("delta", S.minus(F.col(col), before))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per (chunk_id, col): n, min_v, max_v, min_d, max_d, max_abs_delta, first_v and the integer pattern."""
    long = df.unpivot(["chunk_id", "row_idx"], cols, "col", "v").withColumn("v", F.col("v").cast("long"))
    w = Window.partitionBy("chunk_id", "col").orderBy("row_idx")
    d = long.withColumn("d", S.minus(F.col("v"), F.lag("v").over(w)))
    out = d.groupBy("chunk_id", "col").agg(F.count("*").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.max(F.abs("d")).alias("max_abs_delta"), F.min_by("v", "row_idx").alias("first_v"), F.sum(S.varint_length(S.zigzag(F.col("v")))).alias("flat_bytes"), F.sum(F.coalesce(S.varint_length(S.zigzag(F.col("d"))), F.lit(0))).alias("delta_bytes"))
    return out.withColumn("pattern", pattern())


def pattern() -> Column:
    """The integer pattern of a profiled column, first rule that holds."""
    span = F.col("max_v") - F.col("min_v")
    return F.when(F.col("n") < 2, "Random").when(F.col("min_d") == F.col("max_d"), "Sequential").when(F.col("max_abs_delta") <= 8, "Clustered").when((F.col("min_d") >= 0) & (F.col("max_d") < 1024), "Monotonic").when((span > 0) & (F.col("max_abs_delta") < F.floor(span / 2)), "Bounded").otherwise("Random")


def encoded_bytes() -> Column:
    """Body bytes of the delta encoding of a profiled column."""
    size = lambda c: S.varint_length(S.zigzag(c))
    n = S.varint_length(F.col("n"))
    return F.when(F.col("pattern") == "Sequential", 1 + size(F.col("first_v")) + size(F.col("min_d")) + n).when(F.col("pattern") == "Random", 1 + n + F.col("flat_bytes")).otherwise(1 + n + size(F.col("first_v")) + F.col("delta_bytes"))


def run_length(df: DataFrame, col: str) -> DataFrame:
    """(chunk_id, start_row, v, run): runs of equal neighbours inside a chunk, nulls equal."""
    changed = F.when(F.lag("row_idx").over(in_chunk()).isNull() | ~F.col(col).eqNullSafe(F.lag(col).over(in_chunk())), 1).otherwise(0)
    runs = df.select("chunk_id", "row_idx", col, changed.alias("_new")).withColumn("_run", F.sum("_new").over(in_chunk()))
    return runs.groupBy("chunk_id", "_run").agg(F.min("row_idx").alias("start_row"), F.first(col).alias("v"), F.count("*").alias("run")).drop("_run")


def run_expand(runs: DataFrame) -> DataFrame:
    """(row_idx, v) from (start_row, v, run)."""
    return runs.select("start_row", "v", F.posexplode(F.array_repeat("v", F.col("run").cast("int"))).alias("i", "_")).select((F.col("start_row") + F.col("i")).alias("row_idx"), "v")


def cross_record(df: DataFrame, fields: list[str]) -> DataFrame:
    """(row_idx, chunk_id, field, same_flag, value): 1 and no value where a field repeats the row before it."""
    long = df.select("row_idx", "chunk_id", *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(["row_idx", "chunk_id"], fields, "field", "v")
    w = Window.partitionBy("field", "chunk_id").orderBy("row_idx")
    same = (F.lag("row_idx").over(w).isNotNull() & F.col("v").eqNullSafe(F.lag("v").over(w))).cast("int")
    return long.withColumn("same_flag", same).select("row_idx", "chunk_id", "field", "same_flag", F.when(F.col("same_flag") == 0, F.struct("v")).alias("stored"))


def cross_record_decode(df: DataFrame) -> DataFrame:
    """(row_idx, field, v)."""
    w = Window.partitionBy("field", "chunk_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("row_idx", "field", F.last("stored", ignorenulls=True).over(w)["v"].alias("v"))


def detect_period(df: DataFrame, col: str) -> DataFrame:
    """(chunk_id, col, n, period): the least p up to min(512, n / 2) with v[i] = v[i mod p], n >= 4; else null.

    Only p at which the first value comes again are tried, each by comparing rows with the base rows.
    """
    i = F.col("row_idx") - F.min("row_idx").over(Window.partitionBy("chunk_id"))
    rows = df.select("chunk_id", i.cast("long").alias("i"), F.col(col).alias("v"))
    size = rows.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min_by(F.struct("v"), "i").alias("v0"))
    cands = rows.join(size, "chunk_id").filter((F.col("i") >= 1) & (F.col("i") <= F.least(F.lit(MAX_PERIOD), F.floor(F.col("n") / 2))) & F.col("v").eqNullSafe(F.col("v0.v")) & (F.col("n") >= 4)).select("chunk_id", F.col("i").alias("p"))
    base = rows.filter(F.col("i") < MAX_PERIOD).select(F.col("chunk_id").alias("bc"), F.col("i").alias("bi"), F.col("v").alias("bv"))
    tried = rows.join(cands, "chunk_id").withColumn("bi", F.col("i") % F.col("p"))
    bad = tried.join(base, (F.col("chunk_id") == F.col("bc")) & (tried["bi"] == base["bi"])).filter(~F.col("v").eqNullSafe(F.col("bv"))).select("chunk_id", "p").distinct()
    good = cands.join(bad, ["chunk_id", "p"], "left_anti").groupBy("chunk_id").agg(F.min("p").alias("period"))
    return size.join(good, "chunk_id", "left").select("chunk_id", F.lit(col).alias("col"), "n", "period")


def back_references(df: DataFrame, cols: list[str]) -> DataFrame:
    """(chunk_id, col, src_col): the first earlier column of the chunk with the same values; null if none."""
    names = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), F.xxhash64(F.col("row_idx"), F.col(c).cast("string")).alias("h"), F.hash(F.col(c).cast("string"), F.col("row_idx")).alias("g")) for i, c in enumerate(cols)])
    marks = df.select("chunk_id", F.explode(names).alias("x")).groupBy("chunk_id", "x.pos", "x.col").agg(F.sum(F.col("x.h").cast("decimal(38,0)")).alias("h"), F.sum("x.g").alias("g"), F.count("*").alias("n"))
    first = Window.partitionBy("chunk_id", "h", "g", "n").orderBy("pos")
    return marks.withColumn("src", F.first("col").over(first)).select("chunk_id", "col", F.when(F.col("src") != F.col("col"), F.col("src")).alias("src_col"))
