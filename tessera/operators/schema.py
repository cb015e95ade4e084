"""Schema inference: types, integer hints, enum variants, prefixes, decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

SAMPLE, ENUM_MOST, SCHEMA_ENUM_MOST = 1000, 256, 64


def int_hints(sample: DataFrame) -> DataFrame:
    """(path, int_hint) from (path, pos, v): the first SAMPLE values of each path decide."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = sample.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= SAMPLE).withColumn("d", F.col("v") - F.lag("v").over(w))
    a = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), (F.max("v") - F.min("v")).alias("span"), F.array_sort(F.collect_list(F.abs("d"))).alias("ds"))
    median = F.element_at("ds", (F.floor(F.size("ds") / 2) + 1).cast("int"))  # the upper one; at most SAMPLE values
    hint = F.when(F.col("n") < 2, "Flat").when(F.col("lo") == F.col("hi"), "Sequential").when(F.col("lo") >= 0, "Monotonic").when((F.col("span") > 0) & (median * 10 <= F.col("span")), "Clustered").otherwise("Flat")
    return a.select("path", hint.alias("int_hint"))


def float_fixed(sample: DataFrame) -> DataFrame:
    """(path, decimals): the fewest decimals, 0 to 6, that suit the first SAMPLE values within 1e-6; null if none."""
    rows = sample.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).filter(F.col("rn") <= SAMPLE)
    ok = [F.every(F.abs(F.col("v") * F.lit(float(10**d)) - F.round(F.col("v") * F.lit(float(10**d)))) < F.lit(1e-6)).alias(f"d{d}") for d in range(7)]
    return rows.groupBy("path").agg(*ok).select("path", F.coalesce(*[F.when(F.col(f"d{d}"), d) for d in range(7)]).alias("decimals"))


def enum_variants(df: DataFrame, col: str) -> DataFrame:
    """(variant, cnt, idx) by frequency, then bytes."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("variant")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("idx", (F.row_number().over(Window.orderBy(F.col("cnt").desc(), "variant")) - 1).cast("long"))


def first_seen(df: DataFrame, col: str) -> DataFrame:
    """(variant, first_row, idx) by first position."""
    first = df.groupBy(F.col(col).alias("variant")).agg(F.min("row_idx").alias("first_row"))
    return first.withColumn("idx", (F.row_number().over(Window.orderBy("first_row")) - 1).cast("long"))


def cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n_distinct, is_enum64, is_enum256), exact."""
    n = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "col", "v").groupBy("col").agg(F.countDistinct("v").alias("n_distinct"))
    return n.withColumn("is_enum64", F.col("n_distinct") <= SCHEMA_ENUM_MOST).withColumn("is_enum256", F.col("n_distinct") <= ENUM_MOST)


def prefix_profile(df: DataFrame, col: str) -> DataFrame:
    """(prefix, min_len, max_len, all_digits, lossless): the common prefix without trailing digits, and whether prefix and padded number give every value back."""
    c = F.col(col)
    ends = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).select(F.regexp_replace(S.common_prefix(F.col("a"), F.col("b")), "[0-9]+$", "").alias("prefix"))
    rest = F.substring(c, F.length("prefix") + 1, F.lit(1 << 30))
    each = df.join(F.broadcast(ends)).select("prefix", rest.alias("r"))  # one row
    a = each.groupBy("prefix").agg(F.min(F.length("r")).cast("long").alias("min_len"), F.max(F.length("r")).cast("long").alias("max_len"), F.every(F.col("r").rlike("^[0-9]{1,18}$")).alias("all_digits"), F.bool_or(F.col("r").rlike("^0[0-9]")).alias("zeros"))
    return a.select("prefix", "min_len", "max_len", "all_digits", (F.col("all_digits") & ((F.col("min_len") == F.col("max_len")) | ~F.col("zeros"))).alias("lossless"))


def infer(cells: DataFrame) -> DataFrame:
    """(path, field_type, int_hint, decimals, n_variants) from (path, pos, kind, str_val, int_val, float_val).

    kind: str, int, float, bool or null. Nulls are ignored; mixtures other than int with float are Str.
    """
    k = lambda *names: F.count_if(F.col("kind").isin(*names))
    a = cells.groupBy("path").agg(F.count_if(F.col("kind") != "null").alias("n"), k("int").alias("i"), k("float").alias("f"), k("bool").alias("b"), k("str").alias("s"), F.min("str_val").alias("lo"), F.max("str_val").alias("hi"), F.countDistinct("str_val").alias("distinct"))
    ints = int_hints(cells.filter("kind = 'int'").select("path", "pos", F.col("int_val").alias("v")))
    floats = float_fixed(cells.filter("kind = 'float'").select("path", "pos", F.col("float_val").alias("v")))
    n = F.col("n")
    kind = (
        F.when(n == 0, "Null").when(F.col("i") == n, "Integer").when(F.col("f") == n, F.when(F.col("decimals").isNotNull(), "FloatFixed").otherwise("Float")).when(F.col("i") + F.col("f") == n, "Float").when(F.col("b") == n, "Bool").when(F.col("s") == n, F.when(S.is_timestamp(F.col("lo")), "Timestamp").when(F.col("distinct") <= SCHEMA_ENUM_MOST, "Enum").when(F.length(S.common_prefix(F.col("lo"), F.col("hi"))) > 0, "StrPrefix").otherwise("Str")).otherwise("Str")
    )
    out = a.join(ints, "path", "left").join(floats, "path", "left").withColumn("field_type", kind)
    return out.select("path", "field_type", F.when(F.col("field_type") == "Integer", F.col("int_hint")).alias("int_hint"), F.when(F.col("field_type") == "FloatFixed", F.col("decimals")).alias("decimals"), F.when(F.col("field_type") == "Enum", F.col("distinct")).alias("n_variants"))


def cells_of(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """Typed cells of flat columns: (path, pos, kind, str_val, int_val, float_val)."""
    types = dict(df.dtypes)
    out = []
    for c in cols:
        t = types[c]
        kind = "int" if t in ("int", "bigint", "smallint", "tinyint") else "float" if t in ("double", "float") else "bool" if t == "boolean" else "str"
        v = F.col(c)
        out.append(F.struct(F.lit(c).alias("path"), F.when(v.isNull(), "null").otherwise(kind).alias("kind"), (v.cast("string") if kind == "str" else F.lit(None).cast("string")).alias("str_val"), (v.cast("long") if kind == "int" else F.lit(None).cast("long")).alias("int_val"), (v.cast("double") if kind == "float" else F.lit(None).cast("double")).alias("float_val")))
    return df.select(F.col(order).alias("pos"), F.explode(F.array(*out)).alias("x")).select("x.path", "pos", "x.kind", "x.str_val", "x.int_val", "x.float_val")
