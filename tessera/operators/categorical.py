"""Dictionary and enum operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DICT_MOST = 65535
KEY, STR = 4, 5  # fixed values: token kinds of keys and strings
#: A dictionary has at most DICT_MOST entries, so it may be broadcast.


def build(tokens: DataFrame, min_freq: int = 1) -> DataFrame:
    """(kind, value, cnt, dict_id) of keys and strings seen min_freq times: by frequency, kind, bytes; at most DICT_MOST."""
    counts = tokens.filter(F.col("kind").isin(KEY, STR) & F.col("value").isNotNull()).groupBy("kind", "value").agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= min_freq)
    top = counts.orderBy(F.col("cnt").desc(), "kind", "value").limit(DICT_MOST)  # a top-k, bounded by the format
    return top.withColumn("dict_id", (F.row_number().over(Window.orderBy(F.col("cnt").desc(), "kind", "value")) - 1).cast("long"))


def encode(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tokens with dict_id, or the literal where the dictionary lacks it."""
    d = F.broadcast(dictionary.select("kind", "value", "dict_id"))
    return tokens.join(d, ["kind", "value"], "left").withColumn("literal", F.when(F.col("dict_id").isNull(), F.col("value"))).drop("value")


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The tokens' values again; rows with an id the dictionary lacks under their kind are in unknown_ids()."""
    d = F.broadcast(dictionary.select(F.col("kind").alias("k2"), F.col("dict_id").alias("i2"), "value"))
    out = encoded.join(d, (F.col("dict_id") == F.col("i2")) & (F.col("kind") == F.col("k2")), "left")
    return out.withColumn("value", F.coalesce("value", "literal")).drop("k2", "i2", "dict_id", "literal")


def unknown_ids(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Encoded rows whose id is unknown or belongs to another kind."""
    return encoded.filter("dict_id is not null").join(F.broadcast(dictionary.select("kind", "dict_id")), ["kind", "dict_id"], "left_anti")


def global_variants(df: DataFrame, cols: list[str], least_chunks: int = 3, most: int = 256) -> DataFrame:
    """(col, col_kind, n_variants, n_chunks): what chunks may share: EnumRans above four variants and 64 rows, else Enum; None beyond most or under least_chunks."""
    long = df.select("chunk_id", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["chunk_id"], cols, "col", "v")
    a = long.groupBy("col").agg(F.countDistinct("v").alias("n_variants"), F.countDistinct("chunk_id").alias("n_chunks"), F.count("*").alias("n"))
    kind = F.when((F.col("n_chunks") < least_chunks) | (F.col("n_variants") > most), "None").when((F.col("n_variants") > 4) & (F.col("n") >= 64), "EnumRans").otherwise("Enum")
    return a.select("col", kind.alias("col_kind"), "n_variants", "n_chunks")
