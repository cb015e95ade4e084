"""Schema-driven token encoding: each scalar as its field's type asks, and back; deltas of integer paths.

A schema has one row a path: field_type, decimals of fixed floats, prefix and width of prefixed texts, and
the variants of enums as an array. It is bounded by the number of paths times the most variants of an
enum, and is broadcast only up to SENT_PATHS paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import schema

SENT_PATHS = 10000


def schema_of(cells: DataFrame) -> DataFrame:
    """(path, field_type, int_hint, decimals, prefix, width, variants) of cells (path, pos, kind, str_val, int_val, float_val), as of schema.cells_of().

    variants: an enum's, by frequency, then bytes. prefix: of texts whose rests are digits of one width, or numbers without leading zeros (width 0).
    """
    base = schema.infer(cells).drop("n_variants")
    texts = cells.filter("kind = 'str'")
    counted = texts.join(base.filter("field_type = 'Enum'").select("path"), "path").groupBy("path", "str_val").agg(F.count("*").alias("c"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "str_val")))
    variants = counted.groupBy("path").agg(F.transform(order, lambda x: x["str_val"]).alias("variants"))
    ends = texts.groupBy("path").agg(F.min("str_val").alias("lo"), F.max("str_val").alias("hi"))
    prefix = ends.select("path", F.regexp_replace(S.common_prefix(F.col("lo"), F.col("hi")), "[0-9]+$", "").alias("prefix"))
    rest = F.substring(F.col("str_val"), F.length("prefix") + 1, F.lit(1 << 30))
    each = texts.join(base.filter("field_type = 'StrPrefix'").select("path"), "path").join(prefix, "path").select("path", "prefix", rest.alias("r"))
    shape = each.groupBy("path", "prefix").agg(F.min(F.length("r")).alias("a"), F.max(F.length("r")).alias("b"), F.every(F.col("r").rlike("^[0-9]{1,18}$")).alias("digits"), F.bool_or(F.col("r").rlike("^0[0-9]")).alias("zeros"))
    usable = shape.filter("digits and (a = b or not zeros)").select("path", "prefix", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0).alias("width"))
    return base.join(variants, "path", "left").join(usable, "path", "left")


def _with(tokens: DataFrame, schema_rows: DataFrame) -> DataFrame:
    few = schema_rows.limit(SENT_PATHS + 1).count() <= SENT_PATHS
    return tokens.join(F.broadcast(schema_rows) if few else schema_rows, "path")


def encode(cells: DataFrame, schema_rows: DataFrame) -> DataFrame:
    """(path, pos, kind, code, literal): a number where the field's type has one (an enum's place, a prefixed text's number, epoch seconds, scaled floats, integers), else the literal.

    A number is kept only if it gives the value back.
    """
    c = _with(cells, schema_rows)
    text, kind = F.col("str_val"), F.col("field_type")
    place = F.array_position("variants", text)
    rest = F.substring(text, F.length("prefix") + 1, F.lit(1 << 30))
    suffix = F.when(F.col("prefix").isNotNull() & text.startswith(F.col("prefix")) & rest.rlike("^[0-9]{1,18}$"), rest.cast("long"))
    seconds = S.parse_timestamp(text)
    scaled = F.round(F.col("float_val") * F.pow(F.lit(10.0), F.col("decimals"))).cast("long")
    code = (
        F.when(kind == "Integer", F.col("int_val"))
        .when(kind == "Enum", F.when(place > 0, place - 1))
        .when(kind == "StrPrefix", suffix)
        .when((kind == "Timestamp") & (S.format_timestamp(seconds) == text), seconds)
        .when((kind == "FloatFixed") & (scaled / F.pow(F.lit(10.0), F.col("decimals")) == F.col("float_val")), scaled)
    )
    literal = F.when(F.col("kind") != "null", F.coalesce(text, F.col("int_val").cast("string"), F.col("float_val").cast("string")))
    return c.withColumn("code", code.cast("long")).select("path", "pos", "kind", "code", F.when(F.col("code").isNull(), literal).alias("literal"))


def decode(encoded: DataFrame, schema_rows: DataFrame) -> DataFrame:
    """(path, pos, kind, str_val, int_val, float_val) again."""
    c = _with(encoded, schema_rows)
    kind, code = F.col("field_type"), F.col("code")
    number = code.cast("string")
    text = F.when(kind == "Enum", F.element_at("variants", code.cast("int") + 1)).when(kind == "StrPrefix", F.concat("prefix", F.when(F.length(number) < F.col("width"), F.lpad(number, F.col("width"), F.lit("0"))).otherwise(number))).when(kind == "Timestamp", S.format_timestamp(code))
    is_text = F.col("kind") == "str"
    return c.select(
        "path", "pos", "kind",
        F.when(is_text, F.coalesce(text, "literal")).alias("str_val"),
        F.when(F.col("kind") == "int", F.coalesce(code, F.col("literal").cast("long"))).alias("int_val"),
        F.when(F.col("kind") == "float", F.coalesce(code / F.pow(F.lit(10.0), F.col("decimals")), F.col("literal").cast("double"))).alias("float_val"),
    )


def delta_encode(encoded: DataFrame, schema_rows: DataFrame) -> DataFrame:
    """encoded with the codes of integer and timestamp paths as differences along their path, from 0 on."""
    c = _with(encoded, schema_rows.select("path", "field_type"))
    before = F.coalesce(F.last("code", ignorenulls=True).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("code", F.when(F.col("field_type").isin("Integer", "Timestamp"), S.minus(F.col("code"), before)).otherwise(F.col("code"))).drop("field_type")


def delta_decode(encoded: DataFrame, schema_rows: DataFrame) -> DataFrame:
    c = _with(encoded, schema_rows.select("path", "field_type"))
    run = F.sum(F.col("code").cast("decimal(20,0)")).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.lit(str(S.TWO64)).cast("decimal(38,0)")
    back = S.wrapping(F.pmod(run.cast("decimal(38,0)"), whole))
    return c.withColumn("code", F.when(F.col("field_type").isin("Integer", "Timestamp") & F.col("code").isNotNull(), back).otherwise(F.col("code"))).drop("field_type")


def record_values(tokens: DataFrame) -> DataFrame:
    """The values that a schema is built from: scalars of a token table at a path of their own; the root's scalars and arrays have none."""
    return tokens.filter((F.size("path") > 0) & F.col("kind").between(5, 9))


def has_field(schema_rows: DataFrame, path: str) -> DataFrame:
    """(found, field_type) of a path; one row."""
    return schema_rows.filter(F.col("path") == path).agg((F.count("*") > 0).alias("found"), F.max("field_type").alias("field_type"))


def variant_places(schema_rows: DataFrame) -> DataFrame:
    """(path, place, variant) of every enum."""
    return schema_rows.filter("variants is not null").select("path", F.posexplode("variants").alias("place", "variant"))
