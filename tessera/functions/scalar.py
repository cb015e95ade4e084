"""Scalar functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = 1 << 64


def wrapping(c: Column) -> Column:
    """A decimal value folded into a signed 64-bit integer."""
    half, whole = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(TWO64)).cast("decimal(38,0)")
    c = c.cast("decimal(38,0)")
    return F.when(c >= half, c - whole).when(c < -half, c + whole).otherwise(c).cast("long")


def minus(a: Column, b: Column) -> Column:
    """a - b with 64-bit wrap-around."""
    return wrapping(a.cast("decimal(20,0)") - b.cast("decimal(20,0)"))


def zigzag(c: Column) -> Column:
    """Signed to unsigned by alternation; the signed view of the unsigned result."""
    c = c.cast("long")
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1).cast("long"))))


def varint_length(c: Column) -> Column:
    """Bytes of the LEB128 form of the unsigned view of a long."""
    return F.floor((F.length(F.bin(c)) + 6) / 7).cast("long")


def fnv1a_32(c: Column) -> Column:
    """FNV-1a over a string's UTF-8 bytes."""
    # fixed values: offset basis 2166136261, prime 16777619
    hexed = F.hex(F.encode(c, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(hexed)), F.lit(2))
    pairs = F.when(F.length(hexed) > 0, F.transform(at, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(pairs, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings; of a group's min and max it is the group's."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.array_max(at))


def is_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def pack_uuid(c: Column) -> Column:
    return F.unhex(F.replace(c, F.lit("-"), F.lit("")))


def unpack_uuid(c: Column) -> Column:
    h = F.lower(F.hex(c))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def is_timestamp(c: Column) -> Column:
    """Whether a string starts like an ISO date."""
    return c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")


def parse_timestamp(c: Column) -> Column:
    """Epoch seconds of an ISO date or date-time with an optional offset (session zone UTC); null if it isn't one."""
    return F.when(is_timestamp(c), F.unix_seconds(F.try_to_timestamp(c)))


def format_timestamp(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def float_decimals(c: Column, most: int = 9) -> Column:
    """The fewest decimals, up to most, that give the value back within 1e-12; null if none do."""
    fits = [F.when(F.abs(F.round(c * F.lit(float(10**d))) / F.lit(float(10**d)) - c) < F.lit(1e-12), F.lit(d)) for d in range(most + 1)]
    return F.when(~F.isnan(c), F.coalesce(*fits))


def float_class(c: Column) -> Column:
    """0 if an integer, 1 if exact as a 32-bit float, else 2."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 9.0e18), 0).when(c.cast("float").cast("double") == c, 1).otherwise(2)


def json_quote(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def bit_width_ceil(c: Column) -> Column:
    """log2 of the next power of two."""
    return F.when(c <= 1, F.lit(0)).otherwise(F.length(F.bin(c - 1))).cast("long")


def varint_hex(c: Column) -> Column:
    """The LEB128 bytes of the unsigned view of a long, as hexadecimal digits."""
    n = varint_length(c).cast("int")
    seven = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftrightunsigned", c, i * 7).bitwiseAND(F.lit(127).cast("long")) + F.when(i < n - 1, 128).otherwise(0))
    return F.array_join(F.transform(seven, lambda x: F.lpad(F.hex(x), 2, "0")), "")


def varint_from_hex(c: Column) -> Column:
    """The long of varint_hex()."""
    at = F.sequence(F.lit(0), (F.length(c) / 2 - 1).cast("int"))
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", F.conv(F.substring(c, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long")), i * 7)))
