"""JSON as relations: canonical form, tokens, flattening, sub-tables and back.

Parsing and canonical form are strict: no trailing content, no numbers outside 64 bits where they
are integers; duplicate keys are refused. There is one definition of both, which runs per document in Arrow
batches, as Spark's own JSON and VARIANT parsers let such texts through.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: token kinds
OBJ_OPEN, OBJ_CLOSE, ARR_OPEN, ARR_CLOSE, KEY, STR, INT, FLOAT, BOOL, NULL = range(10)
I64 = 1 << 63


class BadJson(ValueError):
    pass


def _object(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise BadJson("duplicate key")
    return out


def _int(s: str) -> int:
    v = int(s)
    if not -I64 <= v < I64:
        raise BadJson("integer outside 64 bits")
    return v


def _float(s: str):
    v = float(s)
    if math.isinf(v):
        raise BadJson("number out of range")
    return int(v) if v.is_integer() and abs(v) < 2**53 else v


def _constant(s: str):
    raise BadJson(s)


def parse(text: str):
    """The document; integral floats are integers; raises BadJson."""
    try:
        return json.loads(text, object_pairs_hook=_object, parse_int=_int, parse_float=_float, parse_constant=_constant)
    except (ValueError, RecursionError) as e:
        raise BadJson(str(e)) from e


def _ordered(v):
    if isinstance(v, dict):
        return {k: _ordered(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass"))}
    return [_ordered(x) for x in v] if isinstance(v, list) else v


def dump(v) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def canonical(text: str) -> str:
    """Keys in byte order, no blanks, integral floats as integers, minimal escapes."""
    return dump(_ordered(parse(text)))


def tokens(value, path: tuple = (), depth: int = 0):
    """(kind, path, depth, value) of a document, depth first, keys in byte order; arrays add nothing to the path."""
    if isinstance(value, dict):
        yield OBJ_OPEN, path, depth, None
        for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass")):
            yield KEY, (*path, k), depth + 1, k
            yield from tokens(value[k], (*path, k), depth + 1)
        yield OBJ_CLOSE, path, depth, None
    elif isinstance(value, list):
        yield ARR_OPEN, path, depth, None
        for x in value:
            yield from tokens(x, path, depth + 1)
        yield ARR_CLOSE, path, depth, None
    else:
        kind = NULL if value is None else BOOL if isinstance(value, bool) else INT if isinstance(value, int) else FLOAT if isinstance(value, float) else STR
        yield kind, path, depth, value


def tokens_to_value(rows):
    """The document of (kind, value) tokens."""
    stack: list = [[]]
    keys: list = []
    for kind, value in rows:
        if kind in (OBJ_OPEN, ARR_OPEN):
            stack.append({} if kind == OBJ_OPEN else [])
            continue
        if kind == KEY:
            keys.append(value)
            continue
        item = stack.pop() if kind in (OBJ_CLOSE, ARR_CLOSE) else value
        top = stack[-1]
        if isinstance(top, dict):
            top[keys.pop()] = item
        else:
            top.append(item)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise BadJson("tokens don't make one document")
    return stack[0][0]


TOKEN_SCHEMA = "doc_id long, pos long, depth int, path array<string>, kind int, str_val string, int_val long, float_val double, bool_val boolean"


def tokenize(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The token table of a column of JSON texts; texts that don't parse have no tokens."""

    def run(batches):
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    doc = parse(text) if text is not None else None
                except BadJson:
                    continue
                if text is None:
                    continue
                for pos, (kind, path, depth, v) in enumerate(tokens(doc)):
                    rows.append((key, pos, depth, list(path), kind, v if kind in (KEY, STR) else None, v if kind == INT else None, v if kind == FLOAT else None, v if kind == BOOL else None))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "pos", "depth", "path", "kind", "str_val", "int_val", "float_val", "bool_val"])

    return df.select(F.col(id_col).cast("long"), F.col(json_col)).mapInArrow(run, TOKEN_SCHEMA)


def leaves(value):
    """(path, scalar) of a document, by a walk that no depth can exhaust; arrays add nothing to the path."""
    stack = [((), value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend(((*path, k), x) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            stack.extend((path, x) for x in reversed(v))
        else:
            yield path, v


def dotted(path: tuple) -> str:
    """Path as one text; dots and backslashes inside a key are escaped, so that different paths stay different."""
    return ".".join(k.replace("\\", "\\\\").replace(".", "\\.") for k in path)


def flatten(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, v): scalars by dotted path, parsed strictly; texts that don't parse have no rows. Batches of bounded size, without a shuffle."""
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, paths, values = [], [], []

            def made(b=b):
                return pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[id_col, "path", "v"])

            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    doc = parse(text) if text is not None else {}
                except BadJson:
                    continue
                for path, v in leaves(doc):
                    keys.append(key)
                    paths.append(dotted(path))
                    values.append(v if v is None or isinstance(v, str) else dump(v))
                    if len(keys) == 1 << 16:
                        yield made()
                        keys, paths, values = [], [], []
            yield made()

    return df.select(id_col, json_col).mapInArrow(run, f"`{id_col}` {kind}, path string, v string")


def canonical_json(df: DataFrame, json_col: str, out: str) -> DataFrame:
    """df with the canonical form of a column of JSON texts; null where a text isn't strict JSON."""
    types = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches):
        for b in batches:
            made = []
            for text in b.column(b.schema.get_field_index(json_col)).to_pylist():
                try:
                    made.append(None if text is None else canonical(text))
                except BadJson:
                    made.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, types)


def item_type(values: list) -> str | None:
    """What a sub-table's elements are: "scalars", "objects" of one list of keys, else None; an empty one is of scalars."""
    if all(not isinstance(v, (dict, list)) for v in values):
        return "scalars"
    if all(isinstance(v, dict) for v in values) and len({tuple(v) for v in values}) == 1 and values[0]:
        return "objects"
    return None


def item_types(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, n_items, item_type) of a column of JSON arrays; nulls where a text isn't one."""
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, types = [], []
            for text in b.column(1).to_pylist():
                try:
                    doc = parse(text) if text is not None else None
                except BadJson:
                    doc = None
                n.append(len(doc) if isinstance(doc, list) else None)
                types.append(item_type(doc) if isinstance(doc, list) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(types, pa.string())], names=[id_col, "n_items", "item_type"])

    return df.select(id_col, json_col).mapInArrow(run, f"`{id_col}` {kind}, n_items long, item_type string")


def homogeneous(df: DataFrame, doc_col: str, keys_col: str) -> DataFrame:
    """(doc, n_rows, is_homogeneous): two rows or more, all with one list of keys."""
    return df.groupBy(doc_col).agg(F.count("*").alias("n_rows"), F.countDistinct(keys_col).alias("k")).select(doc_col, "n_rows", ((F.col("n_rows") >= 2) & (F.col("k") == 1)).alias("is_homogeneous"))


def to_subtable(df: DataFrame, parent: str, order: str, cols: list[str]) -> DataFrame:
    """(parent, items): the rows of a parent as an ordered array of structs."""
    return df.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("items"))


def from_subtable(df: DataFrame, parent: str) -> DataFrame:
    """The rows of the arrays again."""
    return df.select(parent, F.posexplode("items").alias("elem_idx", "item")).select(parent, "elem_idx", "item.*")


def is_json_text(text: bytes) -> bool:
    return re.match(rb"[ \t\r\n]*[\[{]", text) is not None
