"""The registered reference queries, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import categorical, entropy, jsonrel, ordered, schema, tokens
from ..operators.ordering import with_row_idx
from ..session import table
from ..sources import columns, container

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def orders(spark, d):
    return with_row_idx(table(spark, d, "orders"), ["o_orderkey"])


def events(spark, d):
    return with_row_idx(table(spark, d, "events"), ["event_id"])


def lineitem(spark, d):
    df = table(spark, d, "lineitem")
    return with_row_idx(df, ["l_orderkey", *[c for c in df.columns if c != "l_orderkey"]])


_IDX = "CAST(row_number() OVER (ORDER BY {}) - 1 AS BIGINT) AS row_idx"
_O = f"o0 AS (SELECT *, {_IDX.format('o_orderkey')} FROM orders), o AS (SELECT *, row_idx // 8192 AS chunk_id FROM o0)"
_E = f"e0 AS (SELECT *, {_IDX.format('event_id')} FROM events), e AS (SELECT *, row_idx // 8192 AS chunk_id FROM e0)"
_LKEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_L = f"l0 AS (SELECT *, {_IDX.format(_LKEYS)} FROM lineitem), l AS (SELECT *, row_idx // 8192 AS chunk_id FROM l0)"
_DELTA = "coalesce(o_custkey - lag(o_custkey) OVER (PARTITION BY chunk_id ORDER BY row_idx), o_custkey)"
_ZZ = "CASE WHEN {0} >= 0 THEN 2 * {0} ELSE -2 * {0} - 1 END"
_VL = "CAST(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 WHEN {0} < 34359738368 THEN 5 ELSE 6 END AS BIGINT)"
_PATTERN = "CASE WHEN n < 2 THEN 'Random' WHEN min_d = max_d THEN 'Sequential' WHEN max_abs_delta <= 8 THEN 'Clustered' WHEN min_d >= 0 AND max_d < 1024 THEN 'Monotonic' WHEN max_v - min_v > 0 AND max_abs_delta < (max_v - min_v) // 2 THEN 'Bounded' ELSE 'Random' END"


def _profile_sql(cte: str, name: str, cols: list[str], out: str) -> str:
    long = " UNION ALL ".join(f"SELECT chunk_id, row_idx, '{c}' AS col, CAST({c} AS BIGINT) AS v FROM {name}" for c in cols)
    zv, zd = _ZZ.format("v"), _ZZ.format("d")
    return f"""WITH {cte}, u AS ({long}),
      d AS (SELECT *, v - lag(v) OVER (PARTITION BY chunk_id, col ORDER BY row_idx) AS d FROM u),
      z AS (SELECT *, {_VL.format('(' + zv + ')')} AS vb, CASE WHEN d IS NULL THEN 0 ELSE {_VL.format('(' + zd + ')')} END AS db FROM d),
      p AS (SELECT chunk_id, col, count(*) AS n, min(v) AS min_v, max(v) AS max_v, min(d) AS min_d, max(d) AS max_d, max(abs(d)) AS max_abs_delta, min_by(v, row_idx) AS first_v, CAST(sum(vb) AS BIGINT) AS flat_bytes, CAST(sum(db) AS BIGINT) AS delta_bytes FROM z GROUP BY chunk_id, col),
      q AS (SELECT *, {_PATTERN} AS pattern FROM p)
      {out}"""


_PROFILE_OUT = "SELECT chunk_id, col, n, min_v, max_v, max_abs_delta, pattern FROM q"
_PROFILE = ("chunk_id", "col", "n", "min_v", "max_v", "max_abs_delta", "pattern")


# order, differences, integers


@query(f"WITH {_O} SELECT row_idx, chunk_id, {_DELTA} AS delta FROM o")
def delta_encode(spark, d):
    return ordered.delta_encode(orders(spark, d), "o_custkey")


@query(f"WITH {_O} SELECT row_idx, o_custkey AS v FROM o")
def delta_decode_roundtrip(spark, d):
    return ordered.delta_decode(delta_encode(spark, d))


@query(_profile_sql(_O, "o", ["o_orderkey", "o_custkey"], _PROFILE_OUT))
def int_pattern_orders(spark, d):
    return ordered.profile(orders(spark, d).select("chunk_id", "row_idx", "o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"]).select(*_PROFILE)


@query(_profile_sql(_L, "l", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], _PROFILE_OUT))
def int_pattern_lineitem(spark, d):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = lineitem(spark, d)
    return ordered.profile(df.select("chunk_id", "row_idx", *[F.col(c).cast("long").alias(c) for c in cols]), cols).select(*_PROFILE)


_SLICE = "o1 AS (SELECT chunk_id, row_idx, o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM o)"


@query(_profile_sql(f"{_O}, {_SLICE}", "o1", ["o_orderkey", "o_custkey", "price"], "SELECT chunk_id, col, n, min_v, max_v, min_d, max_d, max_abs_delta, pattern FROM q"))
def column_strategy_profile(spark, d):
    df = orders(spark, d).select("chunk_id", "row_idx", "o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"))
    return ordered.profile(df, ["o_orderkey", "o_custkey", "price"]).select("chunk_id", "col", "n", "min_v", "max_v", "min_d", "max_d", "max_abs_delta", "pattern")


@query(_profile_sql(f"{_O}, {_SLICE}", "o1", ["o_orderkey", "o_custkey", "price"], f"SELECT chunk_id, col, CAST(CASE WHEN pattern = 'Sequential' THEN 1 + {_VL.format('(' + _ZZ.format('first_v') + ')')} + {_VL.format('(' + _ZZ.format('min_d') + ')')} + {_VL.format('n')} WHEN pattern = 'Random' THEN 1 + {_VL.format('n')} + flat_bytes ELSE 1 + {_VL.format('n')} + {_VL.format('(' + _ZZ.format('first_v') + ')')} + delta_bytes END AS BIGINT) AS body_bytes FROM q"))
def delta_encoded_size(spark, d):
    df = orders(spark, d).select("chunk_id", "row_idx", "o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"))
    return ordered.profile(df, ["o_orderkey", "o_custkey", "price"]).select("chunk_id", "col", ordered.encoded_bytes().cast("long").alias("body_bytes"))


@query(f"WITH {_O}, d AS (SELECT row_idx, {_DELTA} AS delta FROM o) SELECT row_idx, {_ZZ.format('delta')} AS zz FROM d")
def zigzag_values(spark, d):
    return delta_encode(spark, d).select("row_idx", S.zigzag(F.col("delta")).alias("zz"))


@query(f"WITH {_O}, d AS (SELECT {_DELTA} AS delta FROM o), z AS (SELECT {_ZZ.format('delta')} AS zz FROM d) SELECT {_VL.format('zz')} AS bytes, count(*) AS cnt FROM z GROUP BY 1")
def varint_length(spark, d):
    return zigzag_values(spark, d).groupBy(S.varint_length(F.col("zz")).alias("bytes")).agg(F.count("*").alias("cnt"))


@query(f"WITH {_O}, d AS (SELECT row_idx, {_DELTA} AS delta FROM o) SELECT row_idx, delta AS v FROM d")
def zigzag_roundtrip(spark, d):
    return zigzag_values(spark, d).select("row_idx", S.unzigzag(F.col("zz")).alias("v"))


@query(f"WITH {_E}, m AS (SELECT *, (user_id // 100) * 1000 + 7 * (row_idx % 13) AS x FROM e) SELECT 'k' || CAST(user_id % 3 AS VARCHAR) AS path, row_idx, x - coalesce(lag(x) OVER (PARTITION BY user_id % 3 ORDER BY row_idx), 0) AS delta FROM m")
def path_delta(spark, d):
    df = events(spark, d).select(F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("path"), "row_idx", (F.expr("user_id div 100") * 1000 + (F.col("row_idx") % 13) * 7).alias("x"))
    return ordered.path_delta(df, "path", "row_idx", "x").select("path", "row_idx", "delta")


@query(f"WITH {_O} SELECT chunk_id, min(row_idx) AS row_start, max(row_idx) + 1 AS row_end FROM o GROUP BY chunk_id")
def chunk_ranges(spark, d):
    return orders(spark, d).groupBy("chunk_id").agg(F.min("row_idx").alias("row_start"), (F.max("row_idx") + 1).alias("row_end"))


# runs, cross-record, periods, back-references


_RUNS = "WITH {0}, c AS (SELECT *, CASE WHEN lag(row_idx) OVER w IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY chunk_id ORDER BY row_idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY chunk_id ORDER BY row_idx) AS run_id FROM c), g AS (SELECT chunk_id, min(row_idx) AS start_row, min(event_type) AS v, count(*) AS run FROM r GROUP BY chunk_id, run_id)".format(_E)


@query(f"{_RUNS} SELECT chunk_id, start_row, v, run FROM g")
def rle_encode_events(spark, d):
    return ordered.run_length(events(spark, d), "event_type").select("chunk_id", "start_row", "v", "run")


@query(f"WITH {_E} SELECT row_idx, event_type AS v FROM e")
def rle_decode_events(spark, d):
    return ordered.run_expand(rle_encode_events(spark, d))


@query(f"{_RUNS} SELECT CAST(sum(strlen(v) + 1 + CASE WHEN run < 128 THEN 1 ELSE 2 END) AS DOUBLE) / CAST(sum((strlen(v) + 1) * run) AS DOUBLE) AS ratio FROM g")
def rle_ratio(spark, d):
    size = F.octet_length("v") + 1
    return rle_encode_events(spark, d).agg((F.sum(size + S.varint_length(F.col("run"))).cast("double") / F.sum(size * F.col("run")).cast("double")).alias("ratio"))


_CROSS = "f AS (SELECT row_idx, chunk_id, 'event_type' AS field, event_type AS v FROM e UNION ALL SELECT row_idx, chunk_id, 'user_id', CAST(user_id AS VARCHAR) FROM e)"
_SAME = "CASE WHEN lag(row_idx) OVER w IS NOT NULL AND v IS NOT DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END"


@query(f"WITH {_E}, {_CROSS} SELECT row_idx, field, {_SAME} AS same_flag FROM f WINDOW w AS (PARTITION BY field, chunk_id ORDER BY row_idx)")
def cross_record_same(spark, d):
    return ordered.cross_record(events(spark, d), ["event_type", "user_id"]).select("row_idx", "field", "same_flag")


@query(f"WITH {_E}, {_CROSS} SELECT row_idx, field, v FROM f")
def cross_record_decode(spark, d):
    return ordered.cross_record_decode(ordered.cross_record(events(spark, d), ["event_type", "user_id"]))


@query(f"WITH {_E}, {_CROSS}, s AS (SELECT field, lag(row_idx) OVER w AS p, {_SAME} AS s FROM f WINDOW w AS (PARTITION BY field, chunk_id ORDER BY row_idx)) SELECT field, CAST(sum(s) AS DOUBLE) / CAST(count(p) AS DOUBLE) AS ratio FROM s GROUP BY field")
def same_ratio(spark, d):
    rows = ordered.cross_record(events(spark, d), ["event_type", "user_id"])
    first = F.col("row_idx") == F.min("row_idx").over(Window.partitionBy("field", "chunk_id"))
    a = rows.withColumn("later", (~first).cast("int")).groupBy("field").agg(F.sum("same_flag").cast("double").alias("s"), F.sum("later").cast("double").alias("n"))
    return a.select("field", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("ratio"))


@query(f"WITH {_O} SELECT chunk_id, col, count(*) AS n, CAST(CASE WHEN col = 'seven' AND count(*) >= 14 THEN 7 END AS BIGINT) AS period FROM o, (VALUES ('seven'), ('none')) c(col) GROUP BY chunk_id, col")
def period_detect(spark, d):
    df = orders(spark, d).select("chunk_id", "row_idx", (F.col("row_idx") % 7).alias("seven"), F.col("row_idx").alias("none"))
    return ordered.detect_period(df, "seven").union(ordered.detect_period(df, "none"))


@query(f"WITH {_O} SELECT row_idx, (row_idx % 28) * 3 + 1 AS v FROM o")
def period_expand(spark, d):
    base = orders(spark, d).filter("row_idx < 28").select(F.col("row_idx").alias("b"), (F.col("row_idx") * 3 + 1).alias("v"))
    rows = orders(spark, d).select("row_idx")
    return rows.join(F.broadcast(base), rows["row_idx"] % 28 == base["b"]).select("row_idx", "v")  # at most one period of rows


@query(f"WITH {_O} SELECT DISTINCT chunk_id, c.col, c.src_col FROM o, (VALUES ('o_custkey', NULL), ('copy', 'o_custkey'), ('other', NULL)) c(col, src_col)")
def backref_columns(spark, d):
    df = orders(spark, d).select("chunk_id", "row_idx", "o_custkey", F.col("o_custkey").alias("copy"), (F.col("o_custkey") + F.col("row_idx") % 2 + 1).alias("other"))
    return ordered.back_references(df, ["o_custkey", "copy", "other"])


# schema inference


@query("WITH s AS (SELECT user_id AS v, row_number() OVER (ORDER BY event_id) AS rn FROM events), d AS (SELECT v, v - lag(v) OVER (ORDER BY rn) AS d FROM s WHERE rn <= 1000), a AS (SELECT count(*) AS n, min(d) AS lo, max(d) AS hi, max(v) - min(v) AS span, list_sort(list(abs(d)) FILTER (WHERE d IS NOT NULL)) AS ds FROM d) SELECT 'user_id' AS path, CASE WHEN n < 2 THEN 'Flat' WHEN lo = hi THEN 'Sequential' WHEN lo >= 0 THEN 'Monotonic' WHEN span > 0 AND ds[len(ds) // 2 + 1] * 10 <= span THEN 'Clustered' ELSE 'Flat' END AS int_hint FROM a")
def int_hint_events(spark, d):
    return schema.int_hints(table(spark, d, "events").select(F.lit("user_id").alias("path"), F.col("event_id").alias("pos"), F.col("user_id").alias("v")))


@query("SELECT max(CASE " + " ".join(f"WHEN abs(round(c_acctbal * {10**k}.0::DOUBLE) / {10**k}.0::DOUBLE - c_acctbal) < 1e-12 THEN {k}" for k in range(10)) + " END) AS decimals FROM customer")
def float_decimals_customer(spark, d):
    return table(spark, d, "customer").agg(F.max(S.float_decimals(F.col("c_acctbal"))).alias("decimals"))


@query("WITH c AS (SELECT o_orderpriority AS variant, count(*) AS cnt FROM orders GROUP BY 1) SELECT variant, cnt, row_number() OVER (ORDER BY cnt DESC, variant) - 1 AS idx FROM c")
def enum_variants_orders(spark, d):
    return schema.enum_variants(table(spark, d, "orders"), "o_orderpriority")


@query(f"WITH {_E}, f AS (SELECT event_type AS variant, min(row_idx) AS first_row FROM e GROUP BY 1) SELECT variant, first_row, row_number() OVER (ORDER BY first_row) - 1 AS idx FROM f")
def enum_index_first_seen(spark, d):
    return schema.first_seen(events(spark, d), "event_type")


_CARD = ["c_name", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 64 AS is_enum64, count(DISTINCT {c}) <= 256 AS is_enum256 FROM customer" for c in _CARD))
def cardinality_screen(spark, d):
    return schema.cardinality(table(spark, d, "customer"), _CARD)


@query("SELECT * FROM (VALUES ('o_orderkey', 'Integer', 'Sequential', NULL, NULL), ('o_totalprice', 'FloatFixed', NULL, 2, NULL), ('o_orderdate', 'Timestamp', NULL, NULL, NULL)) t(path, field_type, int_hint, decimals, n_variants) UNION ALL SELECT 'o_orderstatus', 'Enum', NULL, NULL, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_orderpriority', 'Enum', NULL, NULL, count(DISTINCT o_orderpriority) FROM orders")
def schema_infer_orders(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return schema.infer(schema.cells_of(df, "o_orderkey", ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"]))


def _prefix_sql(col: str, name: str, prefix: str) -> str:
    n = len(prefix)
    return f"WITH r AS (SELECT substr({col}, {n + 1}) AS r FROM {name}), a AS (SELECT min(length(r)) AS min_len, max(length(r)) AS max_len, bool_and(regexp_full_match(r, '[0-9]{{1,18}}')) AS all_digits, bool_or(regexp_matches(r, '^0[0-9]')) AS zeros FROM r) SELECT '{prefix}' AS prefix, min_len, max_len, all_digits, all_digits AND (min_len = max_len OR NOT zeros) AS lossless FROM a"


@query(_prefix_sql("c_name", "customer", "Customer#"))
def prefix_detect_customer(spark, d):
    return schema.prefix_profile(table(spark, d, "customer"), "c_name")


@query(_prefix_sql("p_brand", "part", "Brand#"))
def prefix_detect_brand(spark, d):
    return schema.prefix_profile(table(spark, d, "part"), "p_brand")


@query("SELECT min(a) AS low, max(a) AS high, count(*) FILTER (WHERE NOT regexp_matches(a, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n_bad FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS a FROM orders)")
def timestamp_sniff(spark, d):
    a = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"))
    return a.agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count_if(~S.is_timestamp(F.col("a"))).alias("n_bad"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch FROM events")
def timestamp_epoch(spark, d):
    return table(spark, d, "events").select("event_id", S.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("epoch"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def timestamp_format(spark, d):
    return timestamp_epoch(spark, d).select("event_id", S.format_timestamp(F.col("epoch")).alias("iso"))


# JSON, flattening, sub-tables


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS canon FROM events")
def json_canonical_events(spark, d):
    return jsonrel.canonical_json(table(spark, d, "events").select("event_id", "props"), "props", "canon").select("event_id", "canon")


@query("WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events) SELECT event_id, t.pos, t.kind, t.path, t.str_val, CASE WHEN t.pos = 2 THEN v END AS int_val FROM k, (VALUES (0::BIGINT, 0, '', NULL), (1, 4, 'k', 'k'), (2, 6, 'k', NULL), (3, 1, '', NULL)) t(pos, kind, path, str_val)")
def json_tokens_events(spark, d):
    t = jsonrel.tokenize(table(spark, d, "events"), "event_id", "props")
    return t.select(F.col("doc_id").alias("event_id"), "pos", "kind", F.array_join("path", ".").alias("path"), "str_val", "int_val")


@query("SELECT path, count(*) AS cnt, count(DISTINCT v) AS n_distinct FROM (SELECT 'id' AS path, CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'user.name', c_name FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'user.segment', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey) WHERE path <> 'id' OR v IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY path")
def json_flatten_nested(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    docs = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("user"))).alias("json"))
    return jsonrel.flatten(docs, "o_orderkey", "json").groupBy("path").agg(F.count("*").alias("cnt"), F.countDistinct("v").alias("n_distinct"))


@query("WITH k AS (SELECT user_id % 50 AS doc, CASE WHEN user_id % 50 = 7 AND event_id % 2 = 0 THEN 'k,x' ELSE 'k' END AS keys FROM events) SELECT doc, count(*) AS n_rows, count(*) >= 2 AND count(DISTINCT keys) = 1 AS is_homogeneous FROM k GROUP BY doc")
def json_homogeneity(spark, d):
    e = table(spark, d, "events")
    extra = F.when((F.col("user_id") % 50 == 7) & (F.col("event_id") % 2 == 0), F.regexp_replace("props", r"\}$", ', "x": 1}')).otherwise(F.col("props"))
    return jsonrel.homogeneous(e.select((F.col("user_id") % 50).alias("doc"), F.array_join(F.json_object_keys(extra), ",").alias("keys")), "doc", "keys")


@query("WITH c AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1) SELECT conv_id, n_turns, CAST(sum(n_turns) OVER (ORDER BY conv_id) - n_turns AS BIGINT) AS start_offset FROM c")
def subtable_counts_conversations(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    ranked = with_row_idx(c, ["conv_id"])
    # offsets inside a chunk of parents, then of the chunks before it: no window over all parents
    w = Window.partitionBy("chunk_id").orderBy("row_idx")
    before = ranked.groupBy("chunk_id").agg(F.sum("n_turns").alias("s")).select(F.col("chunk_id").alias("c2"), (F.sum("s").over(Window.orderBy("chunk_id")) - F.col("s")).alias("off"))
    return ranked.withColumn("at", F.sum("n_turns").over(w) - F.col("n_turns")).join(before, F.col("chunk_id") == F.col("c2")).select("conv_id", "n_turns", (F.col("at") + F.col("off")).alias("start_offset"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS elem_idx, turn, role, text FROM conversations")
def subtable_explode(spark, d):
    t = jsonrel.to_subtable(table(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])
    return jsonrel.from_subtable(t, "conv_id").withColumn("elem_idx", F.col("elem_idx").cast("long"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def subtable_rebuild(spark, d):
    return subtable_explode(spark, d).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def columns_to_rows(spark, d):
    t = jsonrel.to_subtable(table(spark, d, "conversations"), "conv_id", "turn", ["role"])
    return t.select("conv_id", F.array_join(F.transform("items", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT o_orderkey AS row_key, c.col, CASE c.col WHEN 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders, (VALUES ('o_orderstatus'), ('o_orderpriority')) c(col)")
def rows_to_columns(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_key"), "o_orderstatus", "o_orderpriority").unpivot("row_key", ["o_orderstatus", "o_orderpriority"], "col", "v")


@query("SELECT conv_id, count(*) AS n_items, CASE WHEN conv_id % 3 = 0 THEN 'objects' WHEN conv_id % 3 = 1 THEN 'scalars' WHEN count(*) = 1 THEN 'objects' END AS item_type FROM conversations GROUP BY conv_id")
def subtable_typing(spark, d):
    # objects of one list of keys, texts, and objects of which the first turn's has a key more
    more = F.when(F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id")), F.to_json(F.struct("turn", "role", F.lit(1).alias("x")))).otherwise(F.to_json(F.struct("turn", "role")))
    item = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct("turn", "role"))).when(F.col("conv_id") % 3 == 1, S.json_quote(F.col("role"))).otherwise(more)
    rows = table(spark, d, "conversations").select("conv_id", item.alias("item")).groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("items"))
    return jsonrel.item_types(rows, "conv_id", "items")


# dictionaries


def _tokens(spark, d):
    e = table(spark, d, "events")
    keys = e.select("event_id", F.lit(categorical.KEY).alias("kind"), F.explode(F.json_object_keys("props")).alias("value"))
    return keys.union(e.select("event_id", F.lit(categorical.STR), "event_type"))


_TOK = "t AS (SELECT event_id, 4 AS kind, unnest(json_keys(props)) AS value FROM events UNION ALL SELECT event_id, 5, event_type FROM events)"
_DICT = _TOK + ", c AS (SELECT kind, value, count(*) AS cnt FROM t GROUP BY 1, 2{0}), dict AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, kind, value) - 1 AS dict_id FROM c)"


@query(f"WITH {_DICT.format('')} SELECT kind, value, cnt, dict_id FROM dict")
def dictionary_build(spark, d):
    return categorical.build(_tokens(spark, d))


@query(f"WITH {_DICT.format(' HAVING count(*) >= 2000')} SELECT kind, value, cnt, dict_id FROM dict")
def dictionary_min_freq(spark, d):
    return categorical.build(_tokens(spark, d), 2000)


@query(f"WITH {_DICT.format(' HAVING count(*) >= 2000')} SELECT event_id, t.kind, dict_id, CASE WHEN dict_id IS NULL THEN t.value END AS literal FROM t LEFT JOIN dict ON t.kind = dict.kind AND t.value = dict.value")
def dictionary_encode(spark, d):
    t = _tokens(spark, d)
    return categorical.encode(t, categorical.build(t, 2000)).select("event_id", "kind", "dict_id", "literal")


@query(f"WITH {_TOK} SELECT event_id, kind, value FROM t")
def dictionary_decode(spark, d):
    dic = categorical.build(_tokens(spark, d), 2000)
    return categorical.decode(dictionary_encode(spark, d), dic).select("event_id", "kind", "value")


@query(f"WITH {_DICT.format(' HAVING count(*) >= 2000')} SELECT event_id, t.kind, dict_id FROM t JOIN dict ON t.kind = dict.kind AND t.value = dict.value WHERE dict_id <> 0")
def dictionary_unknown_ids(spark, d):
    dic = categorical.build(_tokens(spark, d), 2000).filter("dict_id = 0")
    return categorical.unknown_ids(dictionary_encode(spark, d), dic).select("event_id", "kind", "dict_id")


@query(f"{_RUNS}, f AS (SELECT event_type AS variant, min(row_idx) AS first_row FROM e GROUP BY 1), i AS (SELECT variant, row_number() OVER (ORDER BY first_row) - 1 AS idx FROM f) SELECT start_row, idx, run FROM g JOIN i ON g.v = i.variant")
def enum_runs(spark, d):
    runs, seen = rle_encode_events(spark, d), enum_index_first_seen(spark, d)
    return runs.join(seen, runs["v"] == seen["variant"]).select("start_row", "idx", "run")


@query(f"WITH {_L}, c AS (SELECT chunk_id, 'l_returnflag' AS col, l_returnflag AS v FROM l UNION ALL SELECT chunk_id, 'l_linestatus', l_linestatus FROM l) SELECT col, CASE WHEN count(DISTINCT chunk_id) < 3 OR count(DISTINCT v) > 256 THEN 'None' WHEN count(DISTINCT v) > 4 AND count(*) >= 64 THEN 'EnumRans' ELSE 'Enum' END AS col_kind, count(DISTINCT v) AS n_variants, count(DISTINCT chunk_id) AS n_chunks FROM c GROUP BY col")
def global_variants(spark, d):
    return categorical.global_variants(lineitem(spark, d), ["l_returnflag", "l_linestatus"])


# scalar functions


@query("SELECT 'c_name' AS col, 'Customer#' || repeat('0', 9 - CAST(length(CAST(max(c_custkey) AS VARCHAR)) AS INTEGER)) AS prefix FROM customer")
def common_prefix(spark, d):
    a = table(spark, d, "customer").agg(F.min("c_name").alias("a"), F.max("c_name").alias("b"))
    return a.select(F.lit("c_name").alias("col"), S.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("SELECT c_custkey, md5(c_name) AS h, upper(md5(c_name)) AS packed, CAST(16 AS BIGINT) AS n_bytes FROM customer")
def hex_suffix(spark, d):
    h = F.md5(F.col("c_name").cast("binary"))
    packed = F.unhex(h)
    return table(spark, d, "customer").select("c_custkey", F.lower(F.hex(packed)).alias("h"), F.hex(packed).alias("packed"), F.octet_length(packed).cast("long").alias("n_bytes"))


def _uuid(spark, d):
    h = F.md5(F.col("c_name").cast("binary"))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)).alias("u"))


_UUID = "substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12)"


@query("SELECT c_custkey, upper(md5(c_name)) AS packed FROM customer")
def uuid_pack(spark, d):
    return _uuid(spark, d).filter(S.is_uuid(F.col("u"))).select("c_custkey", F.hex(S.pack_uuid(F.col("u"))).alias("packed"))


@query(f"SELECT c_custkey, {_UUID} AS u FROM customer")
def uuid_unpack(spark, d):
    return _uuid(spark, d).select("c_custkey", S.unpack_uuid(S.pack_uuid(F.col("u"))).alias("u"))


@query("SELECT c_custkey, to_base64(encode(c_name)) AS b64, hex(encode(c_name)) AS packed FROM customer")
def base64_pack(spark, d):
    b = F.base64(F.encode("c_name", "UTF-8"))
    return table(spark, d, "customer").select("c_custkey", b.alias("b64"), F.hex(F.unbase64(b)).alias("packed"))


@query("WITH r AS (SELECT toxic, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels) SELECT i // 8 AS byte_idx, CAST(sum(toxic * (1 << CAST(i % 8 AS INTEGER))) AS BIGINT) AS packed FROM r GROUP BY 1")
def bit_pack_flags(spark, d):
    r = with_row_idx(table(spark, d, "labels"), ["doc_id"])
    return r.groupBy(F.expr("row_idx div 8").alias("byte_idx")).agg(F.sum(F.col("toxic") * F.expr("shiftleft(1, cast(row_idx % 8 as int))")).alias("packed"))


@query("SELECT doc_id, toxic AS flag FROM labels")
def bit_unpack_flags(spark, d):
    r = with_row_idx(table(spark, d, "labels"), ["doc_id"]).select("doc_id", F.expr("row_idx div 8").alias("b"), (F.col("row_idx") % 8).cast("int").alias("k"))
    return r.join(bit_pack_flags(spark, d), F.col("b") == F.col("byte_idx")).select("doc_id", F.expr("cast(getbit(packed, k) as int)").alias("flag"))


@query("SELECT CASE WHEN o_totalprice = floor(o_totalprice) THEN 0 WHEN CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) = o_totalprice THEN 1 ELSE 2 END AS class, count(*) AS cnt FROM orders GROUP BY 1")
def float_encoding_class(spark, d):
    return table(spark, d, "orders").groupBy(S.float_class(F.col("o_totalprice")).alias("class")).agg(F.count("*").alias("cnt"))


@query("WITH RECURSIVE w AS (SELECT n_nationkey, n_name, 1 AS i, 2166136261::BIGINT AS h FROM nation UNION ALL SELECT n_nationkey, n_name, i + 1, (xor(h, ascii(substr(n_name, i, 1))::BIGINT) * 16777619) % 4294967296 FROM w WHERE i <= length(n_name)) SELECT n_nationkey, h AS fnv FROM w WHERE i = length(n_name) + 1")
def fnv1a_names(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.fnv1a_32(F.col("n_name")).alias("fnv"))


@query("SELECT c_custkey, '\"' || c_name || '\"' AS quoted FROM customer")
def json_quoting(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.json_quote(F.col("c_name")).alias("quoted"))


# entropy statistics


_HIST = "h AS (SELECT 'o_orderpriority' AS stream, ascii(c) AS sym, count(*) AS raw FROM (SELECT unnest(string_split(o_orderpriority, '')) AS c FROM orders) GROUP BY 2 UNION ALL SELECT 'o_orderstatus', ascii(c), count(*) FROM (SELECT unnest(string_split(o_orderstatus, '')) AS c FROM orders) GROUP BY 2)"
_NORM = _HIST + ", a AS (SELECT *, CAST(sum(raw) OVER (PARTITION BY stream) AS BIGINT) AS tot FROM h), b AS (SELECT *, greatest(1, raw * 16384 // tot) AS fl FROM a), c AS (SELECT *, greatest(0, raw * 16384 - fl * tot) AS rem, 16384 - CAST(sum(fl) OVER (PARTITION BY stream) AS BIGINT) AS spare FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY CAST(rem AS DOUBLE) / fl DESC, sym DESC) AS rk FROM c), m AS (SELECT *, fl + CASE WHEN rk <= greatest(0, spare) THEN 1 ELSE 0 END AS n0 FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n0 DESC, sym DESC) AS big FROM m), n AS (SELECT stream, sym, raw, CAST(n0 - CASE WHEN big = 1 THEN greatest(0, -spare) ELSE 0 END AS BIGINT) AS norm FROM g)"


def _freq(spark, d):
    return entropy.histogram(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(f"WITH {_HIST} SELECT stream, sym, raw FROM h")
def symbol_histogram(spark, d):
    return _freq(spark, d)


@query(f"WITH {_NORM} SELECT stream, sym, raw, norm FROM n")
def freq_normalize(spark, d):
    return entropy.normalize(_freq(spark, d)).select("stream", "sym", "raw", "norm")


@query(f"WITH {_NORM} SELECT stream, sym, CAST(sum(norm) OVER (PARTITION BY stream ORDER BY sym) - norm AS BIGINT) AS cum FROM n")
def freq_cdf(spark, d):
    return entropy.normalize(_freq(spark, d)).select("stream", "sym", "cum")


@query(f"WITH {_NORM} SELECT stream, CAST(sum(raw * (greatest(0, 14 - CAST(ceil(log2(norm)) AS BIGINT)) + 1)) AS BIGINT) AS est_bits, CAST(sum(raw * (greatest(0, 14 - CAST(ceil(log2(norm)) AS BIGINT)) + 1)) AS BIGINT) // 8 + 1 AS est_bytes FROM n GROUP BY stream")
def bit_cost_estimate(spark, d):
    return entropy.bit_cost(entropy.normalize(_freq(spark, d)))


@query("WITH a AS (SELECT o_orderkey, strlen(o_orderpriority) AS n_bytes, len(list_distinct(string_split(o_orderpriority, ''))) AS n_distinct FROM orders) SELECT o_orderkey, n_bytes, n_distinct, n_bytes < 32 OR n_distinct * 10 > n_bytes * 8 AS skip FROM a")
def distinct_byte_gate(spark, d):
    return entropy.distinct_gate(table(spark, d, "orders"), "o_orderkey", "o_orderpriority")


@query(f"WITH {_E}, p AS (SELECT coalesce(lag(event_type) OVER (PARTITION BY chunk_id ORDER BY row_idx), '^') AS prev, event_type AS sym FROM e) SELECT prev, sym, count(*) AS cnt FROM p GROUP BY 1, 2")
def markov1_counts(spark, d):
    return entropy.order1_counts(events(spark, d), "chunk_id", "row_idx", "event_type")


@query("WITH b AS (SELECT event_type AS context, user_id % 2 AS bit FROM events) SELECT context, count(*) FILTER (WHERE bit = 0) AS n0, count(*) FILTER (WHERE bit = 1) AS n1, 2 * count(*) FILTER (WHERE bit = 0) + 1 AS num, 2 * count(*) + 2 AS den FROM b GROUP BY 1")
def context_kt_estimate(spark, d):
    return entropy.kt_estimate(table(spark, d, "events").withColumn("bit", F.col("user_id") % 2), "event_type", "bit")


@query(f"WITH {_E}, c AS (SELECT chunk_id, count(*) AS n, count(DISTINCT event_type) AS n_distinct, count(DISTINCT user_id) AS n_users FROM e GROUP BY 1) SELECT chunk_id, 'event_type' AS col, CASE WHEN n_distinct <= 256 THEN 'Enum' ELSE 'Str' END AS strategy, n_distinct FROM c")
def column_strategy_events(spark, d):
    a = events(spark, d).groupBy("chunk_id").agg(F.countDistinct("event_type").alias("n_distinct"))
    return a.select("chunk_id", F.lit("event_type").alias("col"), F.when(F.col("n_distinct") <= schema.ENUM_MOST, "Enum").otherwise("Str").alias("strategy"), "n_distinct")


# containers: decode(encode(x)) is x, so the source is the oracle


def _user_docs(spark, d):
    e = table(spark, d, "events")
    rows = e.groupBy((F.col("user_id") % 97).alias("doc")).agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("a_id"), F.col("event_type").alias("b_type"), (F.col("user_id") % 7).alias("c_mod")))).alias("r"))
    return rows.select("doc", F.to_json("r").alias("json"))


@query("SELECT user_id % 97 AS doc, '[' || string_agg('{\"a_id\":' || event_id || ',\"b_type\":\"' || event_type || '\",\"c_mod\":' || user_id % 7 || '}', ',' ORDER BY event_id) || ']' AS text FROM events GROUP BY 1")
def container_roundtrip(spark, d):
    return container.decode_documents(container.encode_documents(_user_docs(spark, d), "doc", "json"), "doc").select("doc", "text")


@query("SELECT page_id, html AS text FROM pages")
def passthrough_roundtrip(spark, d):
    return container.decode_documents(container.encode_documents(table(spark, d, "pages"), "page_id", "html"), "page_id").select("page_id", "text")


@query("SELECT page_id, 0 AS idx, 'data' AS type, 48::BIGINT AS \"offset\", strlen(html) AS length, true AS ok FROM pages")
def sections_view(spark, d):
    s = container.sections_of(container.encode_documents(table(spark, d, "pages"), "page_id", "html"), "page_id")
    return s.select("page_id", "idx", "type", "offset", "length", "ok")


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS text FROM events")
def two_pass_roundtrip(spark, d):
    t = jsonrel.tokenize(table(spark, d, "events"), "event_id", "props")
    packed = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "str_val", "int_val", "float_val", "bool_val"))).alias("t"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = []
            for rows in b.column(1).to_pylist():
                pairs = [(r["kind"], next((r[k] for k in ("str_val", "int_val", "float_val", "bool_val") if r[k] is not None), None)) for r in rows]
                texts.append(jsonrel.dump(jsonrel.tokens_to_value(pairs)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["event_id", "text"])

    return packed.mapInArrow(run, "event_id long, text string")


@query("SELECT item_id, text FROM benchmark")
def rans_roundtrip(spark, d):
    return container.coded_roundtrip(table(spark, d, "benchmark"), "item_id", "text", "rans").select("item_id", "text")


@query("SELECT item_id, text FROM benchmark")
def ctw_roundtrip(spark, d):
    return container.coded_roundtrip(table(spark, d, "benchmark"), "item_id", "text", "ctw").select("item_id", "text")


@query("SELECT c_custkey, c_name AS text FROM customer")
def auto_codec_roundtrip(spark, d):
    return container.coded_roundtrip(table(spark, d, "customer"), "c_custkey", "c_name", "auto").select("c_custkey", "text")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN '100' WHEN 3 THEN NULL WHEN 4 THEN '{\"a\":2,\"b\":' || CAST(event_id AS VARCHAR) || '}' WHEN 5 THEN '[' || CAST(event_id AS VARCHAR) || ',1.5]' END AS canon FROM events")
def json_canonical_mixed(spark, d):
    n = F.col("event_id").cast("string")
    made = F.when(F.col("event_id") % 6 == 0, F.lit("1e2")).when(F.col("event_id") % 6 == 1, F.lit("1 2")).when(F.col("event_id") % 6 == 2, F.lit('{"a":1} z')).when(F.col("event_id") % 6 == 3, F.lit("99999999999999999999")).when(F.col("event_id") % 6 == 4, F.concat(F.lit('{"b": '), n, F.lit('.0, "a":2 }'))).otherwise(F.concat(F.lit(" [ "), n, F.lit(" , 1.50]")))
    return jsonrel.canonical_json(table(spark, d, "events").select("event_id", made.alias("j")), "j", "canon").select("event_id", "canon")


@query("SELECT c_custkey, c_name AS text FROM customer")
def order1_roundtrip(spark, d):
    return container.coded_roundtrip(table(spark, d, "customer"), "c_custkey", "c_name", "order1").select("c_custkey", "text")


@query(f"WITH x AS (SELECT event_id, value_cents, {_ZZ.format('value_cents')} AS z FROM (SELECT event_id, CAST(event_id * 7919 - 3000000 AS BIGINT) AS value_cents FROM events)) SELECT event_id, upper(array_to_string(list_transform(range(0, {_VL.format('z')}), lambda i: lpad(hex((z // CAST(pow(128, i) AS BIGINT)) % 128 + CASE WHEN i < {_VL.format('z')} - 1 THEN 128 ELSE 0 END), 2, '0')), '')) AS bytes, value_cents AS back FROM x")
def flat_integers(spark, d):
    v = (F.col("event_id") * 7919 - 3000000).cast("long")
    made = table(spark, d, "events").select("event_id", S.varint_hex(S.zigzag(v)).alias("bytes"))
    return made.withColumn("back", S.unzigzag(S.varint_from_hex(F.col("bytes"))))


def _cells(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("pos"), "o_custkey", "o_orderstatus", "o_totalprice", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    return schema.cells_of(rows, "pos", ["o_custkey", "o_orderstatus", "o_totalprice", "c_name", "at"])


_CELLS = "SELECT 'o_custkey' AS path, o_orderkey AS pos, 'int' AS kind, CAST(NULL AS VARCHAR) AS str_val, CAST(o_custkey AS BIGINT) AS int_val, CAST(NULL AS DOUBLE) AS float_val FROM oc UNION ALL SELECT 'o_orderstatus', o_orderkey, 'str', o_orderstatus, NULL, NULL FROM oc UNION ALL SELECT 'o_totalprice', o_orderkey, 'float', NULL, NULL, CAST(o_totalprice AS DOUBLE) FROM oc UNION ALL SELECT 'c_name', o_orderkey, 'str', c_name, NULL, NULL FROM oc UNION ALL SELECT 'at', o_orderkey, 'str', strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ'), NULL, NULL FROM oc"
_OC = "WITH oc AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) "


@query(_OC + _CELLS)
def schema_token_roundtrip(spark, d):
    cells = _cells(spark, d)
    s = tokens.schema_of(cells)
    return tokens.decode(tokens.encode(cells, s), s)


@query(_OC + ", v AS (SELECT o_orderstatus, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS i FROM oc GROUP BY 1) SELECT 'o_orderstatus' AS path, o_orderkey AS pos, CAST(i AS BIGINT) AS code FROM oc JOIN v USING (o_orderstatus) UNION ALL SELECT 'c_name', o_orderkey, CAST(regexp_extract(c_name, '[0-9]+$') AS BIGINT) FROM oc WHERE (SELECT count(DISTINCT c_name) FROM oc) > 64 UNION ALL SELECT 'at', o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) FROM oc UNION ALL SELECT 'o_custkey', o_orderkey, o_custkey FROM oc")
def schema_token_codes(spark, d):
    cells = _cells(spark, d)
    return tokens.encode(cells, tokens.schema_of(cells)).filter("path <> 'o_totalprice'").select("path", "pos", "code")


@query(_OC + "SELECT path, pos, int_val AS code FROM (" + _CELLS + ") WHERE path = 'o_custkey'")
def token_delta_roundtrip(spark, d):
    cells = _cells(spark, d)
    s = tokens.schema_of(cells)
    return tokens.delta_decode(tokens.delta_encode(tokens.encode(cells, s), s), s).filter("path = 'o_custkey'").select("path", "pos", "code")


@query(_OC + ", v AS (SELECT o_orderstatus, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS i FROM oc GROUP BY 1) SELECT 'o_orderstatus' AS path, CAST(i AS INTEGER) AS place, o_orderstatus AS variant FROM v")
def schema_variant_places(spark, d):
    return tokens.variant_places(tokens.schema_of(_cells(spark, d))).filter("path = 'o_orderstatus'")


@query("SELECT conv_id % 4 AS part, '[' || string_agg(item, ',' ORDER BY conv_id) || ']' AS text FROM (SELECT conv_id, '{\"conv_id\":' || conv_id || ',\"half\":' || CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id // 2 AS VARCHAR) ELSE CAST(conv_id // 2 AS VARCHAR) || '.5' END || ',\"key\":\"' || md5(CAST(conv_id AS VARCHAR)) || '\",\"turns\":[' || string_agg('{\"role\":\"' || role || '\",\"turn\":' || turn || '}', ',' ORDER BY turn, role) || ']}' AS item FROM conversations GROUP BY conv_id) GROUP BY 1")
def container_nested_roundtrip(spark, d):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    made = rows.select("conv_id", F.struct((F.col("conv_id") / 2).alias("half"), "conv_id", F.md5(F.col("conv_id").cast("string").cast("binary")).alias("key"), "turns").alias("r"))
    docs = made.groupBy((F.col("conv_id") % 4).alias("part")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "r"))), lambda x: x["r"])).alias("json"))
    return container.decode_documents(container.encode_documents(docs, "part", "json"), "part").select("part", "text")


@query("WITH t AS (SELECT kind, value, count(*) AS cnt FROM (SELECT event_id, 4 AS kind, unnest(json_keys(props)) AS value FROM events UNION ALL SELECT event_id, 5, event_type FROM events) GROUP BY 1, 2) SELECT CAST(row_number() OVER (ORDER BY cnt DESC, kind, value) - 1 AS BIGINT) AS dict_id, CAST(kind AS INTEGER) AS kind, value FROM t")
def dictionary_wire(spark, d):
    # at most DICT_MOST entries: one row of bytes, and back
    built = categorical.build(_tokens(spark, d)).agg(F.array_sort(F.collect_list(F.struct("dict_id", "kind", "value"))).alias("entries"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for entries in b.column(0).to_pylist():
                back = columns.dictionary_from(columns.dictionary_bytes([(e["kind"], e["value"]) for e in entries]))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(back)), pa.int64()), pa.array([k for k, _ in back], pa.int32()), pa.array([v for _, v in back], pa.string())], names=["dict_id", "kind", "value"])

    return built.mapInArrow(run, "dict_id long, kind int, value string")
