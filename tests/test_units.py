import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import entropy, jsonrel, ordered
from tessera.operators.ordering import with_row_idx
from tessera.plans import catalog
from tessera.sources import columns, container
from tessera.streaming.stateful import stream_cross_record, stream_dictionary

LIMIT = 1 << 63


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_scalars(spark):
    assert one(spark, S.fnv1a_32(F.lit(""))) == 2166136261 and one(spark, S.fnv1a_32(F.lit("hello"))) == 0x4F9F2CAB
    assert [one(spark, S.zigzag(F.lit(v))) for v in (0, -1, 1, -2, 2)] == [0, 1, 2, 3, 4]
    assert [one(spark, S.varint_length(F.lit(v).cast("long"))) for v in (0, 127, 128, 16383, 16384, LIMIT - 1, -1)] == [1, 1, 2, 2, 3, 9, 10]
    u = "0f1e2d3c-4b5a-4978-8695-a4b3c2d1e0ff"
    assert one(spark, S.unpack_uuid(S.pack_uuid(F.lit(u)))) == u and not one(spark, S.is_uuid(F.lit(u.upper())))
    assert one(spark, S.parse_timestamp(F.lit("2031-05-04T03:30:00+05:30"))) == one(spark, S.parse_timestamp(F.lit("2031-05-03T22:00:00Z")))
    assert one(spark, S.parse_timestamp(F.lit("2000-01-01T00:00:00Z"))) == 946684800 and one(spark, S.parse_timestamp(F.lit("none"))) is None
    assert one(spark, S.common_prefix(F.lit("item-7a"), F.lit("item-7b"))) == "item-7" and one(spark, S.common_prefix(F.lit("abc"), F.lit("xyz"))) == ""


@pytest.mark.parametrize(("values", "want"), [([7, 20, 21, 45, 60, 61], "Monotonic"), ([30, 33, 31, 36, 36, 29], "Clustered"), ([17, 9000, 3, 41, 7777], "Random"), ([9], "Random"), ([4, 4, 4, 4], "Sequential"), ([0, 30, 60, 90, 80, 50, 20, 10], "Bounded")])
def test_patterns(spark, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v long")
    assert ordered.profile(with_row_idx(df, ["k"]).select("chunk_id", "row_idx", "v"), ["v"]).first()["pattern"] == want


def test_delta_wraps_and_chunks(spark):
    values = [-LIMIT, LIMIT - 1, 0, -LIMIT, LIMIT - 1, -LIMIT, 7] * 3
    df = with_row_idx(spark.createDataFrame(list(enumerate(values)), "k long, v long"), ["k"], chunk=4)
    back = ordered.delta_decode(ordered.delta_encode(df, "v")).orderBy("row_idx").collect()
    assert [r.v for r in back] == values and [r.row_idx for r in back] == list(range(21))
    assert with_row_idx(df.select("k", "v").limit(0), ["k"]).collect() == []


def test_periods_and_runs(spark):
    df = with_row_idx(spark.createDataFrame([(i, i % 100, None if i % 3 else "a") for i in range(300)], "k long, p long, s string"), ["k"])
    assert ordered.detect_period(df, "p").first()["period"] == 100 and ordered.detect_period(df, "k").first()["period"] is None
    runs = ordered.run_length(df, "s")
    assert [r.v for r in ordered.run_expand(runs).orderBy("row_idx").collect()] == [None if i % 3 else "a" for i in range(300)]
    back = ordered.cross_record_decode(ordered.cross_record(df, ["s"])).orderBy("row_idx").collect()
    assert [r.v for r in back] == [None if i % 3 else "a" for i in range(300)]


def test_canonical():
    assert jsonrel.canonical(' {"z":1.0,"a":[1e2,-0.50,"\\u00e9\\n"],"m":null} ') == '{"a":[100,-0.5,"é\\n"],"m":null,"z":1}'
    for bad in ("[1,]", "01", "1 2", "NaN", '{"a":1,"a":2}', str(1 << 63), '"\x01"', "1e999", ""):
        with pytest.raises(jsonrel.BadJson):
            jsonrel.canonical(bad)


scalars = st.none() | st.booleans() | st.integers(-LIMIT, LIMIT - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12)
trees = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=80, deadline=None)
@given(trees)
def test_json_round_trips(v):
    text = json.dumps(v)
    want = jsonrel.canonical(text)
    assert jsonrel.canonical(want) == want
    assert jsonrel.dump(jsonrel.tokens_to_value([(k, x) for k, _, _, x in jsonrel.tokens(jsonrel.parse(text))])) == want
    got = container.decode(container.encode(text.encode()))
    assert got in (text.encode(), want.encode())


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from([None, True, False, 0, -1, 7, -0.5, 0.25, 1e-7, -0.0, "u10", "u9", "u09", "2026-01-01", "2026-01-01T00:00:00Z", "a.b", "\x01", "YQ==", "YWI=", "0f1e2d3c-4b5a-4978-8695-a4b3c2d1e0ff"]) | st.integers(-LIMIT, LIMIT - 1), max_size=12) | st.lists(st.sampled_from(["u10", "u9"])) | st.lists(st.floats(-1, 1)) | st.lists(st.booleans(), min_size=1))
def test_columns_round_trip(values):
    back = columns.decode_column(columns.encode_column(values))
    assert [(type(x), str(x)) for x in back] == [(type(x), str(x)) for x in values]


def test_column_sizes():
    assert len(columns.encode_column(list(range(1000)))) <= 10
    assert len(columns.encode_column([i % 4 for i in range(1000)])) < 30


def test_container_errors():
    blob = container.encode(b"<xml/>")
    assert len(blob) == 6 + 48 and container.decode(blob) == b"<xml/>"
    for bad in (b"", b"x" * 60, blob[:30], blob[:20] + b"\0" + blob[21:], blob[:-1], blob[:-1] + b"?"):
        with pytest.raises(container.ContainerError):
            container.decode(bad)
    for raw in (b"", b"[not json", bytes(range(256)), b'[{"a":1},{"a":2}', b"\xff[1]"):
        assert container.decode(container.encode(raw)) == raw
    rows = [{"id": i, "user": f"user_{i:05}", "ok": i % 2 == 0, "x": None if i % 5 else i / 4} for i in range(20000)]
    raw = json.dumps(rows).encode()
    made = container.encode(raw)
    assert len(made) < len(raw) / 20 and container.decode(made) == jsonrel.canonical(raw.decode()).encode()
    assert len([s for s in container.inspect(made)[2] if s.kind == container.COLUMNAR]) == 3


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_coders(data):
    raw = {s: data.count(s) for s in set(data)}
    freq = entropy.scaled(raw)
    assert sum(freq.values()) == 4096 and min(freq.values()) > 0
    assert entropy.rans_decode(entropy.rans_encode(data, freq), len(data), freq) == data
    assert entropy.ctw_decode(entropy.ctw_encode(data), len(data)) == data


def test_data_source(spark, tmp_path):
    rows = [{"a": i, "b": f"x{i % 3}"} for i in range(9000)]
    path = tmp_path / "t.bin"
    path.write_bytes(container.encode(json.dumps(rows).encode()))
    spark.dataSource.register(container.ContainerSource)
    got = spark.read.format("tessera_container").load(str(path)).orderBy("row_idx").collect()
    assert [json.loads(r.json) for r in got] == rows and got[8999].row_idx == 8999


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, "k" + str(i % 2), v) for i, v in enumerate("aabbabbb")], "i long, key string, v string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    for name, build, mode in (("cross", lambda s: stream_cross_record(s, "i", "v", "key"), "append"), ("dict", lambda s: stream_dictionary(s, "key", "v"), "complete")):
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = build(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.ord: r.same_flag for r in spark.table("cross").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 1}
    assert {(r.kind, r.value): r.cnt for r in spark.table("dict").collect()} == {("k0", "a"): 2, ("k0", "b"): 2, ("k1", "a"): 1, ("k1", "b"): 3}


def test_enum_runs_keep_late_variants(spark, monkeypatch):
    runs = spark.createDataFrame([(0, k, f"v{k}", 1) for k in range(300)], "chunk_id long, start_row long, v string, run long")
    seen = spark.createDataFrame([(f"v{k}", k, k) for k in range(300)], "variant string, first_row long, idx long")
    monkeypatch.setattr(catalog, "rle_encode_events", lambda spark, d: runs)
    monkeypatch.setattr(catalog, "enum_index_first_seen", lambda spark, d: seen)
    assert sorted((r.start_row, r.idx) for r in catalog.enum_runs(spark, "").collect()) == [(k, k) for k in range(300)]
