"""Column encodings, codecs and containers: exact round trips, choices and damaged bytes."""

import base64
import json
import random
import time
import uuid

import pytest

from tessera.operators import entropy, jsonrel, lanes
from tessera.sources import columns, container


def _cases():
    r = random.Random(5)
    return {
        "STRPREFIX_HEX": [f"run-{r.getrandbits(48):012x}" for _ in range(400)],
        "BASE64": [base64.b64encode(r.randbytes(12)).decode() for _ in range(400)],
        "UUID": [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(400)],
        "TIMESTAMP": [columns.iso(1600000000 + r.randrange(10**8), True) for _ in range(400)],
        "INT": list(range(7, 900, 3)),
        "INT_RANS": [min(7, int(r.expovariate(1))) for _ in range(5000)],
        "FLOAT_FIXED": [r.randrange(10**6) / 100 for _ in range(500)],
        "ENUM_RANS": [r.choice("abcdefg") for _ in range(2000)],
        "ENUM_RLE": ["a"] * 90 + ["b"] * 50 + ["a"] * 70 + ["c"],
        "INT_PERIOD": [5, 1, 9, 9, 2] * 80,
        "BOOL": [r.random() < 0.5 for _ in range(99)],
        "NULL": [None] * 9,
        "STRPREFIX": [f"item{r.randrange(10**6):07d}" for _ in range(300)],
        "RAW_STR": ["".join(r.choice("abc def ghi") for _ in range(r.randrange(30))) + str(i) for i in range(300)],
        "SUB_TABLE": [[{"n": r.randrange(9), "tags": [str(x) for x in range(r.randrange(3))]} for _ in range(r.randrange(4))] for _ in range(200)],
        "OBJECT": [{"a": i, "b": {"c": i % 3}} for i in range(100)],
    }


@pytest.mark.parametrize("tag", _cases())
def test_column_choices(tag):
    values = _cases()[tag]
    made = columns.encode_column(values)
    assert columns.column_tag(made) == tag
    assert columns.decode_column(made) == values


def test_odd_columns():
    for values in ([], [None, 1], [1, 1.0, True, "1"], [0.0, -0.0], [[], [1, "a"], [[2]]], ["", "x"], ["00", "0"], [{"a": 1}, {"b": 2}], ["2021-02-30", "2021-02-28"], ["QQ==", "QR=="]):
        back = columns.decode_column(columns.encode_column(values))
        assert json.dumps(back) == json.dumps(values)


def test_codecs():
    r = random.Random(2)
    for data in (b"", b"q", b"to be or not to be " * 20, bytes(range(256)) * 3, r.randbytes(700)):
        assert entropy.uncoded(entropy.coded(data)) == data
        assert entropy.order1_decode(entropy.order1_encode(data)) == data
        made = entropy.auto_encode(data)
        assert entropy.auto_decode(made) == data and len(made) <= len(data) + 1
    assert entropy.attempt(b"short") is None and entropy.attempt(r.randbytes(500)) is None
    skew = bytes(min(5, int(r.expovariate(1))) for _ in range(900))
    assert len(entropy.attempt(skew)) < len(skew)
    with pytest.raises(ValueError):
        entropy.slot_table({1: 5, 2: 7})
    freq, bits, end = entropy.table_at(entropy.table_bytes({3: 4000, 9: 96}))
    assert freq == {3: 4000, 9: 96} and bits == 12 and end == len(entropy.table_bytes(freq))


def _texts(n):
    r = random.Random(8)
    kinds = [lambda k: r.randbytes(k), lambda k: bytes(min(255, int(r.expovariate(1))) for _ in range(k)), lambda k: bytes([r.randrange(256)]) * k, lambda k: bytes(r.choice(b"ab") for _ in range(k)), lambda k: b"\xff" * k + r.randbytes(3), lambda k: b"Customer#%09d" % r.randrange(10**8)]
    return [r.choice(kinds)(r.choice((0, 1, 2, 5, 18, 40, 90))) for _ in range(n)] + [b"to be or not to be " * 60, bytes((i * i * 7 + i) % 16 * 16 + i % 2 for i in range(4000)), b"\0" * 900 + b"\xff" * 9]


def test_lanes_make_the_bytes_of_one_text(monkeypatch):
    texts = _texts(150)
    for worth in (0, lanes.WORTH, 10**9):
        monkeypatch.setattr(lanes, "WORTH", worth)
        made = lanes.ctw_encode(texts)
        assert made == [entropy.ctw_encode(t) for t in texts]
        assert lanes.ctw_decode(made, [len(t) for t in texts]) == texts
    made = lanes.auto_encode(texts)
    assert lanes.auto_decode(made) == texts and len({x[0] for x in made}) == 4
    for t, x in zip(texts, made, strict=True):  # what smallest() leaves out would not have won
        forms = [b"\0" + t, b"\1" + entropy.coded(t), b"\2" + entropy.order1_encode(t)]
        assert x == min([*forms, b"\3" + entropy._varint(len(t)) + entropy.ctw_encode(t)] if t else forms, key=len)


def test_names_are_coded_in_time():
    names = [b"Customer#%09d" % (77 * i) for i in range(3000)]
    began = time.process_time()
    assert lanes.auto_decode(lanes.auto_encode(names)) == names
    assert time.process_time() - began < 4.5  # 10.7 s before
    began = time.process_time()
    assert [entropy.order1_decode(entropy.order1_encode(x)) for x in names] == names
    assert time.process_time() - began < 4.5  # 12.6 s before


@pytest.mark.parametrize("codec", ["rans", "order1", "ctw", "auto"])
def test_coded_roundtrip_keeps_nulls_and_uses_all_cores(spark, codec):
    rows = [(1, None), (2, ""), (3, "é" * 9), (4, "Customer#000000001"), (4, "Customer#000000001"), (None, "x")]
    got = container.coded_roundtrip(spark.createDataFrame(rows, "id long, t string").coalesce(1), "id", "t", codec)
    assert sorted((str(r.id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in rows)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_payloads_and_dictionary():
    texts = ["alpha", "beta"]
    ids = {t: i for i, t in enumerate(texts)}
    for kind, value in (("str", "beta"), ("str", "not known"), ("int", -77), ("float", 2.5), ("bool", True), ("null", None)):
        b = columns.payload_bytes(kind, value, ids)
        assert columns.payload_at(kind, b, 0, texts) == (value, len(b))
    entries = [(4, "key"), (5, "wörter"), (5, "")]
    assert columns.dictionary_from(columns.dictionary_bytes(entries)) == entries
    with pytest.raises(ValueError):
        columns.dictionary_from(columns.dictionary_bytes(entries) + b"x")
    for v in (0.0, -0.0, 12.0, 1.5, 0.1, 1e300, -3e9):
        assert repr(columns.float_from(columns.float_bytes(v))) == repr(v)


def test_container():
    r = random.Random(3)
    rows = [{"again": i, "city": f"c{r.randrange(20)}", "friends": [{"n": r.randrange(50)} for _ in range(r.randrange(3))], "id": i} for i in range(17000)]
    text = jsonrel.dump(rows).encode()
    blob = container.encode(text)
    assert container.decode(blob) == text and len(blob) < len(text) / 8
    assert {t[1:] for t in container.column_tags(blob)} == {("again", "INT"), ("city", "ENUM_REF"), ("friends", "SUB_TABLE"), ("id", "BACKREF")}
    assert [container.NAMES[s.kind] for s in container.inspect(blob)[2]] == ["schema", "global", "columnar", "columnar", "columnar"]
    alone = container.encode(text, options=container.EncodeOptions(shared=False))
    assert container.decode(alone) == text and len(alone) > len(blob)
    assert container.decode_columnar(container.encode_columnar(rows[:99])) == rows[:99]
    for data in (b"", b"plain words", b'{"a": [1, 2]}' * 1, b"[not json", b'[{"a":1e2},{"a":2}]', bytes(range(256))):
        got = container.decode(container.encode(data))
        try:
            want = jsonrel.canonical(data.decode()).encode()
        except (jsonrel.BadJson, UnicodeDecodeError):
            want = data
        assert got in (want, data)
    with pytest.raises(container.ContainerError):
        container.encode(b"too long", options=container.EncodeOptions(most_bytes=3))
    small = container.encode(jsonrel.dump(rows[:300]).encode())
    for i in range(0, len(small), 7):
        bad = bytearray(small)
        bad[i] ^= 0x41
        try:
            container.decode(bytes(bad))
        except container.DAMAGE:
            pass


def test_damaged_documents(spark):
    good = container.encode(b'[{"a":1},{"a":2}]')
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-3])), (3, bytearray(b"x")), (4, None)], "id long, container binary")
    got = {r.id: r for r in container.decode_documents(df, "id").collect()}
    assert got[1].text == '[{"a":1},{"a":2}]' and got[2].error and got[3].error and got[4].text is None and got[4].error is None
    assert {r.id for r in container.sections_of(df, "id").collect()} >= {1}
    none = container.encode_documents(spark.createDataFrame([(1, None)], "id long, t string"), "id", "t").first()
    assert none.container is None


def test_flatten_at_any_depth(spark):
    deep = '{"a":' * 400 + "1" + "}" * 400
    df = spark.createDataFrame([(1, deep), (2, '{"a.b":1,"c":[{"d":"x"},{"d":null}]}'), (3, "not json"), (4, None)], "id long, j string")
    got = {(r.id, r.path, r.v) for r in jsonrel.flatten(df, "id", "j").collect() if r.id > 1}
    assert got == {(2, "a\\.b", "1"), (2, "c.d", "x"), (2, "c.d", None)}
    assert jsonrel.flatten(df, "id", "j").filter("id = 1").first().path == ".".join("a" * 400)
