"""A checksummed container for one encoded document: header, section table, payloads; and its reader.

Layout: 24-byte header (magic, version, flags, pipeline, original size, section count, FNV-1a
checksum), then one 24-byte entry and its inline meta per section, then the payloads. JSON arrays
of objects with one list of keys are stored by column in chunks of 8192 rows, each column by the
smallest of its encodings, nested lists as sub-tables; texts that three chunks or more share are kept
once in a section of their own, and a column equal to an earlier one is a reference. Other JSON is packed canonical text;
anything else, or whatever would not shrink, is kept verbatim. decode(encode(x)) is the canonical form of x for JSON and x itself otherwise:
the encoder checks that before it returns.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import entropy, jsonrel, lanes
from .columns import BACKREF, column_tag, decode_column, dictionary_bytes, dictionary_from, encode_column, shared_tables, varint, varint_at

MAGIC, VERSION, HEADER, ENTRY, CHUNK, MOST_SECTIONS = b"TSRA", 1, 24, 24, 8192, 1 << 16
RAW, TEXT, COLUMNS = 0, 1, 2
DATA, SCHEMA, COLUMNAR, TOKENS, GLOBAL = 6, 1, 9, 2, 10
NAMES = {DATA: "data", SCHEMA: "schema", COLUMNAR: "columnar", TOKENS: "tokens", GLOBAL: "global"}
#: Largest document that encode() takes, by default.
MOST_BYTES = 1 << 31


class ContainerError(ValueError):
    """Bytes that aren't a container, or a damaged one."""


#: What reading damaged bytes can raise.
DAMAGE = (ValueError, IndexError, KeyError, StopIteration, RuntimeError, OverflowError, ZeroDivisionError, struct.error)


def fnv1a(data: bytes) -> int:
    # fixed values: offset basis and prime
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


@dataclass
class Section:
    kind: int
    codec: int
    offset: int
    length: int
    checksum: int
    meta: bytes = b""


def pack(pipeline: int, size: int, sections: list[tuple[int, int, bytes, bytes]]) -> bytes:
    """A container of (kind, codec, payload, meta) sections."""
    if len(sections) >= MOST_SECTIONS:
        raise ContainerError("too many sections")
    head = struct.pack("<4sBBBxQH2x", MAGIC, VERSION, 0, pipeline, size, len(sections))
    at = HEADER + sum(ENTRY + len(m) for *_, m in sections)
    table, body = b"", b""
    for kind, codec, payload, meta in sections:
        table += struct.pack("<BBQQIH", kind, codec, at + len(body), len(payload), fnv1a(payload), len(meta)) + meta
        body += payload
    return head + struct.pack("<I", fnv1a(head)) + table + body


def inspect(blob: bytes) -> tuple[int, int, list[Section]]:
    """(pipeline, original size, sections) after checking the header."""
    if len(blob) < HEADER:
        raise ContainerError("unexpected end")
    magic, version, _, pipeline, size, count = struct.unpack_from("<4sBBBxQH2x", blob)
    if magic != MAGIC:
        raise ContainerError("wrong magic")
    if version != VERSION:
        raise ContainerError("unsupported version")
    if struct.unpack_from("<I", blob, 20)[0] != fnv1a(blob[:20]):
        raise ContainerError("wrong header checksum")
    at, out = HEADER, []
    for _ in range(count):
        if at + ENTRY > len(blob):
            raise ContainerError("unexpected end")
        kind, codec, offset, length, check, n = struct.unpack_from("<BBQQIH", blob, at)
        out.append(Section(kind, codec, offset, length, check, bytes(blob[at + ENTRY : at + ENTRY + n])))
        at += ENTRY + n
    return pipeline, size, out


def payload(blob: bytes, s: Section) -> bytes:
    body = blob[s.offset : s.offset + s.length]
    if len(body) < s.length:
        raise ContainerError("unexpected end")
    if fnv1a(body) != s.checksum:
        raise ContainerError("wrong section checksum")
    return body


@dataclass(frozen=True)
class EncodeOptions:
    """structured: whether JSON is taken apart; shared: whether chunks share tables; most_bytes: larger documents are refused."""

    structured: bool = True
    shared: bool = True
    most_bytes: int = MOST_BYTES


def _flat_rows(doc) -> list[str] | None:
    """The one list of keys of an array of two or more objects."""
    if not isinstance(doc, list) or len(doc) < 2 or not all(isinstance(r, dict) for r in doc):
        return None
    keys = list(doc[0])
    return None if not keys or any(list(r) != keys for r in doc) else keys


def columnar_body(rows: list[dict], keys: list[str], tables: list[tuple[int, dict] | None]) -> bytes:
    """A chunk's columns, each behind its length; one that equals an earlier one is a reference to it."""
    out, seen = b"", []
    for k, table in zip(keys, tables, strict=True):
        values = [r[k] for r in rows]
        mark = jsonrel.dump(values)  # tells 1 from 1.0 and from true
        body = bytes([BACKREF]) + varint(seen.index(mark)) if mark in seen else encode_column(values, table)
        seen.append(mark)
        out += varint(len(body)) + body
    return out


def columnar_parts(body: bytes, n: int) -> list[bytes]:
    """The encoded columns of a chunk."""
    at, out = 0, []
    for _ in range(n):
        size, at = varint_at(body, at)
        if at + size > len(body):
            raise ContainerError("unexpected end")
        out.append(body[at : at + size])
        at += size
    return out


def columnar_rows(body: bytes, keys: list[str], tables: list[list]) -> list[dict]:
    cols: list[list] = []
    for part in columnar_parts(body, len(keys)):
        if part[:1] == bytes([BACKREF]):
            k, _ = varint_at(part, 1)
            if k >= len(cols):
                raise ContainerError("a reference to a later column")
            cols.append(cols[k])
        else:
            cols.append(decode_column(part, tables))
    return [dict(zip(keys, r, strict=True)) for r in zip(*cols, strict=True)]


def encode_columnar(rows: list[dict]) -> bytes:
    """One-shot form: keys and columns of rows of one list of keys, without a container."""
    keys = list(rows[0])
    head = jsonrel.dump(keys).encode()
    return varint(len(head)) + head + columnar_body(rows, keys, [None] * len(keys))


def decode_columnar(blob: bytes) -> list[dict]:
    n, at = varint_at(blob, 0)
    return columnar_rows(blob[at + n :], jsonrel.parse(blob[at : at + n].decode()), [])


def encode(data: bytes, structured: bool = True, options: EncodeOptions | None = None) -> bytes:
    """A container of data."""
    options = options or EncodeOptions(structured)
    structured = options.structured
    if len(data) > options.most_bytes:
        raise ContainerError("the document is too large")
    plain = pack(RAW, len(data), [(DATA, 0, data, b"")])
    if not structured or not jsonrel.is_json_text(data):
        return plain
    try:
        text = jsonrel.canonical(data.decode())
    except (jsonrel.BadJson, UnicodeDecodeError):
        return plain
    doc = jsonrel.parse(text)
    if keys := _flat_rows(doc):
        sections = [(SCHEMA, 0, jsonrel.dump(keys).encode(), b"")]
        chunks = [doc[a : a + CHUNK] for a in range(0, len(doc), CHUNK)]
        shared = shared_tables([[[r[k] for r in c] for c in chunks] for k in keys]) if options.shared else [None] * len(keys)
        kept = [t for t in shared if t]
        numbers = iter(range(len(kept)))
        tables = [(next(numbers), {v: i for i, v in enumerate(t)}) if t else None for t in shared]
        if kept:
            sections.append((GLOBAL, 0, varint(len(kept)) + b"".join(varint(len(x)) + x for x in (dictionary_bytes([(0, v) for v in t]) for t in kept)), b""))
        for a, rows in zip(range(0, len(doc), CHUNK), chunks, strict=True):
            body = columnar_body(rows, keys, tables)
            sections.append((COLUMNAR, 0, body, struct.pack("<II", a, a + len(rows))))
        made = pack(COLUMNS, len(data), sections)
    else:
        made = pack(TEXT, len(data), [(TOKENS, 2, _text_body(text.encode()), b"")])
    return made if len(made) < len(data) and decode(made) == text.encode() else plain


def decode(blob: bytes) -> bytes:
    pipeline, size, sections = inspect(blob)
    if pipeline == RAW:
        out = payload(blob, next(s for s in sections if s.kind == DATA))
        if len(out) != size:
            raise ContainerError("wrong size")
        return out
    if pipeline == TEXT:
        return _text_back(payload(blob, sections[0]))
    keys, tables = _shared(blob, sections)
    rows: list = []
    for s in sorted((s for s in sections if s.kind == COLUMNAR), key=lambda s: s.meta[:4][::-1]):
        rows += columnar_rows(payload(blob, s), keys, tables)
    return jsonrel.dump(rows).encode()


def _text_body(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(data)


def _text_back(body: bytes) -> bytes:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompress(body)
    except zstandard.ZstdError as e:
        raise ContainerError(str(e)) from e


def _shared(blob: bytes, sections: list[Section]) -> tuple[list[str], list[list]]:
    """Keys and shared tables of a columnar container."""
    schema = next((s for s in sections if s.kind == SCHEMA), None)
    if schema is None:
        raise ContainerError("the schema is missing")
    tables = []
    for s in sections:
        if s.kind == GLOBAL:
            body = payload(blob, s)
            n, at = varint_at(body, 0)
            tables = [[v for _, v in dictionary_from(t)] for t in columnar_parts(body[at:], n)]
    return jsonrel.parse(payload(blob, schema).decode()), tables


def column_tags(blob: bytes) -> list[tuple[int, str, str]]:
    """(first row, key, tag) of every stored column."""
    pipeline, _, sections = inspect(blob)
    if pipeline != COLUMNS:
        return []
    keys, _ = _shared(blob, sections)
    return [(struct.unpack("<II", s.meta)[0], k, column_tag(p)) for s in sections if s.kind == COLUMNAR for k, p in zip(keys, columnar_parts(payload(blob, s), len(keys)), strict=True)]


def encode_documents(df: DataFrame, id_col: str, col: str, structured: bool = True) -> DataFrame:
    """(id, container, raw_bytes, encoded_bytes); a null text has no container."""

    def run(batches):
        for b in batches:
            raw = [x.encode() if isinstance(x, str) else x for x in b.column(1).to_pylist()]
            made = [None if x is None else encode(bytes(x), structured) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), pa.array([None if x is None else len(x) for x in raw], pa.int64()), pa.array([None if x is None else len(x) for x in made], pa.int64())], names=[id_col, "container", "raw_bytes", "encoded_bytes"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, col).mapInArrow(run, f"`{id_col}` {kind}, container binary, raw_bytes long, encoded_bytes long")


def decode_documents(df: DataFrame, id_col: str, col: str = "container") -> DataFrame:
    """(id, text, error): the decoded text, or why there is none."""

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for x in b.column(1).to_pylist():
                try:
                    texts.append(None if x is None else decode(bytes(x)).decode())
                    errors.append(None)
                except DAMAGE as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[id_col, "text", "error"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, col).mapInArrow(run, f"`{id_col}` {kind}, text string, error string")


def sections_of(df: DataFrame, id_col: str, col: str = "container") -> DataFrame:
    """(id, idx, type, codec, offset, length, checksum, row_start, row_end, ok) of every section, payloads unread but for checksums."""

    def run(batches):
        for b in batches:
            rows = []
            for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blob = bytes(x or b"")
                try:
                    found = inspect(blob)[2]
                except DAMAGE:
                    continue
                for i, s in enumerate(found):
                    span = struct.unpack("<II", s.meta) if len(s.meta) == 8 else (None, None)
                    rows.append((key, i, NAMES.get(s.kind, f"unknown {s.kind}"), "zstd" if s.codec == 2 else "none", s.offset, s.length, s.checksum, *span, fnv1a(blob[s.offset : s.offset + s.length]) == s.checksum))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[id_col, "idx", "type", "codec", "offset", "length", "checksum", "row_start", "row_end", "ok"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, col).mapInArrow(run, f"`{id_col}` {kind}, idx int, type string, codec string, offset long, length long, checksum long, row_start long, row_end long, ok boolean")


def coded_roundtrip(df: DataFrame, id_col: str, col: str, codec: str) -> DataFrame:
    """(id, text, coded_bytes): each text coded and decoded by "rans", "order1", "ctw" or the smallest of them ("auto"), from the coded bytes alone; null stays null.

    Coding costs far more than moving a text, so rows are dealt evenly to all cores first, however few the files' row groups are.
    """

    def codes(texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        if codec == "rans":
            made = [entropy.coded(t) for t in texts]
            return made, [entropy.uncoded(x) for x in made]
        if codec == "order1":
            made = [entropy.order1_encode(t) for t in texts]
            return made, [entropy.order1_decode(x) for x in made]
        if codec == "auto":
            made = lanes.auto_encode(texts)
            return made, lanes.auto_decode(made)
        made = lanes.ctw_encode(texts)
        return made, lanes.ctw_decode(made, [len(t) for t in texts])

    def run(batches):
        for b in batches:
            given = b.column(1).to_pylist()
            at = [i for i, x in enumerate(given) if x]
            made, back = codes([given[i].encode() for i in at])
            sizes = [0] * len(given)
            for i, blob, text in zip(at, made, back, strict=True):
                given[i], sizes[i] = text.decode(), len(blob)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(given, pa.string()), pa.array(sizes, pa.int64())], names=[id_col, "text", "coded_bytes"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    dealt = df.select(id_col, F.col(col).cast("string")).repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, text string, coded_bytes long")


class _Rows(InputPartition):
    def __init__(self, path: str, at: int) -> None:
        self.path, self.at = path, at


class _Reader(DataSourceReader):
    """One partition a section: chunks decode in parallel."""

    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self):
        with open(self.path, "rb") as f:
            _, _, sections = inspect(f.read())
        return [_Rows(self.path, i) for i, s in enumerate(sections) if s.kind == COLUMNAR]

    def read(self, p):
        with open(p.path, "rb") as f:
            blob = f.read()
        _, _, sections = inspect(blob)
        keys, tables = _shared(blob, sections)
        s = sections[p.at]
        start = struct.unpack("<II", s.meta)[0]
        for i, r in enumerate(columnar_rows(payload(blob, s), keys, tables)):
            yield (start + i, jsonrel.dump(r))


class ContainerSource(DataSource):
    """spark.read.format("tessera_container").load(path): (row_idx, json) of a columnar container on a shared path."""

    @classmethod
    def name(cls) -> str:
        return "tessera_container"

    def schema(self) -> str:
        return "row_idx long, json string"

    def reader(self, schema):
        return _Reader(self.options)
