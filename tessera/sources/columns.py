"""Column encodings of the container; the smallest wins. All keep types, nulls and signs.

Values are scalars, lists or objects: lists of a column become a sub-table (their lengths, and the column of
all elements), objects of one list of keys become a column a key. Bodies are plain, zstd or rANS, whichever is smallest.
"""

from __future__ import annotations

import json
import base64
import re
import struct
from datetime import UTC, datetime

import numpy as np

from ..operators import entropy

try:
    import zstandard
except ModuleNotFoundError:  # bodies are then plain or rANS
    zstandard = None

NULLS, SEQUENCE, PERIOD, DELTA, ENUM, RUNS, BOOL, FIXED, PREFIX, UUID, TEXT, TIMESTAMP, HEX, BASE64, SUB_TABLE, OBJECT, BACKREF, ENUM_REF = range(18)
_NAMES = {NULLS: "NULL", BOOL: "BOOL", DELTA: "INT", FIXED: "FLOAT_FIXED", ENUM: "ENUM", RUNS: "ENUM_RLE", PREFIX: "STRPREFIX", HEX: "STRPREFIX_HEX", UUID: "UUID", BASE64: "BASE64", TEXT: "RAW_STR", TIMESTAMP: "TIMESTAMP", SUB_TABLE: "SUB_TABLE", OBJECT: "OBJECT", BACKREF: "BACKREF", ENUM_REF: "ENUM_REF"}
MAX_PERIOD, MAX_VARIANTS = 512, 256


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def varint_at(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(b):
            raise ValueError("unexpected end")
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def zag(u: int) -> int:
    return u >> 1 if not u & 1 else -((u + 1) >> 1)


_PLAIN, _ZSTD, _RANS = range(3)


def _squeeze(b: bytes) -> bytes:
    made = [bytes([_PLAIN]) + b]
    if zstandard:
        made.append(bytes([_ZSTD]) + zstandard.ZstdCompressor(9).compress(b))
    # rANS is tried where its estimate beats what there is
    if 64 <= len(b) <= 1 << 16 and entropy.estimate(b) + 2 * len(set(b)) < min(map(len, made)) and (coded := entropy.attempt(b)):
        made.append(bytes([_RANS]) + coded)
    return min(made, key=len)


def _expand(b: bytes) -> bytes:
    if b[0] == _RANS:
        return entropy.uncoded(b[1:])
    if b[0] == _ZSTD:
        if not zstandard:
            raise ValueError("this body needs zstandard")
        return zstandard.ZstdDecompressor().decompress(b[1:])
    return b[1:]


def _ints(values: list[int]) -> bytes:
    """Integers as differences, or as one step."""
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    if len(steps) > 0 and len(set(steps)) == 1:
        return b"\0" + varint(zig(values[0])) + varint(zig(steps[0])) + varint(len(values))
    return b"\1" + varint(len(values)) + _squeeze(b"".join(map(varint, map(zig, values[:1] + steps))))


def _ints_back(b: bytes) -> list[int]:
    if b[0] == 0:
        first, at = varint_at(b, 1)
        step, at = varint_at(b, at)
        n, _ = varint_at(b, at)
        return [zag(first) + zag(step) * i for i in range(n)]
    n, at = varint_at(b, 1)
    body = _expand(b[at:])
    if body and len(body) == n and max(body) < 128:  # one byte a number
        z = np.frombuffer(body, np.uint8).astype(np.int64)
        return np.cumsum(z >> 1 ^ -(z & 1)).tolist()
    at, out, last = 0, [], 0
    for _ in range(n):
        d, at = varint_at(body, at)
        last += zag(d)
        out.append(last)
    return out


def period_of(values: list) -> int | None:
    n = len(values)
    for p in range(1, min(MAX_PERIOD, n // 2) + 1) if n >= 4 else ():
        if values[p] == values[0] and values[p:] == values[:-p]:
            return p
    return None


def _text(v) -> bytes:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":")).encode()


def encode_column(values: list, table: tuple[int, dict] | None = None) -> bytes:
    """One column's values (None, bool, int, float, str, lists and objects of them); table: the number and places of variants that chunks share."""
    kinds = {type(v) for v in values}
    if kinds <= {type(None)}:
        return bytes([NULLS]) + varint(len(values))
    made = [bytes([TEXT]) + _squeeze(_text(values))]
    if len(kinds) == 1:
        p = period_of(values)
        if p and p < len(values):
            made.append(bytes([PERIOD]) + varint(len(values)) + encode_column(values[:p]))
        kind = kinds.pop()
        if kind is bool:
            made.append(bytes([BOOL]) + varint(len(values)) + int("1" + "".join(str(int(v)) for v in values), 2).to_bytes(len(values) // 8 + 1, "big"))
        elif kind is int:
            made.append(bytes([DELTA]) + _ints(values))
        elif kind is float:
            for d in range(10):
                scaled = [round(v * 10**d) for v in values]
                if all(float(s / 10**d) == v and not (s == 0 and str(v)[0] == "-") for s, v in zip(scaled, values, strict=True)):
                    made.append(bytes([FIXED, d]) + _ints(scaled))
                    break
        elif kind is str:
            made += _strings(values)
            if table and all(v in table[1] for v in values):
                made.append(bytes([ENUM_REF]) + varint(table[0]) + _squeeze(bytes(table[1][v] for v in values)))
        elif kind is list:
            made.append(bytes([SUB_TABLE]) + _part(_ints([len(v) for v in values])) + encode_column([x for v in values for x in v]))
        elif kind is dict and values[0] and all(list(v) == list(values[0]) for v in values):
            keys = list(values[0])
            made.append(bytes([OBJECT]) + _part(_text(keys)) + b"".join(_part(encode_column([v[k] for v in values])) for k in keys))
    return min(made, key=len)


def _part(b: bytes) -> bytes:
    return varint(len(b)) + b


def _part_at(b: bytes, at: int) -> tuple[bytes, int]:
    n, at = varint_at(b, at)
    if at + n > len(b):
        raise ValueError("unexpected end")
    return b[at : at + n], at + n


_ISO = re.compile(r"\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\dZ)?")


def epoch(text: str) -> int | None:
    """Seconds of a date or a UTC date-time; None for anything else."""
    if not _ISO.fullmatch(text):
        return None
    try:
        return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())
    except ValueError:
        return None


def iso(seconds: int, whole: bool) -> str:
    t = datetime.fromtimestamp(seconds, UTC)
    return t.strftime("%Y-%m-%dT%H:%M:%SZ") if whole else t.strftime("%Y-%m-%d")


def hex_suffix(values: list[str]) -> tuple[str, bytes] | None:
    """(prefix, packed digits) of two or more texts of one length that end in an even number of lower-case hexadecimal digits."""
    if len(values) < 2 or len({len(v) for v in values}) > 1:
        return None
    low, high = min(values), max(values)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=True)) if a != b), len(low))
    for n in (n, n - 1):  # an even number of digits may need one more
        rest = [v[n:] for v in values]
        if n >= 0 and rest[0] and len(rest[0]) % 2 == 0 and all(set(r) <= set("0123456789abcdef") for r in rest):
            return low[:n], bytes.fromhex("".join(rest))
    return None


def base64_bytes(values: list[str]) -> bytes | None:
    """The bytes of texts of one length that are canonical base64."""
    if not values or not values[0] or len(values[0]) % 4 or len({len(v) for v in values}) > 1:
        return None
    try:
        raw = [base64.b64decode(v, validate=True) for v in values]
    except ValueError:
        return None
    same = len({len(r) for r in raw}) == 1 and all(base64.b64encode(r).decode() == v for r, v in zip(raw, values, strict=True))
    return b"".join(raw) if same else None


def column_tag(b: bytes) -> str:
    """The name of an encoded column's choice."""
    if b[0] == PERIOD:
        inner = column_tag(b[varint_at(b, 1)[1] :]).removesuffix("_RANS")
        return {"FLOAT_FIXED": "FLOAT", "ENUM_RLE": "ENUM", "ENUM_REF": "ENUM"}.get(inner, inner) + "_PERIOD"
    name = _NAMES[b[0]]
    body = None
    if b[0] == DELTA and b[1] == 1:
        body = varint_at(b, 2)[1]
    elif b[0] == FIXED and b[2] == 1:
        body = varint_at(b, 3)[1]
    elif b[0] == TIMESTAMP and b[2] == 1:
        body = varint_at(b, 3)[1]
    elif b[0] == ENUM:
        n, at = varint_at(b, 1)
        body = at + n
    elif b[0] == TEXT:
        body = 1
    return name + "_RANS" * (body is not None and b[body] == _RANS)


def _strings(values: list[str]) -> list[bytes]:
    made = []
    seen = {v: i for i, v in reversed(list(enumerate(values)))}
    if len(seen) <= MAX_VARIANTS:
        variants = sorted(seen, key=seen.get)
        index = {v: i for i, v in enumerate(variants)}
        places = [index[v] for v in values]
        table = _squeeze(_text(variants))
        head = varint(len(table)) + table
        made.append(bytes([ENUM]) + head + _squeeze(bytes(places)))
        runs: list[list[int]] = []
        for p in places:
            if runs and runs[-1][0] == p:
                runs[-1][1] += 1
            else:
                runs.append([p, 1])
        made.append(bytes([RUNS]) + head + _squeeze(b"".join(bytes([p]) + varint(n) for p, n in runs)))
    low, high = min(values), max(values)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    prefix = low[:n].rstrip("0123456789")
    rest = [v[len(prefix) :] for v in values]
    if all(r.isascii() and r.isdigit() and len(r) <= 18 for r in rest):
        width = len(rest[0]) if len({len(r) for r in rest}) == 1 else 0
        if all(str(int(r)).zfill(width) == r for r in rest):
            p = prefix.encode()
            made.append(bytes([PREFIX]) + varint(len(p)) + p + varint(width) + _ints([int(r) for r in rest]))
    seconds = [epoch(v) for v in values]
    if None not in seconds and len({len(v) for v in values}) == 1:
        whole = len(values[0]) > 10
        if all(iso(t, whole) == v for t, v in zip(seconds, values, strict=True)):
            made.append(bytes([TIMESTAMP, whole]) + _ints(seconds))
    if found := hex_suffix(values):
        made.append(bytes([HEX]) + _part(found[0].encode()) + varint(len(values)) + found[1])
    if packed := base64_bytes(values):
        made.append(bytes([BASE64]) + varint(len(values)) + packed)
    flat = [v.replace("-", "") for v in values]
    if all(len(f) == 32 and set(f) <= set("0123456789abcdef") and f"{f[:8]}-{f[8:12]}-{f[12:16]}-{f[16:20]}-{f[20:]}" == v for f, v in zip(flat, values, strict=True)):
        made.append(bytes([UUID]) + bytes.fromhex("".join(flat)))
    return made


def decode_column(b: bytes, tables: list[list] | None = None) -> list:
    if not b:
        raise ValueError("unexpected end")
    tag = b[0]
    if tag == TIMESTAMP:
        return [iso(v, bool(b[1])) for v in _ints_back(b[2:])]
    if tag == HEX:
        prefix, at = _part_at(b, 1)
        n, at = varint_at(b, at)
        h = b[at:].hex()
        return [prefix.decode() + h[i : i + len(h) // n] for i in range(0, len(h), len(h) // n)]
    if tag == BASE64:
        n, at = varint_at(b, 1)
        size = (len(b) - at) // n
        return [base64.b64encode(b[i : i + size]).decode() for i in range(at, len(b), size)]
    if tag == SUB_TABLE:
        counts, at = _part_at(b, 1)
        items, out, used = decode_column(b[at:], tables), [], 0
        for n in _ints_back(counts):
            out.append(items[used : used + n])
            used += n
        return out
    if tag == OBJECT:
        keys, at = _part_at(b, 1)
        keys, cols = json.loads(keys), []
        for _ in keys:
            body, at = _part_at(b, at)
            cols.append(decode_column(body, tables))
        return [dict(zip(keys, r, strict=True)) for r in zip(*cols, strict=True)]
    if tag == ENUM_REF:
        k, at = varint_at(b, 1)
        if not tables or k >= len(tables):
            raise ValueError("a shared table is missing")
        return [tables[k][p] for p in _expand(b[at:])]
    if tag == NULLS:
        return [None] * varint_at(b, 1)[0]
    if tag == TEXT:
        return json.loads(_expand(b[1:]))
    if tag == PERIOD:
        n, at = varint_at(b, 1)
        base = decode_column(b[at:], tables)
        return [base[i % len(base)] for i in range(n)]
    if tag == BOOL:
        n, at = varint_at(b, 1)
        return [c == "1" for c in bin(int.from_bytes(b[at:], "big"))[3:]] if n else []
    if tag == DELTA:
        return _ints_back(b[1:])
    if tag == FIXED:
        return [float(v / 10 ** b[1]) for v in _ints_back(b[2:])]
    if tag in (ENUM, RUNS):
        n, at = varint_at(b, 1)
        variants, body = json.loads(_expand(b[at : at + n])), _expand(b[at + n :])
        if tag == ENUM:
            return [variants[p] for p in body]
        out, at = [], 0
        while at < len(body):
            p = body[at]
            n, at = varint_at(body, at + 1)
            out += [variants[p]] * n
        return out
    if tag == PREFIX:
        n, at = varint_at(b, 1)
        prefix = b[at : at + n].decode()
        width, at = varint_at(b, at + n)
        return [prefix + str(v).zfill(width) for v in _ints_back(b[at:])]
    if tag == UUID:
        h = b[1:].hex()
        return [f"{h[i : i + 8]}-{h[i + 8 : i + 12]}-{h[i + 12 : i + 16]}-{h[i + 16 : i + 20]}-{h[i + 20 : i + 32]}" for i in range(0, len(h), 32)]
    raise ValueError(f"unknown column encoding {tag}")


def float_bytes(v: float) -> bytes:
    """A float as a tagged integer, 32-bit or 64-bit value, whichever is exact first."""
    if abs(v) < 2**62 and v == int(v) and not (v == 0 and str(v)[0] == "-"):
        return b"\0" + varint(zig(int(v)))
    if float(np.float32(v)) == v:
        return b"\1" + struct.pack("<f", v)
    return b"\2" + struct.pack("<d", v)


def float_from(b: bytes) -> float:
    """The value of float_bytes()."""
    if b[0] == 0:
        return float(zag(varint_at(b, 1)[0]))
    return struct.unpack("<f" if b[0] == 1 else "<d", b[1:])[0]


def payload_bytes(kind: str, value, ids: dict[str, int]) -> bytes:
    """A token's payload: the place of a known text, 65535 and the text itself, an integer, a float or a truth value."""
    if kind == "str":
        place = ids.get(value)
        return varint(place) if place is not None else varint(65535) + _part(value.encode())
    if kind == "int":
        return varint(zig(value))
    if kind == "float":
        return struct.pack("<d", value)
    return bytes([value]) if kind == "bool" else b""


def payload_at(kind: str, b: bytes, at: int, texts: list[str]):
    """(value, end) of a payload."""
    if kind == "str":
        n, at = varint_at(b, at)
        if n == 65535:
            body, at = _part_at(b, at)
            return body.decode(), at
        if n >= len(texts):
            raise ValueError("unknown id")
        return texts[n], at
    if kind == "int":
        n, at = varint_at(b, at)
        return zag(n), at
    if kind == "float":
        return struct.unpack_from("<d", b, at)[0], at + 8
    return (bool(b[at]), at + 1) if kind == "bool" else (None, at)


def dictionary_bytes(entries: list[tuple[int, str]]) -> bytes:
    """(kind, text) entries in order of their ids: their number, then kind, length and UTF-8 bytes of each."""
    return varint(len(entries)) + b"".join(bytes([k]) + _part(v.encode()) for k, v in entries)


def dictionary_from(b: bytes) -> list[tuple[int, str]]:
    n, at = varint_at(b, 0)
    out = []
    for _ in range(n):
        kind = b[at]
        body, at = _part_at(b, at + 1)
        out.append((kind, body.decode()))
    if at != len(b):
        raise ValueError("bytes after the dictionary")
    return out


def shared_tables(columns: list[list[list]], least_chunks: int = 3) -> list[list[str] | None]:
    """For each column, given by chunks: its variants by first place if at least least_chunks chunks of texts share at most MAX_VARIANTS, else None."""
    out: list[list[str] | None] = []
    for chunks in columns:
        seen = dict.fromkeys(v for c in chunks for v in c) if len(chunks) >= least_chunks and all(type(v) is str for c in chunks for v in c) else {}
        out.append(list(seen) if 0 < len(seen) <= MAX_VARIANTS else None)
    return out
