"""Entropy statistics in SQL, and the sequential kernels (rANS, order-1, context-tree weighting) for Arrow functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

M_BITS = 14


def histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """(stream, sym, raw): bytes of ASCII columns."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "stream", "v")
    chars = long.select("stream", F.explode(F.split("v", "")).alias("c")).filter("c <> ''")
    return chars.groupBy("stream", F.ascii("c").alias("sym")).agg(F.count("*").alias("raw"))


def normalize(freq: DataFrame, m: int = 1 << M_BITS) -> DataFrame:
    """freq with norm and cum: counts scaled to sum m, none below 1.

    Slots left over go by the remainder per floor, larger symbols first among ties; excess is
    taken from the largest. Ratios are compared as exact decimals.
    """
    g = Window.partitionBy("stream")
    f = freq.withColumn("tot", F.sum("raw").over(g))
    f = f.withColumn("fl", F.greatest(F.lit(1), F.floor(F.col("raw") * m / F.col("tot"))).cast("long"))
    f = f.withColumn("rem", F.greatest(F.lit(0), F.col("raw") * m - F.col("fl") * F.col("tot")))
    f = f.withColumn("left", F.lit(m) - F.sum("fl").over(g))
    ratio = F.col("rem").cast("decimal(38,18)") / F.col("fl")
    f = f.withColumn("rk", F.row_number().over(g.orderBy(ratio.desc(), F.col("sym").desc())))
    f = f.withColumn("norm0", F.col("fl") + F.when(F.col("rk") <= F.greatest(F.lit(0), F.col("left")), 1).otherwise(0))
    f = f.withColumn("big", F.row_number().over(g.orderBy(F.col("norm0").desc(), F.col("sym").desc())))
    f = f.withColumn("norm", (F.col("norm0") - F.when(F.col("big") == 1, F.greatest(F.lit(0), -F.col("left"))).otherwise(0)).cast("long"))
    return f.withColumn("cum", (F.sum("norm").over(g.orderBy("sym")) - F.col("norm")).cast("long")).select("stream", "sym", "raw", "norm", "cum")


def bit_cost(freq: DataFrame, m: int = 1 << M_BITS) -> DataFrame:
    """(stream, est_bits, est_bytes) of normalised counts, with integer logarithms."""
    log_m = m.bit_length() - 1
    cost = F.col("raw") * (F.greatest(F.lit(0), F.lit(log_m) - S.bit_width_ceil(F.col("norm"))) + 1)
    return freq.groupBy("stream").agg(F.sum(cost).cast("long").alias("est_bits")).withColumn("est_bytes", (F.floor(F.col("est_bits") / 8) + 1).cast("long"))


def distinct_gate(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, n_bytes, n_distinct, skip): whether a text has too many distinct bytes, or too few bytes, to be worth coding."""
    h = F.hex(F.encode(F.col(col), "UTF-8"))
    n = F.octet_length(col).cast("long")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.substring(h, i, F.lit(2))))
    d = F.when(n > 0, F.size(pairs)).otherwise(0).cast("long")
    return df.select(id_col, n.alias("n_bytes"), d.alias("n_distinct")).withColumn("skip", (F.col("n_bytes") < 32) | (F.col("n_distinct") * 10 > F.col("n_bytes") * 8))


def order1_counts(df: DataFrame, group: str, order: str, sym: str) -> DataFrame:
    """(prev, sym, cnt): symbol pairs along each group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("prev", F.coalesce(F.lag(sym).over(w), F.lit("^"))).groupBy("prev", F.col(sym).alias("sym")).agg(F.count("*").alias("cnt"))


def kt_estimate(df: DataFrame, context: str, bit: str) -> DataFrame:
    """(context, n0, n1, num, den): the odds (2 n0 + 1) / (2 n + 2) of a zero bit in a context."""
    a = df.groupBy(F.col(context).alias("context")).agg(F.count_if(F.col(bit) == 0).alias("n0"), F.count_if(F.col(bit) == 1).alias("n1"))
    return a.withColumn("num", F.col("n0") * 2 + 1).withColumn("den", (F.col("n0") + F.col("n1")) * 2 + 2)


# kernels: sequential by nature, run per stream inside Arrow functions


def scaled(raw: dict[int, int], bits: int = 12) -> dict[int, int]:
    """Counts scaled to sum 2^bits, none below 1."""
    m, total = 1 << bits, sum(raw.values())
    out = {s: max(1, c * m // total) for s, c in raw.items()}
    spare = m - sum(out.values())
    for s in sorted(out, key=lambda s: (-raw[s], s)):
        if spare == 0:
            break
        move = spare if spare > 0 else max(spare, 1 - out[s])
        out[s] += move
        spare -= move
    return out


def rans_encode(data: bytes, freq: dict[int, int], bits: int = 12) -> bytes:
    """Range asymmetric numeral system: 32-bit state, byte renormalisation, coded from the end; the final state leads."""
    cum, at = {}, 0
    for s in sorted(freq):
        cum[s], at = at, at + freq[s]
    low = 1 << 23
    state, out = low, bytearray()
    for s in reversed(data):
        f = freq[s]
        top = ((low >> bits) << 8) * f
        while state >= top:
            out.append(state & 255)
            state >>= 8
        state = (state // f << bits) + state % f + cum[s]
    return state.to_bytes(4, "little") + bytes(reversed(out))


def rans_decode(blob: bytes, n: int, freq: dict[int, int], bits: int = 12) -> bytes:
    state, at, mask, low = int.from_bytes(blob[:4], "little"), 4, (1 << bits) - 1, 1 << 23
    if len(freq) == 1 and state == low and len(blob) == 4:
        return bytes(freq) * n
    slots, cum, upto = slot_table(freq, bits), {}, 0
    for s in sorted(freq):
        cum[s], upto = upto, upto + freq[s]
    out = bytearray()
    for _ in range(n):
        s = slots[state & mask]
        out.append(s)
        state = freq[s] * (state >> bits) + (state & mask) - cum[s]
        while state < low and at < len(blob):
            state = state << 8 | blob[at]
            at += 1
    if state != low or at != len(blob):
        raise ValueError("rANS stream does not end where it began")
    return bytes(out)


class BitCoder:
    """Binary arithmetic coding with 32-bit bounds; odds of a zero come as (num, den)."""

    def __init__(self, data: bytes | None = None) -> None:
        self.lo, self.hi, self.pending, self.bits = 0, 0xFFFFFFFF, 0, []
        self.data, self.at, self.code = data, 0, 0
        if data is not None:
            for _ in range(32):
                self.code = self.code << 1 | self._next()

    def _next(self) -> int:
        i, self.at = self.at, self.at + 1
        return self.data[i >> 3] >> (7 - (i & 7)) & 1 if i >> 3 < len(self.data) else 0

    def _split(self, num: int, den: int) -> int:
        return self.lo + max(1, min(self.hi - self.lo, (self.hi - self.lo + 1) * num // den)) - 1

    def _shift(self, on_bit) -> None:
        half, quarter = 1 << 31, 1 << 30
        while True:
            if self.hi < half:
                on_bit(0, 0)
            elif self.lo >= half:
                on_bit(1, half)
            elif self.lo >= quarter and self.hi < 3 * quarter:
                on_bit(None, quarter)
            else:
                return

    def _move(self, off: int) -> None:
        self.lo, self.hi = (self.lo - off) << 1, ((self.hi - off) << 1) | 1

    def encode(self, bit: int, num: int, den: int) -> None:
        mid = self._split(num, den)
        self.lo, self.hi = (mid + 1, self.hi) if bit else (self.lo, mid)

        def out(b, off):
            if b is None:
                self.pending += 1
            else:
                self.bits += [b] + [1 - b] * self.pending
                self.pending = 0
            self._move(off)

        self._shift(out)

    def finish(self) -> bytes:
        self.pending += 1
        b = int(self.lo >= 1 << 30)
        self.bits += [b] + [1 - b] * self.pending
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))

    def decode(self, num: int, den: int) -> int:
        mid = self._split(num, den)
        bit = int(self.code > mid)
        self.lo, self.hi = (mid + 1, self.hi) if bit else (self.lo, mid)

        def read(_, off):
            self.code = (self.code - off) << 1 | self._next()
            self._move(off)

        self._shift(read)
        return bit


class ContextBits:
    """Bit odds by the longest context, up to depth bits, that was seen at least `least` times; Krichevsky-Trofimov counts."""

    def __init__(self, depth: int = 8, least: int = 4) -> None:
        self.depth, self.least, self.counts, self.past = depth, least, {}, ()

    def odds(self) -> tuple[int, int]:
        for d in range(min(self.depth, len(self.past)), -1, -1):
            n = self.counts.get(self.past[len(self.past) - d :], (0, 0))
            if d == 0 or sum(n) >= self.least:
                return 2 * n[0] + 1, 2 * sum(n) + 2

    def learn(self, bit: int) -> None:
        for d in range(min(self.depth, len(self.past)) + 1):
            key = self.past[len(self.past) - d :]
            n = self.counts.get(key, (0, 0))
            self.counts[key] = (n[0] + 1 - bit, n[1] + bit)
        self.past = (*self.past, bit)[-self.depth :]


def ctw_encode(data: bytes, depth: int = 8) -> bytes:
    coder, model = BitCoder(), ContextBits(depth)
    for byte in data:
        for k in range(7, -1, -1):
            coder.encode(byte >> k & 1, *model.odds())
            model.learn(byte >> k & 1)
    return coder.finish()


def ctw_decode(blob: bytes, n: int, depth: int = 8) -> bytes:
    coder, model, out = BitCoder(blob), ContextBits(depth), bytearray()
    for _ in range(n):
        byte = 0
        for _ in range(8):
            bit = coder.decode(*model.odds())
            model.learn(bit)
            byte = byte << 1 | bit
        out.append(byte)
    return bytes(out)


def _varint(n: int) -> bytes:
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


def _fills(freq: dict[int, int], bits: int) -> None:
    if any(f <= 0 for f in freq.values()) or sum(freq.values()) != 1 << bits:
        raise ValueError("frequencies must be positive and fill all slots")


def slot_table(freq: dict[int, int], bits: int = 12) -> bytes:
    """The symbol of every slot; refuses frequencies that are not positive or do not fill all slots."""
    _fills(freq, bits)
    return b"".join(bytes([s]) * freq[s] for s in sorted(freq))


def table_bytes(freq: dict[int, int], bits: int = 12) -> bytes:
    """A frequency table as bytes: slots' bits, symbols, then (distance from the symbol before, frequency - 1) of each."""
    out, last = bytearray([bits]) + _varint(len(freq)), -1
    for s in sorted(freq):
        out += _varint(s - last - 1) + _varint(freq[s] - 1)
        last = s
    return bytes(out)


def table_at(blob: bytes, at: int = 0) -> tuple[dict[int, int], int, int]:
    """(frequencies, bits, end) of a table's bytes; refuses those that do not fill their slots."""
    if at >= len(blob):
        raise ValueError("unexpected end")
    bits = blob[at]
    if not 1 <= bits <= 16:
        raise ValueError("bits of a frequency table out of range")
    n, at = varint_at(blob, at + 1)
    freq, last = {}, -1
    for _ in range(n):
        gap, at = varint_at(blob, at)
        f, at = varint_at(blob, at)
        last += gap + 1
        freq[last] = f + 1
    _fills(freq, bits)
    return freq, bits, at


def coded(data: bytes) -> bytes:
    """data as length, frequency table and rANS stream: all that a second process needs."""
    if not data:
        return b"\0"
    if data.count(data[0]) == len(data):
        return _varint(len(data)) + table_bytes({data[0]: 1 << 12}) + rans_encode(b"", {})  # a lone symbol leaves the state as it is
    raw: dict[int, int] = {}
    for x in data:
        raw[x] = raw.get(x, 0) + 1
    freq = scaled(raw)
    return _varint(len(data)) + table_bytes(freq) + rans_encode(data, freq)


def uncoded(blob: bytes) -> bytes:
    n, at = varint_at(blob, 0)
    if not n:
        return b""
    freq, bits, at = table_at(blob, at)
    return rans_decode(blob[at:], n, freq, bits)


def estimate(data: bytes) -> float:
    """Bytes that an order-0 coder needs for data, its table left out."""
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=1)
    count = count[count > 0]
    return float((count * (np.log2(len(data)) - np.log2(count))).sum() / 8) if len(data) else 0.0


def attempt(data: bytes, least: int = 32) -> bytes | None:
    """The rANS form of data where it is smaller; tried only for least bytes or more of which the estimate, with its table, is smaller too."""
    if len(data) < least or estimate(data) + 2 * len(set(data)) >= len(data):
        return None
    made = coded(data)
    return made if len(made) < len(data) else None


#: coded and uncoded of short streams, which are few and come again in text after text.
_coded, _uncoded = lru_cache(1 << 14)(coded), lru_cache(1 << 14)(uncoded)


def order1_encode(data: bytes) -> bytes:
    """Order-1 coding: the bytes that follow each byte are a stream with a table of its own."""
    streams: dict[int, bytearray] = {}
    last = 0
    for x in data:
        streams.setdefault(last, bytearray()).append(x)
        last = x
    out = bytearray(_varint(len(data)) + _varint(len(streams)))
    for s in sorted(streams):
        body = _coded(bytes(streams[s])) if len(streams[s]) <= 8 else coded(bytes(streams[s]))
        out.append(s)
        out += _varint(len(body))
        out += body
    return bytes(out)


def order1_decode(blob: bytes) -> bytes:
    n, at = varint_at(blob, 0)
    k, at = varint_at(blob, at)
    streams = {}
    for _ in range(k):
        s = blob[at]
        size, at = varint_at(blob, at + 1)
        body = blob[at : at + size]
        streams[s] = iter(_uncoded(body) if body[:1] <= b"\x08" else uncoded(body))
        at += size
    out, last = bytearray(), 0
    for _ in range(n):
        last = next(streams[last])
        out.append(last)
    return bytes(out)


#: Codec tags of auto_encode.
PLAIN, RANS, ORDER1, CTW = range(4)


def smallest(data: bytes, ctw: bytes | None) -> bytes:
    """The smallest of the codecs' forms behind a byte that names it; ctw: data's ctw_encode, or None to leave that out.

    What cannot be smaller than the plain form is not made: rANS needs 7 bytes and 2 a symbol, order-1 2 and 11 a context.
    """
    made = [bytes([PLAIN]) + data]
    if 7 + 2 * len(set(data)) < len(data):
        made.append(bytes([RANS]) + coded(data))
    if 2 + 11 * len(set(data[:-1]) | {0}) < len(data):
        made.append(bytes([ORDER1]) + order1_encode(data))
    if ctw is not None and data:
        made.append(bytes([CTW]) + _varint(len(data)) + ctw)
    return min(made, key=len)


def auto_encode(data: bytes, ctw: bool = True) -> bytes:
    """The smallest of the codecs' forms behind a byte that names it."""
    return smallest(data, ctw_encode(data) if ctw and data else None)


def auto_decode(blob: bytes) -> bytes:
    if not blob:
        raise ValueError("unexpected end")
    if blob[0] == PLAIN:
        return blob[1:]
    if blob[0] == RANS:
        return uncoded(blob[1:])
    if blob[0] == ORDER1:
        return order1_decode(blob[1:])
    if blob[0] == CTW:
        n, at = varint_at(blob, 1)
        return ctw_decode(blob[at:], n)
    raise ValueError(f"unknown codec {blob[0]}")
