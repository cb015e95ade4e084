"""Context-tree weighting of many short texts at once: the bytes of entropy.ctw_encode, a text a lane of numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import entropy

#: Texts of a block, their bytes when all are as long as the longest, and how many texts' work a step over lanes costs at least.
LANES, BYTES, WORTH = 1024, 1 << 20, 24
_FULL, _TOP = (1 << 32) - 1, 1 << 31


def _blocks(sizes: list[int]) -> Iterator[tuple[list[int], bool]]:
    """(places, whether lanes pay) of texts that are about as long as each other, the longest of a block first."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    at = 0
    while at < len(order):
        longest = max(1, sizes[order[at]])
        part = order[at : at + max(1, min(LANES, BYTES // longest))]
        yield part, sum(sizes[i] for i in part) >= WORTH * longest
        at += len(part)


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _padded(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


class _Coders:
    """entropy.ContextBits and the bounds of entropy.BitCoder, a lane each."""

    def __init__(self, n: int, depth: int, least: int = 4) -> None:
        self.depth, self.least, self.t = depth, least, 0
        self.base = np.arange(n, dtype=np.int64) * (4 << depth)
        self.counts = np.zeros(n * (4 << depth), np.int32)
        self.ones = (1 << np.arange(depth + 1, dtype=np.int64))[:, None]
        self.past, self.lo, self.hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, _FULL, np.int64)

    def mid(self, n: int) -> np.ndarray:
        """The last value that means a zero bit, for the first n lanes."""
        ones = self.ones[: min(self.depth, self.t) + 1]
        self.at = at = self.base[:n] + 2 * (ones | self.past[:n] & (ones - 1))
        zeros = self.counts[at]
        seen = zeros + self.counts[at + 1]
        pick = np.maximum((seen >= self.least).sum(0) - 1, 0), np.arange(n)  # a longer context is never seen more often
        num, den = 2 * zeros[pick].astype(np.int64) + 1, 2 * seen[pick].astype(np.int64) + 2
        lo, wide = self.lo[:n], self.hi[:n] - self.lo[:n]
        return lo + np.maximum(1, np.minimum(wide, (wide + 1) * num // den)) - 1

    def take(self, n: int, mid: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Learns a bit; (lower bounds, their leading bits that are settled, bits that stay pending after those)."""
        self.counts[self.at + bit] += 1
        self.past[:n] = (self.past[:n] << 1 | bit) & ((1 << self.depth) - 1)
        self.t += 1
        lo, hi = np.where(bit, mid + 1, self.lo[:n]), np.where(bit, self.hi[:n], mid)
        settled = 32 - _bit_length(lo ^ hi)
        low = lo << settled & _FULL
        high = (hi << settled | (1 << settled) - 1) & _FULL
        pending = 31 - _bit_length(~(low & ~high) & (_TOP - 1))
        self.lo[:n] = low << pending & (_TOP - 1)
        self.hi[:n] = (high << pending | (1 << pending) - 1 | _TOP) & _FULL
        return lo, settled, pending


def _encoded(texts: list[bytes], depth: int) -> list[bytes]:
    width, n = len(texts[0]), len(texts)
    bits = np.ascontiguousarray(np.unpackbits(_padded(texts, width), axis=1).T)
    live = np.searchsorted(-np.array([8 * len(t) for t in texts]), -np.arange(8 * width), "left")
    coders, out = _Coders(n, depth), np.zeros((n, 8 * width + 64), np.uint8)
    size, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(at: np.ndarray, lo: np.ndarray, settled: np.ndarray) -> None:
        """Settled leading bits of lo; the pending ones come after the first, inverted."""
        nonlocal out
        held = open_[at]
        if (need := int((size[at] + held + settled).max()) + 1) > out.shape[1]:
            out = np.pad(out, ((0, 0), (0, max(need, out.shape[1]))))
        first = lo >> 31 & 1
        out[at, size[at]] = first
        zero = np.flatnonzero((held > 0) & (first == 0))
        for j in range(int(held[zero].max(initial=0))):
            zero = zero[held[zero] > j]
            out[at[zero], size[at[zero]] + 1 + j] = 1
        size[at] += held
        for k in range(1, int(settled.max())):
            more = np.flatnonzero(settled > k)
            out[at[more], size[at[more]] + k] = lo[more] >> (31 - k) & 1
        size[at] += settled
        open_[at] = 0

    for t in range(8 * width):
        a = int(live[t])
        lo, settled, pending = coders.take(a, coders.mid(a), bits[t, :a].astype(np.int64))
        if len(at := np.flatnonzero(settled)):
            put(at, lo[at], settled[at])
        open_[:a] += pending
    open_ += 1
    put(np.arange(n), (coders.lo >= 1 << 30).astype(np.int64) << 31, np.ones(n, np.int64))
    packed = np.packbits(out, axis=1)
    return [packed[i, : (s + 7) // 8].tobytes() for i, s in enumerate(size.tolist())]


def _decoded(blobs: list[bytes], sizes: list[int], depth: int) -> list[bytes]:
    n, width, end = len(blobs), sizes[0], max(map(len, blobs))
    raw = _padded(blobs, end + 5).astype(np.int64)
    window = sum(raw[:, k : end + 1 + k] << (32 - 8 * k) for k in range(5))  # 40 bits from each byte on
    live = np.searchsorted(-8 * np.array(sizes), -np.arange(8 * width), "left")
    coders, code, at = _Coders(n, depth), window[:, 0] >> 8, np.full(n, 32, np.int64)
    bits, lanes = np.zeros((n, 8 * width), np.uint8), np.arange(n)
    for t in range(8 * width):
        a = int(live[t])
        mid = coders.mid(a)
        bit = (code[:a] > mid).astype(np.int64)
        _, settled, pending = coders.take(a, mid, bit)
        bits[:a, t] = bit
        k, p = settled + pending, at[:a]
        new = window[lanes[:a], np.minimum(p >> 3, end)] >> (40 - (p & 7) - k) & (1 << k) - 1
        c = (code[:a] << settled | new >> pending) & _FULL
        code[:a] = c & _TOP | c << pending & (_TOP - 1) | new & (1 << pending) - 1
        at[:a] += k
    packed = np.packbits(bits, axis=1)
    return [packed[i, :s].tobytes() for i, s in enumerate(sizes)]


def ctw_encode(texts: list[bytes], depth: int = 8) -> list[bytes]:
    """entropy.ctw_encode of each text."""
    out: list[bytes] = [b""] * len(texts)
    for part, pays in _blocks([len(t) for t in texts]):
        made = _encoded([texts[i] for i in part], depth) if pays else [entropy.ctw_encode(texts[i], depth) for i in part]
        for i, x in zip(part, made, strict=True):
            out[i] = x
    return out


def ctw_decode(blobs: list[bytes], sizes: list[int], depth: int = 8) -> list[bytes]:
    """entropy.ctw_decode of each blob to a text of its size."""
    out: list[bytes] = [b""] * len(blobs)
    for part, pays in _blocks(sizes):
        made = _decoded([blobs[i] for i in part], [sizes[i] for i in part], depth) if pays else [entropy.ctw_decode(blobs[i], sizes[i], depth) for i in part]
        for i, x in zip(part, made, strict=True):
            out[i] = x
    return out


def auto_encode(texts: list[bytes]) -> list[bytes]:
    """entropy.auto_encode of each text."""
    return [entropy.smallest(t, c) for t, c in zip(texts, ctw_encode(texts), strict=True)]


def auto_decode(blobs: list[bytes]) -> list[bytes]:
    """entropy.auto_decode of each blob."""
    out: list[bytes | None] = [None if b[:1] == bytes([entropy.CTW]) else entropy.auto_decode(b) for b in blobs]
    rest = [i for i, x in enumerate(out) if x is None]
    heads = [entropy.varint_at(blobs[i], 1) for i in rest]
    for i, x in zip(rest, ctw_decode([blobs[i][at:] for i, (_, at) in zip(rest, heads, strict=True)], [n for n, _ in heads]), strict=True):
        out[i] = x
    return out
