"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one part of a packed exchange is meant to serve.
PART_BYTES = 24 << 20


#: Bytes of an Arrow batch sent to a Python worker, of which both sides hold several copies.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless it has a bound of its own; rows over the bound go alone."""
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocab(name: str) -> str:
    """A public tokenizer file's place on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Whether Spark deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(spark: SparkSession) -> None:
    """Lets go of checkpoints that nothing refers to any more, and of the heap that executors no longer use.

    An executor's JVM keeps the heap that earlier steps made it grow to while its Python workers need the room;
    one collection shrinks it to what is live. One task a core reaches every idle executor.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def settled(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint: lineage ends here, lost executors cost nothing before it, and its shuffle files go at once.

    The folder is spark.checkpoint.dir; where none is configured, a local session gets a temporary one (tests) and a cluster is refused.
    """
    spark = df.sparkSession
    bounded(spark)
    released(spark)
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEANUP, before)


_MALLOC = None


def spare(*caches: dict) -> None:
    """Empties caches and gives a Python worker's free memory back to the system, as idle workers are kept."""
    global _MALLOC
    for c in caches:
        c.clear()
    if _MALLOC is None:
        try:
            _MALLOC = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _MALLOC = lambda _: 0
    pa.default_memory_pool().release_unused()
    _MALLOC(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def parts_for(df: DataFrame, text: str, least: int = 8, each: int = PART_BYTES) -> int:
    """How many parts an exchange needs so that each serves a bounded amount of text."""
    n = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(least, math.ceil(n / each))


#: What str.split() takes for blanks beyond those of WORD.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    """The words of a text as WORD defines them (str.split() alone would also split at other blanks)."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def lower_words(text: str | None) -> list[str]:
    """words() after lower-casing A-Z only."""
    if not text:
        return []
    return words(text.lower() if text.isascii() else text.encode().lower().decode())


def pack(a: np.ndarray) -> bytes:
    """An integer or float array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    head = f"{a.dtype.str}:".encode()
    if not len(a):
        return head
    planes = a.view(np.uint8).reshape(len(a), -1).T
    return head + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    head, _, body = bytes(b).partition(b":")
    dtype = np.dtype(head.decode())
    if not body:
        return np.empty(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted unsigned array, as differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    d = unpack(b)
    return np.cumsum(d, dtype=d.dtype)


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


class WordHash(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    LIMIT = 1 << 17

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of every n consecutive words; a shorter text is one shingle, an empty one none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(n))


def rows_of(batches: Iterable, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of the named columns."""
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of sorted 64-bit keys cut into equal ranges of the key space; empty ones too."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    yield from zip(range(parts), at[:-1], at[1:], strict=True)


def text_blocks(batches: Iterable, chars: int) -> Iterator[list[tuple]]:
    """Rows of Arrow batches whose last column is a text, gathered until they hold enough characters."""
    rows: list[tuple] = []
    n = 0
    for b in batches:
        for r in rows_of([b], *b.schema.names):
            rows.append(r)
            n += len(r[-1] or "") + 16
            if n >= chars:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows
