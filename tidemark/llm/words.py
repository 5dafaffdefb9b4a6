"""Words as ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts, and 64-bit hashes of them and of their n-grams."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of rows, about, that a task turns into Python's objects at once.
AT_ONCE = 4 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * AT_ONCE // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, over batches of bounded size (but a row stays whole).

    When the task ends, the worker, which other stages use again, gives back what it remembered.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_pieces(batches))
        finally:
            release()

    return tidied


def release() -> None:
    """Give memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hashed(words: list[bytes]) -> np.ndarray:
    """A hash for each word; to make it takes less time than to look it up."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """``np.unique`` by a plain sort, which is faster for what one text has."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of what ``a`` and ``b`` stand for."""
    x = (a * _K1 + b) * _K2
    return (x ^ (x >> _S32)) * _K1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, by doubling."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out, done, block, width = None, 0, hashes, 1
    while True:
        if k & width:
            out = block[done : done + n] if out is None else joined(out, block[done : done + n])
            done += width
        if done == k:
            return out
        block, width = joined(block[:-width], block[width:]), width * 2


def shingles(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of lower-cased (A-Z) ``text``.

    Of fewer than ``k`` words the whole sequence is the one shingle; without words there is none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    return distinct(grams(hashed(words), k).view(np.int64))


def _pack(batches):
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        packed = pa.array([None if x is None else squeeze(x) for x in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if i == at else batch.column(i) for i in range(batch.num_columns)], batch.schema.names)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with text as compressed binary, for the shuffle of whole documents."""
    return docs.mapInArrow(tidy(_pack), T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema]))


def unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else expand(x) for x in column.to_pylist()]
