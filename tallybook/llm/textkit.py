"""Shared vectorised text handling for the operators of this subpackage.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D, as in the operators'
contracts.  All hashes are polynomial sums modulo 2**64 over mixed symbols, so the hash
of any range comes from two prefix sums, without touching the text again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space inside Java and RE2 character classes.
WHITE = r"\x20\x09-\x0D"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that one vectorised step takes at most (one document at least).
STEP_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and regrown by doubling."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = 1 << max(10, (n - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[int(base)] = known
    return known[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol[i] * R**i; see range_hash."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _powers(_R, len(symbols)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for arrays of ranges, wherever the range lies."""
    return mix64((prefix[end] - prefix[start]) * _powers(_RINV, len(prefix))[start] + (end - start).astype(np.uint64))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of text each, or one row."""
    texts = batch.column(batch.schema.get_field_index(column))
    if len(texts) == 0:
        return
    offsets = offsets_of(texts)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        upto = min(max(upto, at + 1), len(texts))
        yield batch.slice(at, upto - at)
        at = upto


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a string array's rows."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows joined, and the rows' offsets in them (null rows are empty)."""
    offsets = offsets_of(texts)
    if texts.null_count:
        texts = texts.fill_null("")
        offsets = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of a slice of documents: byte ranges, 64-bit hashes, rows' word offsets."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        raw, offsets = bytes_of(texts)
        solid = ~_SPACE[raw]
        before = np.zeros(len(raw), bool)
        before[1:] = solid[:-1]
        edge = np.unique(offsets[(offsets < len(raw))])
        before[edge] = False
        after = np.zeros(len(raw), bool)
        after[:-1] = solid[1:] & before[1:]
        self.raw, self.bytes_at = raw, offsets
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.row_at = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.row_at)
        if hashed:
            self.hash = range_hash(prefix_hash(raw.astype(np.uint64) + np.uint64(1)), self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def windows_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, by doubling: log2(width) passes."""
    have, span = keys, 1
    while span * 2 <= width:
        have = np.minimum(have[: len(have) - span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def binary_rows(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of bytes cut from one contiguous array of fixed-width items."""
    width = data.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start..start+count-1 of all ranges, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def crc_mod(column: Column | str, mod: int) -> Column:
    """The contracts' fold number: crc32 of the id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(mod))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone: extra columns, whatever their names, never reach an operator."""
    return docs.select(*columns)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its columns are called."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def quoted(columns: list[str]) -> list[Column]:
    """The columns by name, dots and quotes in names taken as they are."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


class tidy:
    """A worker function that gives freed memory back to the system when its task ends: workers live
    on between tasks, and what one held at most would stay theirs beside the next one's."""

    def __init__(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.run(batches)
        finally:
            trim()


def trim() -> None:
    """Give freed memory of this process back to the system."""
    for known in [k for k, v in _POWERS.items() if len(v) > 1 << 21]:
        del _POWERS[known]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Send texts to Python workers in batches of at most ``most`` bytes, for this session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(most))
