"""Helpers shared by the operators: kept tables, text buffers as numpy arrays, word spans, span hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catloom.session import checkpoint_folder

SLICE_BYTES = 2_000_000  # text worked on at a time inside a task; a longer document is worked on alone
_ALL = 0xFFFFFFFFFFFFFFFF
_BASE = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # two odd multipliers for two independent span hashes

# White space as the contracts list it: [\x20\x09-\x0D].
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, lower-case ASCII letters and every byte of a non-ASCII character.
LETTER_DIGIT_WORDS = np.zeros(256, bool)
LETTER_DIGIT_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Kept:
    """Tables written to a folder of their own under spark.checkpoint.dir.

    Counts and minima by a key that may be hot are written before the rows are joined to them: then both sides of the
    join are plain shuffles, and adaptive execution can split the hot key's partition.

    A written table cuts the lineage: a lost executor costs only its running tasks, and a table that is read
    several times is computed once. ``drop`` removes a table that nothing reads any more.
    """

    roots: list[str] = []  # of all folders made in this process, in order

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.roots.append(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        delete_folder(self.spark, f"{self.root}/{name}")

    @classmethod
    def drop_since(cls, spark: SparkSession, mark: int) -> None:
        """Delete the folders made after the first ``mark`` ones; nothing may read them any more."""
        for root in cls.roots[mark:]:
            delete_folder(spark, root)
        del cls.roots[mark:]


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_row(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 marks the held-out fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


# --- text buffers ---------------------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and the offsets between them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most about ``limit`` bytes of text."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.view(np.uint8) << 5)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    inside = is_word[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --- hashes ---------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASE]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept for slices of the usual size."""
    up, down = _powers.get(which, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    if len(up) <= n:
        base, inverse = _BASE[which], pow(_BASE[which], -1, 1 << 64)
        size = n + n // 8 + 1
        up, down = (np.full(size, b, np.uint64) for b in (base, inverse))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n <= 4 * SLICE_BYTES:
            _powers[which] = (up, down)
    return up, down


class Spans:
    """Hashes of any spans of a sequence of 64-bit symbols, from one prefix sum of powers."""

    def __init__(self, symbols: np.ndarray, which: int = 0) -> None:
        self.up, self.down = _power_tables(len(symbols) + 1, which)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.up[: len(symbols)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def byte_symbols(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _BYTE_VALUES[which][data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return Spans(byte_symbols(data, which), which).of(starts, ends)


def removed_spans(batch: pa.RecordBatch, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end (in the units of ``offsets``) of the union of windows that start in a batch's ``runs``."""
    runs = batch.column("runs")
    count = np.diff(np.asarray(runs.offsets))
    flat = runs.flatten()
    text = np.repeat(np.arange(batch.num_rows), count)
    lo = flat.field("lo").to_numpy(zero_copy_only=False).astype(np.int64)
    hi = flat.field("hi").to_numpy(zero_copy_only=False).astype(np.int64) + window
    # Texts are set apart by one unit, so that ranges of two texts never touch.
    at = offsets[:-1] + np.arange(len(offsets) - 1)
    starts, ends = merged(at[text] + lo, at[text] + hi)
    owner = np.searchsorted(at, starts, "right") - 1
    return owner, starts - at[owner] + offsets[owner], ends - at[owner] + offsets[owner]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as disjoint, not touching ranges in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > reach[:-1]
    heads = np.flatnonzero(first)
    return starts[heads], reach[np.append(heads[1:], len(starts)) - 1]
