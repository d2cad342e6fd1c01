"""Periodic runs of words: maximal stretches that repeat with a period, found in each text by its grammar.

A run of period p with at least max(least, times * p) words holds a place g and g + p for one g of a grid whose step is that
length less p. For every period and grid place whose two words agree, the grammar of the texts (``recompression``) tells how
far the agreement goes in both directions, which gives the exact run. The grids of all periods together have n log n
places. A stretch found with several periods is listed with the smallest, which divides the others.

Texts of a slice share one grammar; words of their own stand between them, so nothing extends from one text to the next.

Edge cases: a null or empty text, or one without words, has no words and no runs and collapses to an empty text; rows are
judged one by one, so repeated rows, null or repeated ids and ties change nothing; other columns are kept, but those named like a result
are replaced; an empty table gives an empty table; a text longer than a slice is worked on alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import SPACE_WORDS, slices, text_buffer, word_spans
from catloom.llm.recompression import Grammar

LEAST, TIMES = 24, 3
PLACES = 1 << 20  # grid places worked on at a time
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULTS = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}


def coded_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The words (as bytes) with a number for each distinct one."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    packed = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words."""
    return coded_words(data, starts, ends).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _grid(base: np.ndarray, size: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the grids of texts that begin at ``base`` and have ``size`` words, some at a time."""
    periods = size // times
    text = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(least, times * period) - period
    count = -(-(size[text] - period) // step)
    upto = np.cumsum(count)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PLACES, "right")))
        own = count[lo:hi]
        nth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        yield np.repeat(base[text[lo:hi]], own) + nth * np.repeat(step[lo:hi], own), np.repeat(period[lo:hi], own)
        lo = hi


def find_runs(names: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order. ``first``: index of each text's first word, and one more."""
    none = np.zeros((0, 4), np.int64)
    size = np.diff(first)
    long = np.flatnonzero(size >= least)
    if not len(long):
        return none
    size = size[long]
    base = np.cumsum(size + 1) - size
    symbols = np.arange(int(names.max()) + 1, int(names.max()) + 2 + size.sum() + len(size), dtype=np.int64)
    at = np.repeat(base - first[long], size) + np.concatenate([np.arange(first[t], first[t + 1]) for t in long])
    symbols[at] = names[at - np.repeat(base - first[long], size)]
    grammar, found = Grammar(symbols), []
    for place, period in _grid(base, size, least, times):
        agree = symbols[place] == symbols[place + period]
        place, period = place[agree], period[agree]
        if len(place):
            start = place - grammar.behind(place - 1, place + period - 1)
            length = place + grammar.ahead(place, place + period) + period - start
            enough = length >= np.maximum(least, times * period)
            found.append(np.stack([start[enough], length[enough], period[enough]], 1))
    rows = np.concatenate(found) if found else none[:, 1:]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    text = np.searchsorted(base, rows[:, 0], "right") - 1
    out = np.column_stack([long[text], rows[:, 0] - base[text], rows[:, 1], rows[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text joined by one space, and the offsets between texts."""
    starts, ends = starts[keep], ends[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[first]
    last = np.zeros(len(starts), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    mark = np.zeros(len(data) + 2, np.int8)
    mark[starts] += 1
    mark[ends + ~last] -= 1  # the byte after a word stands for the space; words are never adjacent
    spaced = np.append(data, np.uint8(0x20))
    spaced[ends[~last]] = 0x20
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    sizes = np.concatenate([[0], np.cumsum(ends - starts + ~last)])
    return np.ascontiguousarray(spaced[inside]), sizes[bounds]


def judge(batch: pa.RecordBatch, text: str, least: int, times: int) -> list[pa.Array]:
    """n_words, runs and collapsed of the texts of a batch."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
    starts, ends, first = word_spans(data, offsets, SPACE_WORDS)
    names = word_names(data, starts, ends)
    found = find_runs(names, first, least, times) if len(names) else np.zeros((0, 4), np.int64)
    change = np.zeros(len(names) + 1, np.int64)
    at = first[found[:, 0]] + found[:, 1]
    np.add.at(change, at + found[:, 3], 1)
    np.add.at(change, at + found[:, 2], -1)
    kept, bounds = _joined(data, starts, ends, first, np.cumsum(change[:-1]) == 0)
    count = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1))
    runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)], fields=list(_RUN))
    return [
        pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(count, pa.int32()), runs),
        pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(bounds), pa.py_buffer(kept)).cast(pa.string()),
    ]


def periodic_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns of ``docs`` but the text, n_words, runs (by start, then period; words are numbered from 0) and collapsed.

    collapsed: the words but those that some run holds after its first period, joined by one space.
    """
    others = [c for c in docs.columns if c != text and c not in RESULTS]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{c} {kind}" for c, kind in RESULTS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            own = judge(batch, "_text", least, times)
            yield pa.record_batch([*(batch.column(i) for i in range(len(others))), *own], [*others, *RESULTS])

    source = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias("_text"))
    return source.mapInArrow(run, ", ".join(fields))
