"""Benchmark decontamination: Wu-Manber search of benchmark windows in document texts.

Texts are compared as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A pattern is a window of
``window`` consecutive item words; an item with fewer words, but not none, is one shorter pattern. For the patterns of one
length a table gives for each block of two words how far the search may move on; a block that ends no pattern and lies in
none moves it by almost a whole window. Where the shift is 0, the hash of the last block selects a bucket of patterns, the
hash of the whole window one of them, and the words themselves are compared before an occurrence counts.

Edge cases: a null or empty text has no words and no hits; items without words have no pattern; equal windows of several
items count for each of them; repeated rows are each judged; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import (
    LETTER_DIGIT_WORDS, Kept, Spans, lower_ascii, merged, slices, text_buffer, word_hashes, word_spans,
)

WINDOW = 13
SHARD_PATTERNS = 200_000  # patterns sent to the tasks at a time (about 40 MB); more are searched in further passes
_TABLE = 1 << 20
_CHUNK = 256  # end positions that one search cursor walks over


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words (joined by one space), n_words: the distinct windows of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = text_buffer(batch.column("text"))
            data = lower_ascii(raw)
            starts, ends, first = word_spans(data, offsets, LETTER_DIGIT_WORDS)
            ids, texts, sizes = [], [], []
            for row, item in enumerate(batch.column("item_id").to_pylist()):
                words = [data[a:b].tobytes() for a, b in zip(starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]])]
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if words else 0):
                    ids.append(item)
                    texts.append(b" ".join(words[i : i + size]))
                    sizes.append(size)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int32())], ["item_id", "words", "n_words"])

    out = "item_id long, words binary, n_words int"
    return items.select(F.col("item_id").cast("long"), "text").where("item_id is not null").mapInArrow(cut, out).distinct()


@dataclass
class Patterns:
    """The search tables of all patterns of one length."""

    length: int
    shift: np.ndarray
    bucket: np.ndarray  # sorted hashes of last blocks
    window: np.ndarray  # sorted hashes of whole windows
    words: list[bytes]  # in the order of ``window``
    items: list[list[int]]


def compile_patterns(rows: list[tuple[bytes, int, list[int]]]) -> list[Patterns]:
    """Tables for (words, number of words, items) rows, one for each length."""
    made = []
    for length in sorted({n for _, n, _ in rows}):
        own = [(w, items) for w, n, items in rows if n == length]
        data, offsets = text_buffer(pa.array([w for w, _ in own], pa.binary()))
        starts, ends, _ = word_spans(data, offsets, LETTER_DIGIT_WORDS)
        hashes = word_hashes(data, starts, ends)
        whole = Spans(hashes)
        heads = np.arange(len(own)) * length
        window = whole.of(heads, heads + length)
        block = min(2, length)
        shift = np.full(_TABLE, length - block + 1, np.uint8)
        for end in range(block - 1, length):
            at = whole.of(heads + end + 1 - block, heads + end + 1) & np.uint64(_TABLE - 1)
            np.minimum.at(shift, at.astype(np.int64), np.uint8(length - 1 - end))
        order = np.argsort(window, kind="stable")
        made.append(Patterns(
            length, shift, np.unique(whole.of(heads + length - block, heads + length)), window[order],
            [own[i][0] for i in order], [own[i][1] for i in order],
        ))
    return made


def _find(p: Patterns, spans: Spans, first: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
    """End positions (word indices) of occurrences and the indices of their patterns."""
    lo, hi = first[:-1] + p.length - 1, first[1:]
    keep = lo < hi
    lo, hi = lo[keep], hi[keep]
    parts = -(-(hi - lo) // _CHUNK)
    owner = np.repeat(np.arange(len(lo)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = lo[owner] + nth * _CHUNK
    stop = np.minimum(at + _CHUNK, hi[owner])
    block = min(2, p.length)
    found = []
    while len(at):
        last = spans.of(at + 1 - block, at + 1)
        shift = p.shift[(last & np.uint64(_TABLE - 1)).astype(np.int64)]
        stay = shift == 0
        if stay.any():
            ends, last = at[stay], last[stay]
            in_bucket = p.bucket[np.minimum(np.searchsorted(p.bucket, last), len(p.bucket) - 1)] == last
            found.append(ends[in_bucket])
        at = at + np.maximum(shift, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    ends = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not len(ends):
        return ends, ends
    whole = spans.of(ends + 1 - p.length, ends + 1)
    which = np.minimum(np.searchsorted(p.window, whole), len(p.window) - 1)
    same = p.window[which] == whole
    ends, which = ends[same], which[same]
    sure = np.fromiter((text_of(e + 1 - p.length, e + 1) == p.words[k] for e, k in zip(ends, which)), bool, len(ends))
    return ends[sure], which[sure]


def search(batch: pa.RecordBatch, patterns: list[Patterns]) -> pa.RecordBatch:
    """doc_id, n_words, hits (word ranges), items of one batch of documents."""
    raw, offsets = text_buffer(batch.column("text"))
    data = lower_ascii(raw)
    starts, ends, first = word_spans(data, offsets, LETTER_DIGIT_WORDS)
    spans = Spans(word_hashes(data, starts, ends))

    def text_of(a: int, b: int) -> bytes:
        return b" ".join(data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b]))

    rows = batch.num_rows
    hits: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    items: list[set[int]] = [set() for _ in range(rows)]
    for p in patterns:
        at, which = _find(p, spans, first, text_of)
        for end, row, k in zip(at, np.searchsorted(first, at, "right") - 1, which):
            hits[row].append((int(end + 1 - p.length - first[row]), int(end + 1 - first[row])))
            items[row].update(p.items[k])
    joined = []
    for found in hits:
        pairs = np.array(found, np.int64).reshape(-1, 2)
        joined.append([{"lo": int(a), "hi": int(b)} for a, b in zip(*merged(pairs[:, 0], pairs[:, 1]))])
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    return pa.record_batch(
        [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(first)), pa.array(joined, span), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
        ["row", "doc_id", "n_words", "hits", "items"],
    )


def find_items(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shard_patterns: int = SHARD_PATTERNS, row: Column | None = None) -> DataFrame:
    """row, doc_id, n_words, hits array<struct<lo,hi>> (words covered by occurrences), items array<long>, one row per document.

    ``row`` numbers the rows, by the column given or in any order, so that rows with one doc_id stay apart. The patterns are broadcast at most
    ``shard_patterns`` at a time; when there are more, each part is searched by itself and the findings of a document
    are joined.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "decontaminate")
    windows = benchmark_windows(items, window).groupBy("words", "n_words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = kept.table(windows, "windows")
    shards = max(1, -(-windows.count() // shard_patterns))
    number = F.monotonically_increasing_id() if row is None else row
    source = docs.select(number.alias("row"), F.col("doc_id").cast("long"), "text")
    out = "row long, doc_id long, n_words long, hits array<struct<lo:long,hi:long>>, items array<long>"
    parts = []
    for shard in range(shards):
        mine = windows.where(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard)
        tables = spark.sparkContext.broadcast(compile_patterns([(bytes(r.words), r.n_words, list(r.items)) for r in mine.collect()]))

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield search(batch, tables.value)

        parts.append(source.mapInArrow(scan, out))
    if shards == 1:
        return parts[0]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def judge(found: DataFrame, min_share: int = 20) -> DataFrame:
    """Adds n_hit, n_items and contaminated: some word is hit, and hit words times ``min_share`` reach all words."""
    covered = F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(x["lo"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], x["hi"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    counted = found.withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("long"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they were.

    Each row is judged by its own text, with or without a doc_id. The rows are written with their numbers first, so that
    a number names the same row whenever it is read.
    """
    kept = Kept(docs.sparkSession, "clean")
    held = kept.table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    source = held.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    bad = judge(find_items(source, items, row=F.col("row"), **options)).where("contaminated").select("row")
    return held.join(bad, "row", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
