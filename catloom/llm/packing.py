"""Packing of token sequences: first-fit decreasing in randomised groups of documents.

A document's ids end with ``end_id`` and are cut every ``length`` ids. The pieces of a group are placed in decreasing order,
each into the first sequence with room for it. A tournament tree over the room that is left finds that sequence in a number
of steps that is the logarithm of the number of sequences. Groups are random by doc_id and of bounded expected size, so no
task sees more than one group at a time, and what a piece is packed with does not depend on the order of the table.

Edge cases: a null or empty text is the end id alone; rows that share a doc_id are separate documents; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import slices
from catloom.llm.tokenizing import encoded, tokenizer_path

LENGTH = 2048
GROUP_DOCS = 8192
_SEQUENCE_BITS = 40  # sequences of one group; the group number is above


def cut_pieces(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """row, doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens of every piece."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, offsets in encoded(slices(batches), path, end_id):
            sizes = np.diff(offsets)
            pieces = -(-sizes // length)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            own = np.minimum(length, sizes[owner] - start)
            flat = np.ascontiguousarray(ids, "<u4")
            ends = np.concatenate([[0], np.cumsum(own)]) * 4
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.record_batch(
                [batch.column("row").take(pa.array(owner)), batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(own), blob.cast(pa.binary()), pa.array(sizes[owner])],
                ["row", "doc_id", "start", "length", "ids", "doc_tokens"],
            )

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(cut, "row long, doc_id long, start long, length long, ids binary, doc_tokens long")


class Tournament:
    """Room of each bin at the leaves, the larger room of two children above: finds the first bin with room."""

    def __init__(self, room: int, bins: int) -> None:
        self.size = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.tree = [room] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Take ``need`` from the first bin that has it; gives the bin and the room it had."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        bin_, had = at - self.size, tree[at]
        tree[at] = had - need
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return bin_, had


def first_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the pieces come in decreasing length, so whole ones have bins to themselves."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = int(np.searchsorted(-lengths, -room, "right"))
    bins[:whole] = np.arange(whole)
    tree = Tournament(room, len(lengths) - whole)
    for i in range(whole, len(lengths)):
        own, had = tree.place(int(lengths[i]))
        bins[i], offsets[i] = whole + own, room - had
    return bins, offsets


def pack(pieces: DataFrame, *, length: int = LENGTH, group_docs: int = GROUP_DOCS, documents: int | None = None, seed: int = 7) -> DataFrame:
    """The pieces with sequence_id and offset. ``documents``: how many there are, if known; it sets the number of groups."""
    n = documents if documents is not None else pieces.where("start = 0").count()
    groups = max(1, -(-n // group_docs))
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row"), F.lit(groups)))
    fields = [f for f in grouped.schema.fields if f.name != "_group"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = first_fit(frame["length"].to_numpy(), length)
        group = int(frame["_group"].iloc[0]) if len(frame) else 0
        return frame.drop(columns="_group").assign(sequence_id=(group << _SEQUENCE_BITS) + bins, offset=offsets)

    return grouped.groupBy("_group").applyInPandas(place, out)


def pack_documents(docs: DataFrame, *, digest: bool = False, **options) -> DataFrame:
    """Pieces of all documents with their place. ``digest``: the crc32 of the ids in their place, which moves less data."""
    cut = {k: options.pop(k) for k in ("tokenizer", "end_id") if k in options}
    pieces = cut_pieces(docs, length=options.get("length", LENGTH), **cut)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, documents=docs.count(), **options)
