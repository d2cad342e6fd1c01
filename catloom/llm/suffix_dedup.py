"""Exact substring deduplication of texts as UTF-8 bytes.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same document or another, is
removed; overlapping starts count, and strings are judged on the input. Positions are ranked by their strings at growing
lengths: rows that share a rank go on, unique ones drop out, and ranking ends at the threshold. Instead of all positions,
which would shuffle many times the corpus in each round, the anchors of windows are ranked first (see repeats.py); the
lengths are then those of blocks of neighbouring positions, down to single positions and exactly ``length`` bytes.

Edge cases: null texts are empty; matches never cross documents; texts shorter than ``length`` lose nothing; equal rows are
repeats of each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import byte_symbols, removed_spans, slices, text_buffer
from catloom.llm.repeats import Kind, by_length, first_look, keyed, place, runs_by_text

LENGTH = 400
PROBE = 100
BLOCKS = (64, 16, 4, 1)


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(batch.column("text"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, probe: int = PROBE, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<lo,hi>> (maximal removed byte runs), kept (binary, what is left), kept_sha256."""
    kind = Kind(_bytes, byte_symbols, "uint8", length, probe, earlier=False)
    found = first_look(docs, kind, "suffix")
    runs = place(found, by_length(found, kind, blocks), kind)
    grouped = runs_by_text(runs)
    none = F.array().cast(grouped.schema["runs"].dataType)
    texts = keyed(docs).join(grouped, ["did", "th"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = _bytes(batch)
            owner, lo, hi = removed_spans(batch, offsets, length)
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            spans = pa.StructArray.from_arrays([pa.array(lo - offsets[owner]), pa.array(hi - offsets[owner])], ["lo", "hi"])
            kept = []
            for i in range(batch.num_rows):
                edges = [offsets[i], *np.column_stack([lo, hi])[first[i] : first[i + 1]].ravel(), offsets[i + 1]]
                kept.append(b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"],
            )

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"doc_id {kind_of_id}, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary, kept_sha256 string")
