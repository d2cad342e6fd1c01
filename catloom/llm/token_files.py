"""Token ids as flat binary files: one id file and one index file for each range of doc_ids.

Id file: the ids of the range's documents one after the other, little-endian, two bytes each if the vocabulary (and the end
id) fit, else four. Index file: 64-bit little-endian numbers, first the number of documents n, then n doc_ids, n flags (1: the
doc_id is null) and n + 1 offsets into the id file, counted in ids. Ranges ascend, documents ascend inside each (null first,
rows with one doc_id in any order, one after the other), so file k starts at the sum of the ids in files before it.

The files lie in a shared folder and are written under names of their own attempt, then renamed: a task that runs twice
leaves one complete file. Local paths are memory-mapped when read; others are read through pyarrow's file systems.

Edge cases: null and empty texts hold the end id only; an empty table makes no documents.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catloom.llm.common import slices
from catloom.llm.tokenizing import encoded, encoder, tokenizer_path

_STAT = "part long, ids_file string, index_file string, n_docs long, n_ids long"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 0, parts: int | None = None) -> dict:
    """Write the files and manifest.json; returns the manifest.

    The driver sees one short row for each file: its names and counts, from which it sums the bases.
    """
    path = tokenizer or tokenizer_path()
    wide = max(encoder(path).vocabulary(), end_id + 1) > 1 << 16
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = parts or max(source.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = _open(folder)
        own = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        keys, nulls, sizes, total = [], [], [], 0
        with store.open_output_stream(f"{own}.ids.tmp") as out:
            for batch, ids, offsets in encoded(slices(batches), path, end_id):
                out.write(np.ascontiguousarray(ids, "<u4" if wide else "<u2").tobytes())
                keys.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                sizes.append(np.diff(offsets))
                total += len(ids)
        n = sum(map(len, keys))
        if not n:
            store.delete_file(f"{own}.ids.tmp")
            return
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        with store.open_output_stream(f"{own}.idx.tmp") as out:
            out.write(np.concatenate([[n], *keys, *nulls, at]).astype("<i8").tobytes())
        for kind in ("ids", "idx"):
            store.move(f"{own}.{kind}.tmp", f"{own}.{kind}")
        name = os.path.basename(own)
        yield pa.record_batch([[part], [f"{name}.ids"], [f"{name}.idx"], [n], [total]], ["part", "ids_file", "index_file", "n_docs", "n_ids"])

    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    files, base = [], 0
    for row in sorted(ordered.mapInArrow(write, _STAT).collect()):
        files.append(row.asDict() | {"base": base})
        base += row.n_ids
    manifest = {"bytes": 4 if wide else 2, "end_id": end_id, "n_ids": base, "files": files}
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _mapped(store: fs.FileSystem, name: str, kind: str) -> np.ndarray:
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_token_files(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit numbers) of every document, and ``ids`` if asked for."""
    store, root = _open(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.readall())
    kind = "<u4" if manifest["bytes"] == 4 else "<u2"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = _mapped(store, f"{root}/{row['index_file']}", "<i8")
                ids = _mapped(store, f"{root}/{row['ids_file']}", kind)
                n = int(index[0])
                keys, nulls, at = index[1 : n + 1], index[n + 1 : 2 * n + 1], np.asarray(index[2 * n + 1 :])
                step = 1000
                for lo in range(0, n, step):
                    hi = min(n, lo + step)
                    own = [np.asarray(ids[at[i] : at[i + 1]], "<u4") for i in range(lo, hi)]
                    columns = [
                        pa.array(np.asarray(keys[lo:hi]), mask=np.asarray(nulls[lo:hi]) == 1), pa.array(row["base"] + at[lo:hi]),
                        pa.array(np.diff(at[lo : hi + 1])), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = [(f["ids_file"], f["index_file"], f["base"]) for f in manifest["files"]]
    listed = spark.createDataFrame(rows, "ids_file string, index_file string, base long").repartition(max(1, len(rows)))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return listed.mapInArrow(read, out)
