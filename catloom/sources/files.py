"""File listings and archive members."""

from __future__ import annotations

import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catloom.functions import text
from catloom.session import cut_lineage
from catloom.sources.publish import Files

# Output batches of the archive reader are closed at this many bytes of content.
BATCH_BYTES = 32 * 1024 * 1024
_MEMBER_SCHEMA = "archive string, ord bigint, path string, content binary, problem string"


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Non-empty files, also those whose names begin with ``_`` or ``.``: path, size, modified. File contents are not read.

    Spark lists the plain names. It passes over the others, so the driver asks the file system for them by pattern.
    """
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    plain = (
        reader.load(folder)
        .where(F.col("length") > 0)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    hidden = _hidden_files(spark, folder.rstrip("/"), recursive)
    if not hidden:
        return plain
    rows = spark.createDataFrame(hidden, "path string, size bigint, ms bigint")
    return plain.unionByName(rows.select("path", "size", F.timestamp_millis("ms").alias("modified")))


def _hidden_files(spark: SparkSession, folder: str, recursive: bool) -> list[tuple[str, int, int]]:
    """(path, size, time) of non-empty files with a hidden name or below a folder with one."""
    fs, path = Files(spark, folder).fs, spark._jvm.org.apache.hadoop.fs.Path
    found: dict[str, tuple[str, int, int]] = {}
    escaped = re.sub(r"([\\*?\[\]{}])", r"\\\1", folder)

    def add(status) -> None:
        name = status.getPath().toString()
        if status.isFile() and status.getLen() > 0:
            found[name] = (name, status.getLen(), status.getModificationTime())

    level = escaped
    while True:
        for status in fs.globStatus(path(f"{level}/[_.]*")) or []:
            if status.isFile():
                add(status)
            elif recursive:
                below = fs.listFiles(status.getPath(), True)
                while below.hasNext():
                    add(below.next())
        level = f"{level}/*"
        if not recursive or not fs.globStatus(path(f"{level}/*")):
            return sorted(found.values())


def container_files(spark: SparkSession, folder: str, lh_id: str) -> DataFrame:
    """Files directly under a container folder, or all files below it when there are none."""
    top = list_files(spark, folder)
    found = list_files(spark, folder, recursive=True) if top.isEmpty() else top
    root = folder.rstrip("/").split("://")[-1].split(":")[-1]
    inside = F.concat(F.lit(lh_id + "/"), F.substring_index("path", root + "/", -1))
    return found.select(F.lit(lh_id).alias("lh_id"), inside.alias("name"), "size", "modified")


_DIRECTORY = "archive string, ord bigint, path string, packed bigint, size bigint, problem string"
READ_BYTES = 128 * 1024 * 1024  # packed bytes of members a task is meant to read


def _opened(archive: str) -> zipfile.ZipFile:
    """An archive of any size, opened where it lies; only the ranges that are asked for are read."""
    store, name = fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", archive), safe="/:@"))
    return zipfile.ZipFile(store.open_input_file(name))


def archive_directory(spark: SparkSession, paths: str | list[str], members: str = ".*") -> DataFrame:
    """The members of zip archives whose path matches the pattern, from the archives' directories: archive, ord, path, packed and
    unpacked size, problem. No member is read. An archive that cannot be opened gives one row with ``problem``.
    """
    archives = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("archive"))
    pattern = re.compile(members)

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                try:
                    with _opened(archive) as opened:
                        rows = [
                            (archive, i, x.filename, x.compress_size, x.file_size, None)
                            for i, x in enumerate(opened.infolist()) if not x.is_dir() and pattern.search(x.filename)
                        ]
                except (zipfile.BadZipFile, OSError, ValueError) as error:
                    rows = [(archive, None, None, None, None, str(error))]
                if rows:
                    yield _batch(rows, _DIRECTORY)

    return archives.mapInArrow(list_members, _DIRECTORY)


def read_archives(spark: SparkSession, paths: str | list[str], members: str = ".*") -> DataFrame:
    """Members of zip archives whose path matches the pattern: archive, ord, path, content, problem.

    The members are dealt to tasks by their packed size, whatever archive they are in, so one large archive is inflated by many tasks, each
    reading its own ranges. Rows leave in bounded batches. An archive or member that cannot be read gives a row with ``problem`` and
    no content.
    """
    listed = cut_lineage(archive_directory(spark, paths, members))
    bad = listed.where("problem is not null").select("archive", "ord", "path", F.lit(None).cast("binary").alias("content"), "problem")
    good = listed.where("problem is null")
    tasks = max(1, -(-(good.agg(F.sum("packed")).first()[0] or 0) // READ_BYTES), min(good.count(), spark.sparkContext.defaultParallelism))
    # Members of about one task's bytes stand together, in the order of the archive.
    share = Window.partitionBy("archive").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    step = F.floor(F.coalesce(F.sum("packed").over(share), F.lit(0)) / max(1, READ_BYTES // 8))
    dealt = good.select("archive", "ord", step.alias("_step")).repartition(int(tasks), "archive", "_step").sortWithinPartitions("archive", "ord")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, at, opened, infos = 0, None, None, []
        for batch in batches:
            for archive, ord_ in zip(batch.column("archive").to_pylist(), batch.column("ord").to_pylist()):
                if archive != at:
                    if opened is not None:
                        opened.close()
                    at, opened = archive, _opened(archive)
                    infos = opened.infolist()
                rows.append(_member(archive, ord_, opened, infos[ord_]))
                held += len(rows[-1][3] or b"")
                if held >= BATCH_BYTES:
                    yield _batch(rows, _MEMBER_SCHEMA)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _MEMBER_SCHEMA)

    return dealt.mapInArrow(unpack, _MEMBER_SCHEMA).unionByName(bad)


def _member(archive: str, ord_: int, opened: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple:
    try:
        return archive, ord_, info.filename, opened.read(info), None
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, ValueError) as error:
        return archive, ord_, info.filename, None, str(error)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(field.split() for field in schema.split(", ")))
    cols = [pa.array(values, kinds[t]) for values, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(cols, list(names))


def member_texts(members: DataFrame) -> DataFrame:
    """Members as text (UTF-8, bad bytes replaced) with forward-slash paths."""
    return members.where(F.col("problem").isNull()).select(
        "archive", "ord", text.forward_slashes(F.col("path")).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def archive_parts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Definition files of archives as texts: archive, ord, path, content; the ``archive_parts`` of ``governance.ReportInputs``."""
    return member_texts(read_archives(spark, paths, r"\.(json|pbir|tmdl)$"))


def archive_layouts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Single-file layouts in archives, in whatever encoding: report_id (the archive), layout; the ``layouts`` of ``ReportInputs``."""
    found = read_archives(spark, paths, r"(^|/)Layout$").where("problem is null")
    return found.select(F.col("archive").alias("report_id"), json_in_some_encoding("content").alias("layout"))


@F.arrow_udf(T.StringType())
def json_in_some_encoding(bodies: pa.Array) -> pa.Array:
    """Bytes as the first decoding that is JSON: UTF-16-LE, UTF-8 with or without a byte order mark; else null."""

    def decode(body: bytes | None) -> str | None:
        for encoding in ("utf-16-le", "utf-8-sig", "utf-8"):
            try:
                out = (body or b"").decode(encoding)
                json.loads(out)
                return out
            except ValueError:
                continue
        return None

    return pa.array([decode(b.as_py()) for b in bodies], pa.string())


def archive_problems(members: DataFrame) -> DataFrame:
    return members.where(F.col("problem").isNotNull()).select("archive", "path", "problem")
