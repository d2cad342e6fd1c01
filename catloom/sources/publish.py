"""Tables that change together: versioned folders and a manifest that is switched last.

Every publish writes its tables to a folder of its own and then creates the manifest of the next version, a small file that must
not exist yet. Readers follow the newest manifest, so they see all tables of one version or all of the one before, also when a
writer dies between two tables. A writer names the version it built on; if another one published meanwhile, its manifest
name is taken and it gets a ``Conflict``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another version was published since the one that was read."""


@dataclass(frozen=True)
class Manifest:
    """``tables``: name -> {"path": folder, "schema": JSON of its StructType}."""

    version: int
    tables: dict[str, dict]
    fingerprint: str | None = None
    note: dict = field(default_factory=dict)


class Files:
    """The few calls on the file system of a folder that the driver needs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(self.conf)
        self.jvm, self.gateway = jvm, spark.sparkContext._gateway

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        opened = self.fs.open(self.path(path))
        try:
            return bytes(opened.readAllBytes()).decode()
        finally:
            opened.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not exist; whole or not at all. False if it exists."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        out = self.fs.create(self.path(draft), True)
        out.write(text.encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        plain[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(self.path(draft)), context.makeQualified(self.path(path)), plain)
            return True
        except Exception as error:
            self.delete(draft)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class TableSet:
    """Named tables under ``root`` that are replaced together."""

    def __init__(self, spark: SparkSession, root: str, partitions: dict[str, list[str]] | None = None) -> None:
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions or {}
        self.files = Files(spark, self.root)

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, by default the newest; None before the first publish."""
        known = self.versions()
        if not known:
            return None
        return Manifest(**json.loads(self.files.read(self._manifest_path(known[-1] if version is None else version))))

    def publish(
        self, tables: dict[str, DataFrame], base: Manifest | None, fingerprint: str | None = None, note: dict | None = None
    ) -> Manifest:
        """Write the tables and switch to them; tables of ``base`` that are not given stay as they are. Raises Conflict."""
        version, folder = (base.version if base else 0) + 1, f"{self.root}/data/{uuid.uuid4().hex}"
        entries = dict(base.tables) if base else {}
        try:
            for name, df in tables.items():
                self._write(df, name, f"{folder}/{name}")
                entries[name] = {"path": f"{folder}/{name}", "schema": df.schema.json()}
            made = Manifest(version, entries, fingerprint, note or {})
            switched = self.files.create(self._manifest_path(version), json.dumps(vars(made), ensure_ascii=False))
        except BaseException:
            self.files.delete(folder)
            raise
        if not switched:
            self.files.delete(folder)
            raise Conflict(f"version {version} of {self.root} was published by another writer")
        return made

    def _write(self, df: DataFrame, name: str, path: str) -> None:
        keys = self.partitions.get(name, [])
        if keys:  # rows go to partitions as they are; adaptive execution sizes the files per partition value
            df.hint("rebalance", *keys).write.partitionBy(*keys).parquet(path)
        else:
            df.write.parquet(path)

    def read(self, manifest: Manifest | None = None) -> dict[str, DataFrame]:
        """The tables of one version, by default the newest."""
        found = manifest or self.manifest()
        if found is None:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        out = {}
        for name, entry in found.tables.items():
            schema = T.StructType.fromJson(json.loads(entry["schema"]))
            out[name] = self.spark.read.schema(schema).parquet(entry["path"]).select(*[F.col(f"`{c}`") for c in schema.names])
        return out

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the newest ``keep`` manifests and the folders none of those names; the deleted folders.

        Folders of a publish that is under way have no manifest yet: run it when no writer is at work.
        """
        known = self.versions()
        held = {"/".join(e["path"].split("/")[-3:-1]) for v in known[-keep:] for e in self.manifest(v).tables.values()}
        gone = [n for n in self.files.names(f"{self.root}/data") if f"data/{n}" not in held]
        for version in known[:-keep]:
            self.files.delete(self._manifest_path(version))
        for name in gone:
            self.files.delete(f"{self.root}/data/{name}")
        return gone


# Fingerprints -------------------------------------------------------------


def row_fingerprint(*frames: DataFrame) -> str:
    """A text that changes with the rows (not their order), columns or types of the frames; one aggregate each."""
    parts = []
    for df in frames:
        row = F.xxhash64(F.to_json(F.struct("*"))) if df.columns else F.lit(0).cast("long")
        found = df.agg(
            F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)")), F.sum(F.shiftrightunsigned(row, 7).cast("decimal(38,0)"))
        ).first()
        parts.append(f"{df.schema.simpleString()}|{'|'.join(map(str, found))}")
    return "\n".join(parts)


def file_fingerprint(spark: SparkSession, *paths: str) -> str:
    """A text that changes with the names, sizes or times of the files below the paths; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return row_fingerprint(listed.select("path", "length", F.col("modificationTime").cast("string")))
