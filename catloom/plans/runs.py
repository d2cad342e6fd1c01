"""Whole runs that can be resumed: a journal of finished stages in one folder, and a publish at the end.

A stage's frames are written once and marked as done. A run of the same name that starts again reads what is marked and goes on with the
first stage that is not. The run's result is published as one version (``publish.TableSet``); then its folder is removed,
with the intermediate tables the stages wrote on the way.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catloom.plans.collect import Collection, WorkspaceInputs, collect_workspace
from catloom.session import work_folder
from catloom.sources.publish import Files, Manifest, TableSet


class Journal:
    """Frames of finished stages below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)

    def stage(self, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The frames of a stage; ``make`` is called only if no earlier run finished it."""
        mark = f"{self.folder}/{name}.done"
        if f"{name}.done" not in self.files.names(self.folder):
            self.files.delete(f"{self.folder}/{name}")
            frames = make()
            for part, df in frames.items():
                df.write.parquet(f"{self.folder}/{name}/{part}")
            self.files.create(mark, "\n".join(frames))
        return {part: self.spark.read.parquet(f"{self.folder}/{name}/{part}") for part in self.files.read(mark).split("\n") if part}


def resumable(spark: SparkSession, root: str, run: str, compute: Callable[[Journal], dict[str, DataFrame]]) -> Manifest:
    """Publish the frames of ``compute`` below ``root``. A run that was published already is not computed again."""
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run's name becomes a folder: {run!r}")
    tables, folder = TableSet(spark, root), f"{root.rstrip('/')}/work/{run}"
    made = tables.manifest()
    if made is None or made.note.get("run") != run:
        with work_folder(f"{folder}/tables"):
            made = tables.publish(compute(Journal(spark, folder)), made, note={"run": run})
    tables.files.delete(folder)
    return made


def run_workspace(spark: SparkSession, root: str, run: str, inputs: WorkspaceInputs, **options) -> Collection:
    """``collect_workspace`` as a resumable run; the collection as it was published."""
    made = resumable(spark, root, run, lambda journal: collect_workspace(inputs, stage=journal.stage, **options).frames())
    return Collection.of_frames(TableSet(spark, root).read(made))
