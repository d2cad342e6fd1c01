"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for; AQE splits skewed join sides and sizes partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "catloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder spark.checkpoint.dir names; only a local session may fall back to its own folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="catloom-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_work: ContextVar[str | None] = ContextVar("catloom_work", default=None)


@contextmanager
def work_folder(folder: str) -> Iterator[None]:
    """Let ``cut_lineage`` write below ``folder``, whose owner removes it."""
    token = _work.set(folder)
    try:
        yield
    finally:
        _work.reset(token)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each action inside as soon as it has ended, not when the driver next collects garbage.

    For actions whose frame is not run again: one that is would have to make its shuffles anew.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from the files.

    The steps before run once however often the result is used, a lost executor costs only its own tasks, and
    the planner sees true sizes and prunes columns. The shuffles behind the rows are deleted once these are written.
    """
    spark = df.sparkSession
    path = f"{_work.get() or checkpoint_folder(spark)}/cut-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _paths[kept] = path
    return kept


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # folder of each frame that cut_lineage returned


def release(kept: DataFrame) -> None:
    """Delete a frame that ``cut_lineage`` returned, when only frames that are written already were made from it."""
    spark = kept.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(kept))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Spread a scan of a few files by the columns ``by`` (all, if not given) before costly row-by-row work.

    The parts are as many as the session shuffles into, and no fewer than cores. A table with at least as many files as cores is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    parts = max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *(by or df.columns))
