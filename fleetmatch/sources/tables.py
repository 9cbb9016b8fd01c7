"""Reading the star-schema tables, and intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import io
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


class _Made(threading.local):
    """Folders of intermediate tables that this thread wrote and has not removed yet, oldest first."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()
_shipped: set[str] = set()  # applications that have the package


def _one_machine(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset a session on one machine (tests) gets a temporary folder; on a
    cluster that is an error, as executors would not see the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not _one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage like ``checkpoint()``: a lost executor costs no recomputation,
    and later readers scan only the columns they need.
    """
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    _made.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never collected on the driver to be broadcast.

    For tables with a row an order or a pair of cells: a ``written`` one is taken to be as
    large as its files, and in memory it is tens of times that.
    """
    return df.hint("merge")


class Scope:
    """The tables that a ``temporary`` block leaves behind."""

    def __init__(self) -> None:
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written, as a table that outlives the block and belongs to what is around it."""
        out = written(df)
        self.kept.add(_made.paths[-1])
        return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Scope]:
    """Owns what is ``written`` in the block (by this thread): it is deleted at the end, but for what the scope keeps."""
    began, scope = len(_made.paths), Scope()
    try:
        yield scope
    finally:
        mine = _made.paths[began:]
        _made.paths[began:] = [p for p in mine if p in scope.kept]
        _delete(spark, [p for p in mine if p not in scope.kept])


def mark() -> int:
    """A point in time for ``release``."""
    return len(_made.paths)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables this thread has ``written`` since ``mark()``, but for the last ``keep``; nothing may need them any more.

    The driver's JVM is asked to collect garbage, so that Spark's cleaner also removes the
    shuffle files of the jobs that made them.
    """
    gone = _made.paths[since : len(_made.paths) - keep]
    del _made.paths[since : len(_made.paths) - keep]
    _delete(spark, gone)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package: by path on one machine, else as an archive in the shared folder."""
    sc = spark.sparkContext
    if _one_machine(spark):
        sc.environment.setdefault("PYTHONPATH", str(PACKAGE.parent))
    elif sc.applicationId not in _shipped:
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for file in sorted(PACKAGE.rglob("*.py")):
                archive.write(file, file.relative_to(PACKAGE.parent))
        path = f"{scratch(spark, PACKAGE.name)}.zip"
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
