"""Keyed tables that streams keep: every batch adds a run of changed rows, the newest row of a key counts.

Runs are merged ``FAN`` at a time into runs of the next level, as digits are carried, so
after n batches a table has fewer than FAN * log(n) runs, and a row is rewritten log(n)
times.  A row with ``_gone`` deletes its key; the mark itself goes when it reaches the
oldest run.

Which runs there are follows from the number of the batch alone.  A batch merges what the
batches before it left (they have all ended by then), reads the table as it was before
itself and adds its run.  Run again after a failure it does the same, whatever of that had
been done; sources of a merge stay until the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4


def _live(n: int) -> Iterator[tuple[int, int]]:
    """(level, upto) of the runs that hold the batches before ``n``, oldest first."""
    level = 0
    while FAN ** (level + 1) <= n:
        level += 1
    at = 0
    for k in range(level, -1, -1):
        while at + FAN**k <= n:
            at += FAN**k
            yield k, at


def ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


class Runs:
    """A table under ``path`` of rows of ``schema`` (DDL) by ``keys``; runs are partitioned by the columns ``by``, which a key does not change.

    ``order`` says which of a key's rows is the newest: the greatest of it, of equal ones
    the later run's; without it the later run's.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], by: tuple[str, ...] = (), order: Column | None = None) -> None:
        self.spark, self.path, self.keys, self.by = spark, path, keys, by
        self.schema, self.order = schema, order if order is not None else F.lit(0)

    def _folder(self, level: int, upto: int) -> str:
        return f"{self.path}/level={level}/upto={upto}"

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _has(self, level: int, upto: int) -> bool:
        fs, path = self._path(f"{self._folder(level, upto)}/_SUCCESS")
        return fs.exists(path)

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        """All rows of ``runs`` with ``_gone`` and ``_run``."""
        out = self.spark.createDataFrame([], f"{self.schema}, _gone boolean, _run long")
        for level, upto in runs:
            if self._has(level, upto):  # else nothing was added
                rows = self.spark.read.schema(f"{self.schema}, _gone boolean").parquet(self._folder(level, upto))
                out = out.unionByName(rows.withColumn("_run", F.lit(upto).cast("long")))
        return out

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in (*self.keys, "_run")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), F.struct(self.order.alias("o"), F.col("_run"))).alias("_row"))
        return last.select(*self.keys, *[F.col(f"_row.{c}") for c in columns])

    def _write(self, rows: DataFrame, level: int, upto: int) -> None:
        out = rows.hint("rebalance", *[F.col(c) for c in self.by])  # files by size, a large partition in several
        out.write.mode("overwrite").partitionBy(*self.by).parquet(self._folder(level, upto))

    def batches(self) -> int:
        """How many batches have added runs: the last one's run is still by itself."""
        fs, path = self._path(f"{self.path}/level=0")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.removeprefix("upto=")) for n in names if n.startswith("upto=")), default=0)

    def rows(self, before: int, where: Column | None = None) -> DataFrame:
        """The table as the batches before ``before`` left it; ``where`` on the columns ``by`` prunes folders."""
        every = self._read(list(_live(before)))
        every = every if where is None else every.filter(where)
        return self._newest(every).filter(~F.col("_gone")).drop("_gone")

    def merge(self, number: int) -> None:
        """What is due before batch ``number``: merged runs, and the removal of what the last merges read."""
        for n, delete in ((number, False), (number - 1, True)):
            level = 1
            while n > 0 and n % FAN**level == 0:
                step = FAN ** (level - 1)
                parts = [(level - 1, n - k * step) for k in reversed(range(FAN))]
                if delete:
                    for part in parts:
                        fs, path = self._path(self._folder(*part))
                        fs.delete(path, True)
                elif not self._has(level, n):
                    rows = self._newest(self._read(parts))
                    self._write(rows if n > FAN**level else rows.filter(~F.col("_gone")), level, n)
                level += 1

    def add(self, changed: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """The run of batch ``number``: ``changed`` rows (a row a key), and rows whose keys are deleted."""
        rows = changed.withColumn("_gone", F.lit(False))
        if gone is not None:
            rows = rows.unionByName(gone.select(*changed.columns).withColumn("_gone", F.lit(True)))
        self._write(rows, 0, number + 1)
