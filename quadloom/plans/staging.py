"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; an error where it names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where.rstrip("/")


class Staging:
    """Writes intermediate results as parquet and reads them back.

    A staged table survives the loss of executors, ends the lineage of an iteration, and gives the next plan real
    sizes. ``drop`` removes tables that no later plan needs, and ``close`` all of them, once nothing reads the results.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        out = df if partitions is None else df.coalesce(partitions)
        out.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._staged_at = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if getattr(t, "_staged_at", None):
                self._delete(t._staged_at)

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Grown:
    """A staged table to which rounds add: every addition is a part of its own, and no row is written twice."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        """``part`` is staged and has the columns of the others."""
        self.parts.append(part)

    def _read(self, parts: list[DataFrame]) -> DataFrame:
        first = self.parts[0]
        return first.sparkSession.read.schema(first.schema).parquet(*[p._staged_at for p in parts])

    @property
    def df(self) -> DataFrame:
        return self.parts[0] if len(self.parts) == 1 else self._read(self.parts)

    @property
    def added(self) -> DataFrame:
        """What was added to the first part."""
        return self._read(self.parts[1:]) if len(self.parts) > 1 else self.parts[0].limit(0)

    def drop(self, staging: Staging) -> None:
        staging.drop(*self.parts)
