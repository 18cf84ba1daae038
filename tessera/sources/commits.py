"""A parquet table made of committed parts, ordered by time of commit.

Rows are written to ``<path>/<kind>/part=<token>`` first; a small numbered file in ``<path>/commits`` then makes the part
visible.  A number is taken by creating its file, which fails if it exists, so parts are ordered by when they were
committed, whatever wrote them.  A writer that dies before its commit leaves rows nobody reads, and writing the same
token again replaces them; a token that is committed is never written twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMIT = T.StructType([T.StructField("part", T.StringType()), T.StructField("seq", T.LongType())])


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, kind: str) -> bool:
        fs, p = self._fs(f"{self.path}/{kind}")
        return fs.exists(p)

    def commits(self) -> DataFrame:
        """(part, seq): one row per committed part, so as many as there were batches."""
        if not self.exists("commits"):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.path}/commits").where("part is not null")

    def committed(self, part: str) -> bool:
        return not self.commits().where(f"part = '{part}'").isEmpty()

    def stage(self, kind: str, part: str, rows: DataFrame, partition_by=()) -> None:
        w = rows.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.path}/{kind}/part={part}")

    def commit(self, part: str) -> int:
        """Make the staged rows of ``part`` visible, after everything that was committed before."""
        fs, folder = self._fs(f"{self.path}/commits")
        fs.mkdirs(folder)
        number = max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName()[0].isdigit()), default=0)
        while True:
            number += 1
            try:
                out = fs.create(self._fs(f"{self.path}/commits/{number:012d}.json")[1], False)
            except Exception as e:  # noqa: BLE001 - only a number that another writer took is tried again
                if "FileAlreadyExists" not in str(getattr(e, "java_exception", "")):
                    raise
                continue
            out.write((json.dumps({"part": part, "seq": number}) + "\n").encode())
            out.close()
            return number

    def read(self, kind: str, schema: T.StructType | None = None) -> DataFrame | None:
        """The rows of the committed parts with ``part`` and ``seq``; None if nothing was written.  ``schema`` is that of the
        files' rows and their partition columns."""
        if not self.exists(kind):
            return None
        r = self.spark.read
        if schema is not None:
            r = r.schema(T.StructType(schema.fields + [T.StructField("part", T.StringType())]))
        return r.parquet(f"{self.path}/{kind}").join(self.commits(), "part")
