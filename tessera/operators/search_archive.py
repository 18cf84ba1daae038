"""Append-only archive of the candidates of a subset search.

A candidate never changes: what shrinking, mutation or local search makes of it is a new candidate with an id of its
own.  Every batch of new candidates is written once, to ``<path>/members/batch=<n>``, and the batch number is part of
the id, so reading some candidates prunes the other batches.  A curve point therefore keeps the very rows it was scored
on, and the archive takes the place of checkpoints: a population is read back, not recomputed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

MEMBER = "candidate_id long, row_id long"
BATCH_BITS = 20  # candidates of a batch: at most 2 ** 20


def batch_of(candidate_id: int) -> int:
    return candidate_id >> BATCH_BITS


class CandidateArchive:
    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` must be a new folder on shared storage; without one, a folder under the checkpoint directory."""
        self.spark = spark
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
        self.batches = 0

    def add(self, members: DataFrame, numbers: dict[int, int] | None = None) -> dict[int, int]:
        """Store (candidate_id, row_id) as a new batch.  ``numbers`` maps the candidates, a bounded population, to 0, 1, ...;
        without it ``candidate_id`` is such a number already and the result is empty.  Returns old id -> archive id."""
        base = self.batches << BATCH_BITS
        if numbers is not None:
            if len(numbers) >> BATCH_BITS:
                raise ValueError(f"{len(numbers)} candidates in a batch")
            ids = self.spark.createDataFrame([(int(c), base + k) for c, k in numbers.items()], "candidate_id long, new_id long")
            members = members.join(F.broadcast(ids), "candidate_id").select(F.col("new_id").alias("candidate_id"), "row_id")
        else:
            members = members.select((F.col("candidate_id") + F.lit(base)).cast("long").alias("candidate_id"), "row_id")
        # an overwrite: a batch that was cut off before it was numbered leaves nothing behind
        members.select(F.col("candidate_id").cast("long").alias("candidate_id"), F.col("row_id").cast("long").alias("row_id")).write.mode(
            "overwrite").parquet(f"{self.path}/members/batch={self.batches}")
        self.batches += 1
        return {c: base + k for c, k in (numbers or {}).items()}

    def members(self, candidate_ids=None) -> DataFrame:
        """(candidate_id, row_id) of the given candidates, or of all."""
        if not self.batches:
            return self.spark.createDataFrame([], MEMBER)
        rows = self.spark.read.schema(f"{MEMBER}, batch int").parquet(f"{self.path}/members")
        if candidate_ids is not None:
            ids = sorted({int(c) for c in candidate_ids})
            rows = rows.where(F.col("batch").isin(sorted({batch_of(c) for c in ids}))).where(F.col("candidate_id").isin(ids))
        return rows.select("candidate_id", "row_id")
