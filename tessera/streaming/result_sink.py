"""Restartable result sink for a stream of result rows (S6 / G3 in micro-batch form).

The reference appends results and skips finished keys on restart.  Here a stream of result rows (``readStream`` over the
folder where runs drop their rows) is written with ``foreachBatch`` as committed parts (``sources.commits``) partitioned
by fold:

* a part is named by the stream's own id, which its checkpoint keeps, and the batch id; a micro-batch that is replayed
  after a failure is found committed and adds nothing;
* without recompute, a batch adds only keys that are not stored yet (null-safe anti join);
* with recompute, all rows are added and readers keep the row that was committed last (``read_results``).  The order is
  that of the commits, not of batch ids, which start again with a new checkpoint.

Within one batch the last row of a key stays (G4): by ``order_col`` if given, else by the time and name of the dropped
file and the place in it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.joins import null_safe_on
from tessera.operators.results import dedupe_batch
from tessera.sources.commits import CommitLog
from tessera.sources.results_io import KEY, REQUIRED

RESULT = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("fold", T.IntegerType()),
    T.StructField("space", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("n_selected", T.IntegerType()), T.StructField("seed", T.IntegerType()),
    T.StructField("evaluator", T.StringType()), T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType())])
FILE_ORDER = ["_file_time", "_file"]


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows with ``seq``, the order of their commits."""
    rows = CommitLog(spark, path).read("rows", RESULT)
    return spark.createDataFrame([], T.StructType(RESULT.fields + [T.StructField("seq", T.LongType())])) if rows is None else rows


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, one row per key: the one committed last."""
    return dedupe_batch(_committed(spark, path).select(*REQUIRED, "seq"), "seq", KEY).select(*REQUIRED)


def upsert_batch(batch: DataFrame, batch_id: int, path: str, recompute: bool = False,
                 order_col: str | None = None, source: str = "batch"):
    """One micro-batch of the stream ``source``; the same (source, batch_id) again changes nothing."""
    spark = batch.sparkSession
    log, part = CommitLog(spark, path), f"p-{hashlib.md5(source.encode()).hexdigest()}-{int(batch_id)}"
    if log.committed(part):
        return
    order = [order_col] if order_col else [c for c in FILE_ORDER if c in batch.columns]
    b = batch.withColumn("_place", F.monotonically_increasing_id())
    b = dedupe_batch(b.select(*REQUIRED, F.struct(*order, "_place").alias("_order")), "_order", KEY).select(*REQUIRED)
    if not recompute:
        # only the stored folds that the batch touches
        folds = [r.fold for r in b.select("fold").distinct().collect()]
        stored = _committed(spark, path)
        have = stored.filter(F.col("fold").isin(*[f for f in folds if f is not None]) | F.col("fold").isNull()).select(*KEY).distinct()
        b = b.join(have, null_safe_on(b, have, KEY), "left_anti")
    log.stage("rows", part, b, ["fold"])
    log.commit(part)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream: a new checkpoint, even in the same folder, has a new one."""
    rows = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()
    return json.loads(rows[0])["id"]


def start_result_sink(stream: DataFrame, path: str, checkpoint: str, recompute: bool = False,
                      order_col: str | None = None, available_now: bool = True):
    """Start the streaming sink; ``checkpoint`` must be shared storage on a cluster."""
    def write(df, i):
        upsert_batch(df, i, path, recompute, order_col, _stream_id(df.sparkSession, checkpoint))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def result_stream(spark: SparkSession, folder: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A stream over the folder where runs drop result files (explicit schema, as streaming needs), with the time and name
    of each row's file."""
    r = spark.readStream.schema(schema or RESULT)
    rows = r.parquet(folder) if fmt == "parquet" else r.option("header", True).csv(folder)
    return rows.withColumns({"_file_time": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_path")})
