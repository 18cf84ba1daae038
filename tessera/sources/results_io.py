"""Result-file sources and keyed sinks (S1-S4, S6, S10) and read-through stores of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.joins import fresh, null_safe_on
from tessera.session import cut_lineage
from tessera.sources.commits import CommitLog

# Column names of the stored result layouts, and the long fact names they become.
LONG_NAMES = {"instance_selection_space": "space", "instance_selection_algorithm": "method",
              "n_selected_samples": "n_selected", "random_state": "seed"}
REQUIRED = ["dataset", "fold", "space", "method", "n_selected", "seed", "evaluator", "metric", "value"]
KEY = [c for c in REQUIRED if c != "value"]
FOLD_IN_NAME = r"_f(\d+)\.csv$"


NAMES_OF = {c: [c] for c in REQUIRED} | {"value": ["value", "AUC"], "evaluator": ["evaluator", "evaluation_method"]}
for _stored, _name in LONG_NAMES.items():
    NAMES_OF[_name] = NAMES_OF[_name] + [_stored]
CSV_FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def _fields(line: Column) -> Column:
    """The fields of a CSV line as an array; quotes are taken off, empty fields are NULL."""
    def plain(x):
        inner = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return F.nullif(F.when(F.startswith(x, F.lit('"')), inner).otherwise(x), F.lit(""))
    return F.transform(F.regexp_extract_all(line, F.lit(CSV_FIELD), F.lit(1)), plain)


def _names_any(line: Column, names: list[str]) -> Column:
    return line.rlike('(^|,)"?(' + "|".join(names) + ')"?(,|$)')


def scan_result_files(spark: SparkSession, path_glob: str, folds=None) -> DataFrame:
    """Every result CSV under a glob in one scan, whatever its column layout: the required columns and ``source_file``.

    Lines meet the header of their file, one row per file, on the executors.  S1: the fold comes from ``..._f<k>.csv`` if
    the file has no such column; only the configured folds stay.  S2: unparsable numbers and the text NaN become NULL; a
    file without a required column is an error when the query runs.  S3: the old layout (evaluation_method, AUC) becomes
    evaluator, metric 'AUC' and value; an absent seed is NULL.  Fields may be quoted; a line break inside a field is not
    supported."""
    lines = spark.read.text(path_glob).where("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"),
        (F.col("_metadata.file_block_start") == 0).alias("first_block"), F.rtrim("value").alias("line"))
    if lines.isEmpty():
        raise FileNotFoundError(path_glob)
    # the header: the line with the column names, at the start of the file
    is_header = F.col("first_block") & _names_any(F.col("line"), ["dataset"]) & _names_any(F.col("line"), NAMES_OF["value"]) & \
        _names_any(F.col("line"), NAMES_OF["n_selected"])
    headers = lines.where(is_header).groupBy("path").agg(F.first("line").alias("header")).select("path", _fields(F.col("header")).alias("h"))
    place = lambda *names: F.coalesce(*[F.nullif(F.array_position("h", n), F.lit(0).cast("long")) for n in names]).cast("int")
    headers = headers.select("path", *[place(*names).alias(f"at_{c}") for c, names in NAMES_OF.items()],
                             (place("value").isNull() & place("AUC").isNotNull()).alias("old"))
    rows = lines.where(~is_header).join(headers, "path", "left").withColumn("f", _fields(F.col("line")))
    absent = F.when(F.col("old").isNull(), F.lit("a header"))
    for c in REQUIRED:
        if c not in ("fold", "seed"):
            absent = absent.when(F.col(f"at_{c}").isNull() & (F.lit(c != "metric") | ~F.col("old")), F.lit(f"column {c}"))
    text = {c: F.element_at("f", F.col(f"at_{c}")) for c in REQUIRED}
    text["fold"] = F.when(F.col("at_fold").isNull(), F.nullif(F.regexp_extract("source_file", FOLD_IN_NAME, 1), F.lit(""))).otherwise(text["fold"])
    text["metric"] = F.when(F.col("old") & F.col("at_metric").isNull(), F.lit("AUC")).otherwise(text["metric"])
    text["value"] = F.when(absent.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("result file"), F.col("path"), F.lit("lacks"), absent)).cast("string")).otherwise(text["value"])
    out = check_and_cast(rows.select(*[text[c].alias(c) for c in REQUIRED], "source_file")).select(*REQUIRED, "source_file")
    return out.filter(F.col("fold").isin(*folds)) if folds is not None else out


def upgrade_old_layout(df: DataFrame) -> DataFrame:
    """S3: old layout (evaluation_method, AUC) -> evaluator, metric='AUC', value; absent seed -> NULL;
    reference column names -> long fact names."""
    if "evaluation_method" in df.columns:
        df = df.withColumnRenamed("evaluation_method", "evaluator")
    if "value" not in df.columns and "AUC" in df.columns:
        df = df.withColumnRenamed("AUC", "value").withColumn("metric", F.lit("AUC"))
    df = df.withColumnsRenamed({k: v for k, v in LONG_NAMES.items() if k in df.columns})
    if "seed" not in df.columns:
        df = df.withColumn("seed", F.lit(None).cast("int"))
    return df


def check_and_cast(df: DataFrame) -> DataFrame:
    """Required columns or an error; unparsable numbers and the text NaN become NULL; fold/int columns typed."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"result table misses columns {missing}")
    return (df.withColumn("fold", F.col("fold").try_cast("int"))
            .withColumn("n_selected", F.col("n_selected").try_cast("int"))
            .withColumn("seed", F.col("seed").try_cast("int"))
            .withColumn("value", F.nanvl(F.col("value").try_cast("double"), F.lit(None).cast("double"))))


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Dataset catalog scan."""
    r = spark.read
    return r.parquet(path) if fmt == "parquet" else r.option("header", True).option("inferSchema", True).csv(path)


def merge_results(existing: DataFrame, batch: DataFrame, recompute: bool = False) -> DataFrame:
    """Keyed append.  Without recompute, stored rows win and only new keys are added; with
    recompute, stored rows with a key in the batch are replaced.  Keys compare null-safe.  A batch that holds a key
    twice is an error when the query runs (G4 check); reduce it with ``dedupe_batch`` before."""
    b = _checked_keys(batch.select(*REQUIRED))
    e = existing.select(*REQUIRED)
    if recompute:
        kb = b.select(*KEY).distinct()
        return e.join(kb, null_safe_on(e, kb, KEY), "left_anti").unionByName(b)
    kb = e.select(*KEY).distinct()
    new = b.join(kb, null_safe_on(b, kb, KEY), "left_anti")
    return e.unionByName(new)


def _checked_keys(batch: DataFrame) -> DataFrame:
    """``batch`` itself; raises when it runs if a key occurs more than once (an aggregate, so a hot key is combined map-side)."""
    one = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.first("value").alias("value"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(" ", F.lit("duplicate key in batch:"), *[
        F.col(c).cast("string") for c in KEY])).cast("double")).otherwise(F.col("value"))
    return one.withColumn("value", checked).select(*REQUIRED)


def write_results(df: DataFrame, path: str):
    """S6 sink: parquet partitioned by fold; only the folds present in ``df`` are replaced
    (dynamic partition overwrite), so concurrent folds do not clobber each other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def write_wide(df: DataFrame, path: str, fmt: str = "csv"):
    """Wide aggregate sink (one file set per section)."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def read_wide(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S10 reader."""
    r = spark.read
    return r.option("header", True).option("inferSchema", True).csv(path) if fmt == "csv" else r.parquet(path)


class RunStore:
    """Rows of runs with read-through.  A run is stored and replaced as a whole.

    Every write is a generation (a committed part, see ``sources.commits``) with an index of the runs it holds; the newest
    generation of a run counts.  ``wanted`` tables have the run key; with ``n_rows`` a stored run fits only if it has that
    many rows, and the columns named in ``match`` must be the same.  A run that does not fit, because it was stored for
    another pool or only in part, is computed again and replaced once.  Keys compare null-safe.
    """

    def __init__(self, spark: SparkSession, path: str, run_key: list[str], match: tuple = ()):
        self.spark, self.run_key, self.match = spark, list(run_key), list(match)
        self.log = CommitLog(spark, path)

    def runs(self) -> DataFrame | None:
        """One row per stored run: key, ``match`` columns, n_rows, and the part and seq of its newest generation."""
        index = self.log.read("runs")
        if index is None:
            return None
        others = [c for c in index.columns if c not in self.run_key]
        newest = index.groupBy(*self.run_key).agg(F.max_by(F.struct(*others), "seq").alias("_r"))
        return newest.select(*self.run_key, *[F.col(f"_r.{c}").alias(c) for c in others])

    def read(self) -> DataFrame | None:
        """The rows of every run's newest generation; None if nothing is stored."""
        rows, runs = self.log.read("rows"), self.runs()
        if rows is None or runs is None:
            return None
        on = ["part", *self.run_key]
        return rows.join(runs, null_safe_on(rows, runs, on), "left_semi").drop("part", "seq")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The wanted runs that are not stored, or do not fit."""
        extra = [c for c in (*self.match, "n_rows") if c in wanted.columns]
        w, runs = fresh(wanted, [*self.run_key, *extra]).distinct(), self.runs()
        if runs is None:
            return w
        return w.join(runs, null_safe_on(w, runs, [*self.run_key, *extra]), "left_anti")

    def replace(self, wanted: DataFrame, rows: DataFrame) -> None:
        """Store ``rows`` as the new generation of the ``wanted`` runs; runs without rows are stored as empty."""
        part = f"p-{uuid.uuid4().hex}"
        match = [c for c in self.match if c in wanted.columns]
        keys = fresh(wanted, [*self.run_key, *match]).distinct()
        own = rows.join(keys, null_safe_on(rows, keys, self.run_key), "left_semi")
        self.log.stage("rows", part, own)
        stored = self.spark.read.schema(own.schema).parquet(f"{self.log.path}/rows/part={part}")
        counts = stored.groupBy(*self.run_key).agg(F.count(F.lit(1)).alias("n_rows"))
        index = keys.join(counts, null_safe_on(keys, counts, self.run_key), "left").select(
            *[keys[c] for c in (*self.run_key, *match)], F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
        self.log.stage("runs", part, index)
        self.log.commit(part)

    def get_or_compute(self, wanted: DataFrame, compute) -> DataFrame:
        """The stored rows of the wanted runs; ``compute(missing runs)`` is called for those that do not fit, if any."""
        todo = cut_lineage(self.missing(wanted))
        if not todo.isEmpty():
            self.replace(todo, compute(todo))
        have, w = self.read(), fresh(wanted, self.run_key).distinct()
        return have.join(w, null_safe_on(have, w, self.run_key), "left_semi")


class SelectionStore(RunStore):
    """Stored selections (one row per selected row), reused only if they fit: the stored run was made for a pool of
    ``pool_size`` rows and has as many rows as its budget asks for (all rows, if the pool is smaller)."""

    KEY = ["dataset", "fold", "space", "method", "n_selected", "seed"]

    def __init__(self, spark: SparkSession, path: str, pool_size: int):
        super().__init__(spark, path, self.KEY, ("pool_size",))
        self.pool_size = pool_size

    def missing(self, wanted: DataFrame) -> DataFrame:
        size = F.lit(self.pool_size).cast("long")
        return super().missing(wanted.select(*self.KEY, size.alias("pool_size"), F.least(F.col("n_selected").cast("long"), size).alias("n_rows")))


def flatten_selections(nested: DataFrame) -> DataFrame:
    """The nested form (run key, pool_size, selected array<long>) as one row per selected row, in its order."""
    return nested.select(*SelectionStore.KEY, "pool_size", F.posexplode("selected").alias("pos", "row_id"))


def prediction_store(spark: SparkSession, path: str) -> RunStore:
    """Stored probabilities per run, one row per (test row, class)."""
    return RunStore(spark, path, ["dataset", "fold", "space", "method", "n_selected", "seed", "evaluator"])


def embedding_store(spark: SparkSession, path: str) -> RunStore:
    """Stored embeddings per dataset, fold, split and encoder."""
    return RunStore(spark, path, ["dataset", "fold", "split", "encoder"])


def score_store(spark: SparkSession, path: str) -> RunStore:
    """Stored row scores (coverage scores) per dataset, fold and space."""
    return RunStore(spark, path, ["dataset", "fold", "space"])


# Fields of a stored candidate.
CURVE_STRUCT = T.StructType([
    T.StructField("n_genes", T.IntegerType()), T.StructField("initial_selection_size", T.IntegerType()),
    T.StructField("genes", T.ArrayType(T.IntegerType())), T.StructField("fitness", T.DoubleType()),
    T.StructField("val_auc", T.DoubleType()), T.StructField("val_acc", T.DoubleType()),
    T.StructField("test_auc", T.DoubleType()), T.StructField("test_acc", T.DoubleType()),
    T.StructField("reduction", T.DoubleType()), T.StructField("log_reduction", T.DoubleType()),
    T.StructField("linear_reduction", T.DoubleType()), T.StructField("alpha", T.DoubleType()),
    T.StructField("ir", T.DoubleType()), T.StructField("n_classes", T.IntegerType()),
    T.StructField("max_selection_size", T.IntegerType())])
CURVE_NAME = r"^(.*)_fold(\d+)_best_chromosomes_curve\.json$"


def scan_curves(spark: SparkSession, path_glob: str) -> DataFrame:
    """Candidate-curve JSON files (one map size -> candidate per file) -> one row per candidate;
    numeric-looking keys become ints; dataset and fold come from the file name."""
    raw = spark.read.text(path_glob, wholetext=True)
    # the metadata column has the name as part of a URL
    raw = raw.withColumn("file", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))))
    m = F.from_json("value", T.MapType(T.StringType(), CURVE_STRUCT))
    return (raw.select("file", F.explode(m).alias("size", "c"))
            .select(F.regexp_extract("file", CURVE_NAME, 1).alias("dataset"),
                    F.regexp_extract("file", CURVE_NAME, 2).cast("int").alias("fold"),
                    F.col("size").try_cast("int").alias("size"), "c.*"))


def write_curves(curves: DataFrame, folder: str):
    """One ``<dataset>_fold<k>_best_chromosomes_curve.json`` per (dataset, fold) of (dataset, fold, json).  The executors
    write the files, one folder each; the driver only moves them to their names."""
    spark = curves.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    base = path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"
    name = F.concat(F.col("dataset"), F.lit("_fold"), F.col("fold").cast("string"), F.lit("_best_chromosomes_curve.json"))
    # one row per curve, so a curve is one file; the folder's name is safe in any file system
    curves.select(F.hex(name).alias("curve"), F.col("json").alias("value")).write.partitionBy("curve").text(parts)
    for st in fs.listStatus(path(parts)):
        curve = st.getPath().getName()
        if curve.startswith("curve="):
            target = path(base, bytes.fromhex(curve.removeprefix("curve=")).decode())
            for f in fs.listStatus(st.getPath()):
                if f.getPath().getName().startswith("part-") and not fs.rename(f.getPath(), target):
                    raise OSError(f"cannot write {target.toString()}")
    fs.delete(path(parts), True)


def curve_json(entries: DataFrame) -> DataFrame:
    """(dataset, fold, json): the curve map of each fold from one row per candidate (dataset, fold, size and the fields of
    ``CURVE_STRUCT``)."""
    fields = [f.name for f in CURVE_STRUCT.fields if f.name in entries.columns]
    pair = F.struct(F.col("size").cast("string").alias("key"), F.struct(*fields).alias("value"))
    return entries.groupBy("dataset", "fold").agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("json"))
