"""The corpus pipeline: documents from raw to mixed, one stage after the other.

STAGES lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``:

1. quality classifier   documents go whose words take over ``quality.MARGIN`` off the log odds of the top grade
2. line dedup           later repeated runs of three lines or more are cut; documents that lose all lines go
3. SimHash near-dedup   one document of each component stays (4-word shingles, 4 bits), the one with the smallest id
4. decontamination      documents with a twentieth of their words inside benchmark windows go
5. mixing               documents are drawn by calibrated probabilities, added as ``probability``

In every stage null texts count as empty, texts are read whole whatever their length, empty tables give empty results,
and extra columns of any name pass through (a dot in a name is not supported by Spark's Arrow functions, stage 1).  Rows
that repeat an id and a text stay together until stage 3 keeps one of them; unlike texts under one id, null included,
are separate documents.  Ties: the earlier place of equal runs of lines stays, then the smaller id, null first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, line_dedup, mixing, quality, simhash
from tessera.llm.common import read, stored

SHINGLE_WORDS, LINK_BITS, RUN_LINES = 4, 4, 3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose tail probability of the top grade is not below the cut; without ratings all rows stay, repeated rows alike."""
    model = quality.fit(docs, quality.graded(read(spark, sf_dir, "labels")))
    mark = "_"  # columns of the names that the score adds are set aside under names that no column has
    while any(f"{mark}{c}" in docs.columns for c in quality.ADDED.names):
        mark += "_"
    scored = quality.score(docs.withColumnsRenamed({c: f"{mark}{c}" for c in quality.ADDED.names}), model)
    return scored.where("keep").drop(*quality.ADDED.names).withColumnsRenamed({f"{mark}{c}": c for c in quality.ADDED.names})


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs (``n_chars`` follows); a document that loses all its lines goes, one without lines stays."""
    return line_dedup.without_repeats(docs, min_lines=RUN_LINES)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per component of linked fingerprints: the smallest id, then the smallest text key; texts without words link like any other."""
    return simhash.keep_one(docs, shingle=SHINGLE_WORDS, max_bits=LINK_BITS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated; a benchmark without words leaves all."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows drawn, with their probability; rows that repeat an id share their lot, null dimensions count as empty."""
    return mixing.sample(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_stage),
]

# The quality classifier is fitted, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
