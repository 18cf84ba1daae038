"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words is shared by all grades; ordered thresholds cut the latent score s(x):
P(grade >= k | x) = sigmoid(s(x) - threshold_k).  The model gives the expected grade and the tail probability of
the top grade, by which documents are selected.

The model is fitted on a sample of at most ``max_ratings`` ratings (taken by a seeded hash of the id; their distinct
word buckets, not their texts, reach the driver).  Scoring reads every document once, whole, and needs no shuffle;
the weights have a fixed size (``2 ** bits`` floats).
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import alnum_split, small_batches, text_or_empty

MAX_RATINGS = 20_000
BITS = 20
MARGIN = 1.5  # log odds that a document's tokens may take off the top grade before the document is rejected
MIN_DOCS = 20  # sampled documents in which a bucket must occur to get a weight
MIN_Z = 4.0  # standard errors by which a bucket's mean grade must differ from the overall mean to get a weight
MIN_LIFT = 0.25  # and by which part of a grade: common words that drift with length say little about a document
STEPS, RATE, RIDGE = 200, 0.1, 1e-4
# Everything but signs becomes a blank: the runs of signs are tokens too ("%%%", "|").
SIGNS = bytes(c if 33 <= c < 127 and not chr(c).isalnum() else 32 for c in range(256))
ADDED = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType()),
                      T.StructField("keep", T.BooleanType())])


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, one per bucket
    thresholds: np.ndarray  # ascending, one per grade but the lowest; empty without ratings
    bits: int = BITS

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. in columns."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def buckets(text: bytes, bits: int) -> np.ndarray:
    """Distinct buckets of the text's tokens, ascending: alphanumeric words of the A-Z lower-cased text, runs of signs,
    and the share of distinct words in tenths."""
    mask = (1 << bits) - 1
    words = alnum_split(text)
    tokens = set(words)
    share = b" distinct %d" % (10 * len(tokens) // max(len(words), 1))
    tokens.update(text.translate(SIGNS).split())
    if len(words) >= 20:
        tokens.add(share)
    return np.unique(np.array([crc32(w) & mask for w in tokens], np.int32))


def _sampled(docs, ratings, id_col, text_col, max_ratings, bits):
    """Arrow table (id, grade, features) of the sample."""
    chosen = ratings.where("grade is not null").select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade"))
    chosen = chosen.where("id is not null").orderBy(F.xxhash64("id"), "id", "grade").limit(max_ratings)

    def run(batches):
        for b in batches:
            feats = [buckets(t.as_py(), bits) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(feats, pa.list_(pa.int32()))],
                                             names=["id", "grade", "features"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select("id", "grade", "text")  # at most max_ratings small rows
    return rows.mapInArrow(run, "id string, grade int, features array<int>").toArrow().sort_by(
        [("id", "ascending"), ("grade", "ascending")])


COPY = 0.8  # share of common buckets (of those of both texts) from which two ratings are of copies


def _without_copies(rows: pa.Table) -> pa.Table:
    """One rating per group of near copies: the words of one text that was copied often must not look telling.  Texts whose
    three smallest mixed buckets agree are compared, and go only if they share ``COPY`` of their buckets with a text that
    stays.  Texts without tokens are left as they are."""
    seen, keep = {}, []
    for i, f in enumerate(rows["features"]):
        own = np.array(f.values, np.int64)
        low = np.sort(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20))[:3].tobytes()
        others = seen.setdefault(low, [])
        common = (len(np.intersect1d(own, x, assume_unique=True)) for x in others)
        if low and any(n >= COPY * (len(own) + len(x) - n) for n, x in zip(common, others)):
            continue
        others.append(own)
        keep.append(i)
    return rows.take(pa.array(keep, pa.int64()))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_ratings: int = MAX_RATINGS, bits: int = BITS, min_docs: int = MIN_DOCS,
        min_z: float = MIN_Z) -> OrdinalModel:
    """``ratings`` has the id and an integer ``grade`` from 0 (null grades and ids do not count; several ratings of a
    document all count).  Full-batch Adam on the penalised log likelihood; the same input gives the same model."""
    rows = _without_copies(_sampled(docs, ratings, id_col, text_col, max_ratings, bits))
    grade = rows["grade"].to_numpy().astype(np.int64)
    weights = np.zeros(1 << bits, np.float32)
    if not len(grade) or grade.max() < 1:
        return OrdinalModel(weights, np.zeros(0), bits)
    feats = rows["features"].combine_chunks()
    flat, ends = feats.flatten().to_numpy(), np.diff(feats.offsets.to_numpy())
    doc = np.repeat(np.arange(len(grade)), ends)
    n, k = len(grade), int(grade.max()) + 1
    there = np.bincount(flat, minlength=1 << bits)
    total = np.bincount(flat, weights=grade[doc], minlength=1 << bits)
    error = grade.std() * np.sqrt(there * (1 - there / (n + 1.0)))
    lift = np.abs(total - there * grade.mean())
    telling = (there >= min_docs) & (lift >= min_z * error) & (lift >= MIN_LIFT * there)
    flat, doc = flat[telling[flat]], doc[telling[flat]]
    used, flat = np.unique(flat, return_inverse=True)
    at_least = np.array([(grade >= j).sum() for j in range(1, k)])
    share = (at_least + 0.5) / (n + 1.0)
    theta = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(k - 1))
    gaps = np.log(np.maximum(np.diff(theta), 1e-3))
    x = np.concatenate((np.zeros(len(used)), theta[:1], gaps))  # weights, lowest threshold, log gaps
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, STEPS + 1):
        w, theta = x[:len(used)], np.cumsum(np.concatenate((x[len(used):len(used) + 1], np.exp(x[len(used) + 1:]))))
        score = np.bincount(doc, weights=w[flat], minlength=n)
        tail = 1.0 / (1.0 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))
        full = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), axis=1)
        slope = full * (1 - full)
        at = np.arange(n)
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-12)
        up, down = slope[at, grade] / p, slope[at, grade + 1] / p  # d log p / d(s - theta) of both ends
        g_theta = np.zeros((n, k + 1))
        g_theta[at, grade] += up
        g_theta[at, grade + 1] -= down
        g_theta = g_theta[:, 1:k].sum(axis=0) / n
        g_w = -np.bincount(flat, weights=(up - down)[doc], minlength=len(used)) / n + RIDGE * w
        g = np.concatenate((g_w, [g_theta.sum()], [g_theta[j:].sum() * np.exp(x[len(used) + j]) for j in range(1, k - 1)]))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x = x - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    weights[used] = x[:len(used)]
    return OrdinalModel(weights, np.cumsum(np.concatenate((x[len(used):len(used) + 1], np.exp(x[len(used) + 1:])))), bits)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` (all rows and columns) with expected_grade, p_top and keep.  A document is kept if its tail probability of
    the top grade is at least that of a text whose score is ``-margin``: without telling tokens the score is 0, so a
    model that has learnt little keeps everything.  A model without ratings gives null scores and keeps every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.bits))
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED.fieldNames()])
    schema = T.StructType(plain.schema.fields + ADDED.fields)
    at = plain.columns.index(text_col)

    def run(batches):
        m = OrdinalModel(*shared.value)
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            s = np.array([m.weights[buckets(t.as_py() or b"", m.bits)].sum(dtype=np.float64) for t in texts], np.float64)
            if len(m.thresholds):
                tails, cut = m.tails(s), m.tails(np.array([-margin]))[0, -1]
                new = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= cut)]
            else:
                new = [pa.nulls(len(s), pa.float64()), pa.nulls(len(s), pa.float64()), pa.array([True] * len(s), pa.bool_())]
            yield pa.RecordBatch.from_arrays(list(b.columns) + new, names=schema.fieldNames())

    return plain.mapInArrow(run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 poor, 1 sound but toxic, 2 sound and clean.  Rows with a null mark have none."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
