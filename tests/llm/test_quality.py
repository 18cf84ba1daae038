import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tessera.llm import quality as Q
from tessera.llm.common import read
from tessera.llm.queries import QUERIES

SF_FIT = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = read(spark, SF_FIT, "documents"), read(spark, SF_FIT, "labels")
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    model = Q.fit(docs, Q.graded(labels.where(~held)))
    assert np.all(np.diff(model.thresholds) > 0)
    got = Q.score(docs.select("doc_id", "text"), model).join(labels.where(held), "doc_id").groupBy("quality", "toxic").agg(
        F.avg(F.col("keep").cast("double")).alias("kept"), F.avg("expected_grade").alias("grade")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in got}
    grade = {(r.quality, r.toxic): r.grade for r in got}
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.05 and kept[0, 1] < 0.05 and kept[1, 1] < 0.5
    assert grade[0, 0] < grade[1, 1] < grade[1, 0]


def test_query_scores_every_document_as_the_model_says(spark):
    got = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, SF_MID).collect()}
    docs = read(spark, SF_MID, "documents")
    model = Q.fit(docs, Q.graded(read(spark, SF_MID, "labels")))
    rows = docs.collect()
    assert len(rows) == len(got)
    for r in rows[:300]:
        s = sum(float(model.weights[b]) for b in Q.buckets(r.text.encode(), model.bits))
        tail = 1 / (1 + np.exp(model.thresholds - s))
        assert abs(got[r.doc_id].p_top - tail[-1]) < 1e-6 and abs(got[r.doc_id].expected_grade - tail.sum()) < 1e-6
        assert got[r.doc_id].keep == (s >= -Q.MARGIN)


def test_edge_cases(spark, make_docs):
    docs = make_docs([(1, "good words here"), (1, "good words here"), (2, None), (None, ""), (3, "bad " * 100000)])
    df = docs.withColumn("keep", F.lit("clash")).withColumn("grade", F.lit(9)).withColumn("id", F.lit("x"))
    ratings = spark.createDataFrame([(1, 2), (3, 0), (1, None), (None, 1), (77, 1)], "doc_id long, grade int")
    got = Q.score(df, Q.fit(df, ratings, min_docs=1))
    assert got.columns == ["doc_id", "text", "grade", "id", "expected_grade", "p_top", "keep"]
    assert got.count() == 5
    none = Q.score(df, Q.fit(df, ratings.where("false"))).collect()
    assert all(r.keep and r.p_top is None for r in none)
    assert Q.score(df.where("false"), Q.fit(df, ratings)).count() == 0
    assert Q.graded(spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
                    ).orderBy("doc_id").collect() == [(1, 0), (2, 1), (3, 2), (4, None)]


def test_only_verified_copies_are_left_out():
    """Ratings that share their three smallest mixed buckets stay unless most buckets are shared."""
    import numpy as np
    import pyarrow as pa
    mixed = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    low = sorted(range(5000), key=lambda b: int(mixed([b])[0]))[:3]
    rng = np.random.default_rng(1)
    rest = [b for b in range(5000) if b not in low]
    one, other = (sorted(low + list(rng.choice(rest, 40, replace=False))) for _ in range(2))
    copy = sorted(one[:-1] + [b for b in rest if b not in one][:1])
    rows = pa.table({"id": ["a", "b", "c", "d", "e", "f"], "grade": pa.array([0, 1, 2, 0, 1, 2], pa.int32()),
                     "features": pa.array([one, other, copy, one, [], []], pa.list_(pa.int32()))})
    assert Q._without_copies(rows)["id"].to_pylist() == ["a", "b", "e", "f"]
