from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import mixing as M
from tessera.llm.common import read


def test_query_equals_sql(spark):
    check_oracle(spark, "op10_mixing", SF_MID)


def test_marginals_are_met(spark):
    docs = read(spark, SF_MID, "documents")
    want = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    targets = {"lang": spark.createDataFrame(list(want.items()) + [("xx", 0.5)], "value string, target double"),
               "topic": spark.createDataFrame([("prose", 0.7), ("legal", 0.2), ("table", 0.1)], "value string, target double")}
    got = M.mix(docs, targets, sweeps=30).groupBy("__lang").agg(
        F.sum(F.col("__tokens") * F.col("probability")).alias("n")).collect()
    total = sum(r.n for r in got)
    assert all(abs(r.n / total - want[r["__lang"]]) < 1e-4 for r in got)
    assert M.mix(docs, targets).where("__topic = 'signs' and sampled").count() == 0  # no target: left out
    assert abs(M.mix(docs, targets).agg(F.max("probability")).first()[0] - 1.0) < 1e-9


def test_edge_cases(spark):
    rows = [(1, "a b c", None, "s"), (1, "a b c", None, "s"), (None, None, "en", "s"), (2, "", "en", None), (3, "x " * 90000, "de", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("factor", F.lit("clash")) \
        .withColumn("tokens", F.lit(1)).withColumn("probability", F.lit("old"))
    got = M.mix(docs.drop("probability")).collect()
    assert len(got) == 5 and {r["__tokens"] for r in got} == {0, 3, 90000}
    assert all(0 <= r.probability <= 1 and r.sampled is not None for r in got)
    assert M.sample(docs).columns == ["doc_id", "text", "lang", "source", "factor", "tokens", "probability"]
    assert M.mix(docs.drop("probability").where("false")).count() == 0
    assert M.mix(docs.select("doc_id", "text")).count() == 5  # no source, no language
