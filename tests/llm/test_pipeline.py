import sys
from pathlib import Path

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fp
from tessera.llm import mixing, quality
from tessera.llm.common import read

sys.path.insert(0, str(Path(__file__).parents[2]))


def test_run_equals_brute_force(spark):
    import corpus_pipeline as P
    docs = read(spark, SF_SMALL, "documents")
    got = P.run(spark, SF_SMALL)
    assert got.columns == docs.columns + ["probability"]
    got = {r.doc_id: r for r in got.collect()}
    model = quality.fit(docs, quality.graded(read(spark, SF_SMALL, "labels")))
    kept = [(r.doc_id, r.text) for r in quality.score(docs, model).where("keep").collect()]
    lines = brute_lines(kept, 3)
    kept = [(i, lines[i][0]) for i, t in kept if not (lines[i][1] and lines[i][2] == lines[i][1])]
    roots = brute_components([i for i, _ in kept], [brute_fp(t) for _, t in kept], 4)
    kept = [(i, t) for (i, t), c in zip(kept, roots) if i == c]
    items = [(r.item_id, r.text) for r in read(spark, SF_SMALL, "benchmark").collect()]
    bad = {r[0] for r in brute_hits(kept, items) if r[4]}
    kept = dict((i, t) for i, t in kept if i not in bad)
    assert set(got) <= set(kept) and len(got) > 0.3 * len(kept)
    assert all(r.text == kept[i] and r.n_chars == len(r.text) for i, r in got.items())
    left = docs.drop("text", "n_chars").join(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), "doc_id")
    drawn = {r.doc_id: r.probability for r in mixing.mix(left).where("sampled").collect()}
    assert drawn.keys() == got.keys() and all(abs(drawn[i] - got[i].probability) < 1e-8 for i in got)


def test_stages_take_odd_tables(spark, make_docs):
    import corpus_pipeline as P
    docs = make_docs([(1, None), (None, "x"), (2, ""), (3, "a b c\n" * 2000), (3, "a b c\n" * 2000)]).withColumn(
        "keep", F.lit("mine")).withColumn("source", F.lit("s"))
    for c in ("_keep", "__keep", "__id", "__key", "__cuts", "__row", "__row_key", "__doc", "__text", "__lang", "__tokens", "__topic"):
        docs = docs.withColumn(c, F.lit("own"))
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns + (["probability"] if name == "mixing" else []), name
        rows = out.collect()
        assert rows and all(r[c] == ("mine" if c == "keep" else "own") for r in rows for c in docs.columns[2:] if c != "source"), name
        assert stage(spark, docs.where("false"), SF_SMALL).count() == 0, name
