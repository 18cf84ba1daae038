import random

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import line_dedup as L


def brute(docs, t):
    first, out = {}, {}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    lines = {i: (x.split("\n") if x else []) for i, x in order}
    for i, _ in order:
        ls = lines[i]
        gone = set()
        for s in range(max(len(ls) - t + 1, 1) if ls else 0):
            key = tuple(ls[s:s + t])
            if first.setdefault(key, (i, s)) != (i, s):
                gone.update(range(s, min(s + t, len(ls))))
        out[i] = ("\n".join(x for j, x in enumerate(ls) if j not in gone), len(ls), len(gone))
    return out


def test_query_equals_sql(spark):
    check_oracle(spark, "op1_line_dedup", SF_MID)


def test_random_documents(spark, make_docs):
    for t in (1, 2, 4):
        rng = random.Random(t)
        docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(60)]
        got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in L.line_dedup(make_docs(docs), min_lines=t).collect()}
        assert got == brute(docs, t)


def test_edge_cases(spark, make_docs):
    docs = [(None, "a\nb\nc"), (1, "x\na\nb\nc\ny"), (2, None), (3, ""), (4, "one line"), (5, "one line"), (6, "\n\n\n\n"),
            (7, "z\n" * 5000), (8, "one line\nmore")]
    df = make_docs(docs + [docs[1], docs[4]]).withColumn("key", F.lit(1)).withColumn("first", F.lit("clash"))
    got = L.line_dedup(df).collect()
    want = brute(docs, 3)
    assert len(got) == len(docs) + 2
    assert {r.doc_id: (r.kept_text, r.n_lines, r.n_removed) for r in got} == want
    assert {r.doc_id: [tuple(x) for x in r.removed_runs] for r in got}[1] == [(1, 3)]
    odd = df.withColumns({c: F.lit("own") for c in ("__id", "__key", "__cuts", "__text", "__lines", "__doc", "__row", "a.b")})
    assert all(r["__id"] == r["__cuts"] == r["__row"] == r["a.b"] == "own" for r in L.line_dedup(odd).collect())
    assert L.without_repeats(odd).columns == odd.columns
    kept = L.without_repeats(df)
    assert kept.columns == df.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] == "x\ny" and texts[2] is None and texts[3] == "" and texts[8] == "one line\nmore"
    assert 4 in texts and 5 not in texts
    assert L.line_dedup(df.where("false")).count() == 0
