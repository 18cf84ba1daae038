import random
import re

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=13):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, b in items:
            v = words(b)
            n = min(k, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit.update(range(p, p + n))
                        if j is not None:
                            found.add(str(j))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def collect(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    check_oracle(spark, "op4_decontaminate", SF_MID)


def test_random_and_edge_cases(spark, make_docs, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(j, text(rng.choice([3, 13, 15, 20]))) for j in range(12)] + [(90, None), (91, "..."), (None, "d d d d"), (92, "É é")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "!!"), (None, items[0][1]), (103, "x " * 60000 + items[1][1].upper()), (104, "é É x É é")]
    docs += [docs[0], docs[0]]
    bench = make_docs(items).withColumnRenamed("doc_id", "item_id").withColumn("item", F.lit("clash"))
    df = make_docs(docs).withColumn("segment", F.lit("clash")).withColumn("n_words", F.lit(0))
    want = brute(docs, items)
    assert collect(D.contamination(df, bench)) == want
    monkeypatch.setattr(D, "SEGMENT_WORDS", 50)  # many segments
    index = D.build_index(df)
    few = D.find_matches(index, D.benchmark_windows(bench), block_windows=7)  # many blocks
    one = D.find_matches(index, D.benchmark_windows(bench))
    key = lambda x: {(r.segment, r.nth_doc, r["item"]) for r in x.where("kind = 'exact'").collect()}
    assert key(few) == key(one)
    kept = D.without_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r[0]) for r in want if not r[4])
    assert D.contamination(df.where("false"), bench).count() == 0
    assert not any(r.contaminated for r in D.contamination(make_docs([(1, "w"), (2, None)]), bench).collect())
    assert not any(r.contaminated for r in D.contamination(df, bench.where("false")).collect())


def test_proximity(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(13))
    loose = "intro " + passage.replace("w5", "w5 really").replace("w1 ", "")
    got = {r.doc_id: (r.n_hit, r.n_near_items) for r in D.contamination(
        make_docs([(1, passage), (2, loose), (3, "w1 w1 w1 other")]),
        make_docs([(7, passage)]).withColumnRenamed("doc_id", "item_id")).collect()}
    assert got == {1: (13, 0), 2: (0, 1), 3: (0, 0)}


def brute_near(docs, items, k=13, slack=4, share=0.8):
    """Items with a window of which enough terms stand within slack of their place, and without an exact window."""
    out, exact = {}, {i: set(found) for i, _, _, found, _ in brute(docs, items, k)}
    for i, t in docs:
        w, near = words(t), set()
        for j, b in items:
            v = words(b)
            n = min(k, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(-n - slack, len(w) + slack):
                    there = sum(v[s + x] in w[max(p + x - slack, 0):max(p + x + slack + 1, 0)] for x in range(n))
                    if n - there <= int((1 - share) * n + 1e-9):
                        near.add(str(j))
        out[i] = len(near - exact[i])
    return out


def near_items(spark_docs, bench):
    return {r.doc_id: r.n_near_items for r in D.contamination(spark_docs, bench.withColumnRenamed("doc_id", "item_id")).collect()}


def test_proximity_without_the_rarest_terms(spark, make_docs):
    passage = [f"w{i}" for i in range(13)]
    common = " ".join(f"{w} {w} filler" for w in passage if w not in ("w6", "w9"))  # w6 and w9 are the rarest of the corpus
    texts = [" ".join(passage), " ".join("typo" if w == "w6" else w for w in passage), " ".join(w for w in passage if w not in ("w6", "w9")),
             " ".join("other" if w in ("w6", "w9", "w0") else w for w in passage), "a b w6 " + " ".join(w for w in passage if w != "w6")]
    docs = list(enumerate(texts)) + [(9, common)]
    items = [(7, " ".join(passage)), (8, " ".join("absent" if w == "w3" else w for w in passage)), (6, "lone"), (5, "w6 w9 two")]
    want = brute_near(docs, items)
    assert want[1] >= 1 and want[2] >= 1
    assert near_items(make_docs(docs), make_docs(items)) == want


def test_proximity_equals_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    items = [(j, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 13, 16])))) for j in range(12)]
    docs = []
    for i in range(50):
        w = rng.choices(vocab, k=rng.randint(0, 12))
        for _, b in rng.sample(items, 2):
            v = b.split()
            for _ in range(rng.randint(0, 4)):
                x = rng.randrange(len(v) + 1)
                v[x:x + rng.randint(0, 1)] = rng.choices(vocab + ["new"], k=rng.randint(0, 2))
            w += v + rng.choices(vocab, k=rng.randint(0, 6))
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(D, "SEGMENT_WORDS", 200)
    monkeypatch.setattr(D, "CANDIDATES", 50)
    want = brute_near(docs, items)
    assert sum(want.values()) > 50
    assert near_items(make_docs(docs), make_docs(items)) == want
