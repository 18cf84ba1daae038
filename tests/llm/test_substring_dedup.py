import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import substring_dedup as S


def brute(docs, n):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - n + 1):
            if first.setdefault(tuple(w[s:s + n]), (i, s)) != (i, s):
                gone.update(range(s, s + n))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_query_equals_sql(spark):
    check_oracle(spark, "op9_substring_dedup", SF_MID)


@pytest.mark.parametrize("n", [1, 3, 20])
def test_random_documents(spark, make_docs, monkeypatch, n):
    monkeypatch.setattr(S, "CHUNK_WORDS", 40)  # many chunks
    rng = random.Random(n)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12 * n)))) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(20)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(make_docs(docs).repartition(5), min_words=n).collect()}
    assert got == brute(docs, n)


def test_edge_cases(spark, make_docs):
    phrase = " ".join(f"w{i}" for i in range(25))
    docs = [(None, phrase), (5, "x\t" + phrase + "\n y"), (2, None), (3, ""), (4, " \n"), (6, "z " * 200000), (7, "too short"),
            (8, "é b " * 30)]
    df = make_docs(docs + [docs[1], docs[1]]).withColumn("key", F.lit("clash")).withColumn("places", F.lit(1))
    got = S.substring_dedup(df).collect()
    assert len(got) == len(docs) + 2
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute(docs, 20)
    assert S.substring_dedup(df.where("false")).count() == 0


def test_documents_of_one_id_with_like_keys(spark, make_docs):
    """Null-id documents, two of which agree in half of their text key, and unlike texts under one id, stay apart."""
    body, seen = " ".join(f"v{i}" for i in range(24)), {}
    for k in range(400_000):
        text = f"{body} {k} " + "tail " * (k % 7)
        half = xxhash.xxh64_intdigest(text.encode(), 42) >> 32
        if half in seen:
            break
        seen[half] = text
    docs = [(None, seen[half]), (None, text), (None, "other " + " ".join(f"o{i}" for i in range(30))), (7, "same id " + body), (7, "same id, too"), (8, body), (9, "clean")]
    got = {}
    for r in S.substring_dedup(make_docs(docs)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert sorted(n for n, _ in got[None]) == sorted(len(t.split()) for i, t in docs if i is None)
    # of the two null-id texts with a common body one, the first by key, loses no word of it
    assert sorted(gone for _, gone in got[None]) == [0, 0, 24]
    assert sorted(got[7]) == [(3, 0), (26, 24)] and got[8] == [(24, 24)] and got[9] == [(1, 0)]


def test_copies_do_not_meet_in_one_group(spark, make_docs):
    copy = " ".join(f"w{i}" for i in range(21))
    docs = make_docs([(i, copy) for i in range(1500)] + [(5000 + i, " ".join(f"u{i}x{j}" for j in range(20))) for i in range(500)]
                     + [(9000 + i, "same " * 40) for i in range(400)])
    packed, n_groups = S.packed_suffixes(S.keyed(docs, "doc_id", "text"), 20)
    sizes = [r.n for r in packed.groupBy("grp").agg(F.sum("n").alias("n")).collect()]
    assert n_groups >= 8 and sum(sizes) == 2 * 1500 + 500 + 21 * 400
    assert max(sizes) < 2 * sum(sizes) / n_groups
    assert packed.where("length(paths) > 0").agg(F.sum("n")).first()[0] < 1000
