import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tessera.llm import simhash
from tessera.llm.common import read


def brute_fp(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    from tessera.llm.queries import QUERIES
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, SF_SMALL).collect()}
    rows = read(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    ids, fps = [r.doc_id for r in rows], [brute_fp(r.text) for r in rows]
    want = brute_components(ids, fps, 4)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, want)}


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 5])
def test_links_equal_all_pairs(spark, bits):
    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    for s in seeds:
        for _ in range(25):
            x = s
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {r.fp: r.root for r in simhash.link_fingerprints(
        spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()}
    want = brute_components(signed, [x % (1 << 64) for x in signed], bits)
    classes = defaultdict(set)
    for x, c in zip(signed, want):
        classes[c].add(x)
    found = defaultdict(set)
    for x, c in got.items():
        found[c].add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))


def test_edge_cases(spark, make_docs):
    text = " ".join(f"word{i}" for i in range(400))
    docs = make_docs([(5, text), (3, text), (3, text), (None, text), (9, None), (8, ""), (7, " \t\n"), (1, "two words"),
                      (2, "Two  WORDS"), (4, "x " * 50000)]).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    by = {r.doc_id: (r.fp, r.component_id) for r in got}
    assert len(got) == 10
    assert by[5] == by[3] == by[None] and by[5][1] == 3
    assert by[9] == by[8] == by[7] == (0, 7)
    assert by[1] == by[2] and by[1][1] == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components_with_one_id_keep_one_each(spark, make_docs):
    texts = [" ".join(f"{c}{i}" for i in range(300)) for c in "abcdef"]
    docs = make_docs([(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]),
                      (9, texts[4]), (9, texts[4] + " end"), (None, texts[5]), (6, texts[5])])
    assert len({r.fp for r in simhash.fingerprints(docs).collect()}) >= 6
    kept = sorted(((r.doc_id, r.text[0]) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == [(6, "f"), (7, "c"), (7, "d"), (9, "e"), (None, "a"), (None, "b")]
