import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import divergence as D

DOC = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= 3]
        count = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, words in docs:
            if la == lang:
                count[s].update(w for w in words if df[w] >= 3)
        whole = sum(count.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k) for k, (v, i) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_query_equals_sql(spark):
    check_oracle(spark, "op13_divergence_audit", SF_MID)


def test_random_documents(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["é", "Ü", "ß"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 120))), rng.choice(["en", "de"]),
             rng.choice(["a", "b", "c", "Z", "é"])) for i in range(300)]
    assert found(D.divergence(spark.createDataFrame(rows, DOC).repartition(5), top_terms=7)) == brute(rows, 7)


def test_edge_cases(spark):
    rows = [(1, "A a b", "en", "s"), (1, "A a b", "en", "s"), (None, None, None, None), (2, "", "en", None), (3, "a b " * 90000, "en", "t"),
            (4, "KK Ünter 12 a_b", "en", "t"), (5, "12 34", "xx", "u"), (6, "b", "en", ""), (7, "lone", "yy", "v"), (8, "lone", "yy", "w")]
    docs = spark.createDataFrame(rows, DOC)
    for c in ("term", "n", "id", "word", "value", "zero", "total"):
        docs = docs.withColumn(c, F.lit("clash"))
    assert found(D.divergence(docs)) == brute(rows)
    assert D.divergence(docs.where("false")).count() == 0


def test_small_steps_of_the_kernel(spark, monkeypatch):
    """Sums that do not depend on how cells are cut into steps; large shares do not overflow."""
    rng = np.random.default_rng(5)
    bits, source = rng.integers(0, 2**63, 40).astype(np.uint64), np.arange(40) // 8
    p = np.concatenate(([10**9 + 1, 1], rng.integers(1, 10**6, 38)))
    zero = np.repeat(rng.integers(1, 50, 5), 8)
    whole = D.joint_cells(bits, source, p, zero)
    monkeypatch.setattr(D, "CELLS", 90)
    assert all((a == b).all() for a, b in zip(whole, D.joint_cells(bits, source, p, zero)))
    f = lambda a, b: (a - b) ** 2 // b
    want = Counter()
    for i in range(40):
        for j in range(40):
            n = (int(bits[i]) & int(bits[j])).bit_count()
            if n and source[i] != source[j]:
                a, b, c, d = int(p[i]), int(p[j]), int(zero[i]), int(zero[j])
                want[source[i], source[j]] += n * (f(a, b) - f(a, d) - f(c, b) + f(c, d))
    wrap = lambda v: (v + 2**63) % 2**64 - 2**63
    assert {(a, b): v for a, b, v in zip(*whole)} == {k: wrap(v) for k, v in want.items()}
