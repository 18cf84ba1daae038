"""Dense codes over several partitions and class quotas, against plain versions of their rules."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.functions.ranks import dense_codes
from tessera.operators import select as S


def rule(sizes, n, seed):
    """Seats one by one: each round seats every class with room, most room first."""
    lot = lambda c: int(hashlib.md5(f"{seed}|{c}".encode()).hexdigest()[:8], 16)
    seats = {c: min(k, n // len(sizes)) for c, k in sizes.items()}
    order, free = [], n - sum(seats.values())
    for c, k in sizes.items():
        order += [(r, -(k - seats[c] - r), lot(c), c) for r in range(k - seats[c])]
    for _, _, _, c in sorted(order)[:free]:
        seats[c] += 1
    return seats


def test_quotas_follow_the_rule(spark):
    rng = random.Random(7)
    for case in range(25):
        sizes = {c: rng.choice([1, 2, 3, 10, 40, 200]) for c in range(rng.randint(1, 9))}
        n = rng.randint(0, 300)
        got = S.balanced_quotas(spark.createDataFrame(list(sizes.items()), "label int, size int"), n, case)
        got = {r.label: r.quota for r in got.collect()}
        assert got == rule(sizes, n, case) and sum(got.values()) == min(n, sum(sizes.values())), (sizes, n)


def test_quotas_of_no_class(spark):
    assert S.balanced_quotas(spark.createDataFrame([], "label int, size int"), 5, 1).count() == 0


def test_dense_codes(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, "x", *"cdefghijk", "é"])) for _ in range(400)]
    values = spark.createDataFrame(rows, "g string, v string").repartition(6)
    got = {(r.g, r.v): r.code for r in dense_codes(values, "v", ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, v in enumerate(sorted({r[1] for r in rows if r[0] == g}, key=lambda x: (x is not None, (x or "").encode()))):
            want[g, v] = k
    assert got == want
    many = spark.range(20000).select((F.col("id") * 7).alias("v"))
    assert dense_codes(many, "v").where("code <> v / 7").isEmpty()
    assert dense_codes(many.where("false"), "v").count() == 0
