import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.oracle import check_oracle
from tessera.llm import merkle as M

DOC = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()


def leaf_of(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes, arity=3):
    """(root, for each node the sibling lists [(left, right), ...])."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for lo in range(0, len(nodes), arity):
            run = nodes[lo:lo + arity]
            for k in range(len(run)):
                for i in below[lo + k]:
                    paths[i].append((run[:k], run[k + 1:]))
            up.append(H(run))
            under.append([i for b in below[lo:lo + arity] for i in b])
        nodes, below = up, under
    return (nodes[0] if nodes else None), paths


def brute(rows, arity=3):
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r)))
    groups = {}
    for r in order:
        groups.setdefault(r[1], []).append(r)
    subs = {s: tree([leaf_of(r) for r in g], arity) for s, g in groups.items()}
    root, tops = tree([t for t, _ in subs.values()], arity)
    out = []
    for (s, (sub, paths)), top in zip(subs.items(), tops):
        for r, path in zip(groups[s], paths):
            path = path + top
            gone = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            acc = leaf_of((*r[:4], r[4].replace("\n", ""))) if gone else leaf_of(r)
            for left, right in path:
                acc = H([*left, acc, *right])
            out.append((r[0], leaf_of(r), sub, root, H(x for a, b in path for x in a + b), acc))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    fields = [F.col(c) for c in M.FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", M.leaf_digest(fields).alias("leaf"), M.leaf_digest([*fields[:4], changed]).alias("changed"))
    for c in ("grp", "pos", "n", "digest", "root", "part", "path"):
        leaves = leaves.withColumn(c + "_" if c == "root" else c, F.lit("clash"))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root)
                   for r in M.folded(M.manifest(leaves, **options), "changed").collect()), key=repr)


def test_query_equals_sql(spark):
    check_oracle(spark, "op11_merkle_manifest", SF_MID)


def test_blocks_of_blocks(spark):
    """Small blocks: several rounds, groups that end in different rounds, last blocks of one leaf."""
    rng = random.Random(2)
    sizes = {"a": 82, "b": 1, "c": 3, "d": 9, "e": 10, "é": 28, "": 27, None: 4, "Z": 81}
    rows = [(rng.randint(0, 10**6), s, "en", 3, rng.choice(["x\ny", "abc", "\n"])) for s, n in sizes.items() for _ in range(n)]
    for arity, height in ((3, 1), (3, 2), (2, 3)):
        assert found(spark, rows, arity=arity, height=height) == brute(rows, arity)


def test_edge_cases(spark):
    rows = [(1, "s", "en", 1, "a\nb"), (1, "s", "en", 1, "a\nb"), (1, "s", "de", 1, "other"), (None, None, None, None, None), (None, "s", None, None, "x\n"),
            (2, "t", "en", 0, ""), (3, None, "en", 5, "é\n" * 200000), (-7, "u", "", None, "12:x")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == brute(rows[:1])
    docs = spark.createDataFrame(rows, DOC).select("doc_id", "source", F.lit("00").alias("leaf"))
    assert M.folded(M.manifest(docs.where("false"))).count() == 0


def test_frontier_extends_witnesses():
    for n in range(1, 40):
        frontier, leaves = M.Frontier(3), [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        for k, d in enumerate(leaves):
            frontier.append(d)
            done = (k + 1) // 3 * 3  # leaves of completed runs have a partial witness, the others none yet
            assert all(bool(w) == (i < done) for i, w in enumerate(frontier.witnesses))
        root = frontier.finish().hex()
        assert root == tree([d.hex() for d in leaves])[0]
        assert all(M.climb(d.hex(), bytes(w))[0] == root for d, w in zip(leaves, frontier.witnesses))
