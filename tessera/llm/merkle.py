"""Merkle manifest of a dataset with incremental witnesses.

Documents of a group (its source) ascend by id and are appended as leaves to the group's tree; the roots of the groups
are appended to the tree of the dataset.  Runs of ``arity`` nodes become their hash, level by level, the last run of a
level being shorter if need be, until one node remains.

Appends are streams over aligned blocks of ``arity ** height`` leaves.  A frontier keeps the open subtree of every
level; a leaf enters with an empty witness, and whenever the run of its subtree is complete the siblings found there
extend the partial witnesses of all leaves below.  A block ends as one root with a partial witness for each leaf.  The
block roots are then appended in the same way, block by block, so each round divides the table by ``arity ** height``
(6,561) and its witnesses extend those of the round before, by a join on the block.

Places come from a range-partitioned sort and the row counts of its partitions; the sorted table is stored, so a lost
executor does not renumber it.  Nothing but a yes or no a round reaches the driver; a task holds one block.

A witness is binary: for each level a byte for the place in the run, a byte for the run's size, and the other digests.

Result, defined: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its value.  The null group comes
first, null ids first; rows that repeat an id ascend by leaf digest, equal rows are separate leaves.  Empty tables give
no rows.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import small_batches, stored

ARITY, HEIGHT = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = T.StructType([T.StructField("grp", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
                     T.StructField("digest", T.BinaryType()), T.StructField("witness", T.BinaryType()), T.StructField("root", T.BooleanType())])
OUT_ROWS = 2048


def leaf_digest(columns: list[Column]) -> Column:
    """Hex sha256 of the fields, each told apart by its length."""
    def field(c):
        v = c.cast("string")
        return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def hashed(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


class Frontier:
    """Streaming append: the open run of every level, and the witnesses of the leaves below each of its nodes."""

    def __init__(self, arity: int):
        self.arity, self.open, self.witnesses = arity, [[]], []

    def append(self, digest: bytes) -> None:
        self.witnesses.append(bytearray())
        self._add(0, digest, [self.witnesses[-1]])

    def _add(self, level: int, digest: bytes, below: list) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, below))
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for k, (_, below) in enumerate(run):
            step = bytes((k, len(run))) + b"".join(digests[:k] + digests[k + 1:])
            for w in below:
                w += step
        self._add(level + 1, hashed(digests), [w for _, below in run for w in below])

    def finish(self, height: int | None = None) -> bytes:
        """The root.  With a height, subtrees are raised to it even if a single node is left before."""
        level = 0
        while level < height if height is not None else any(self.open[level + 1:]) or len(self.open[level]) > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return next(run for run in self.open[level:] if run)[0][0]


def climb(digest: str, witness: bytes) -> tuple[str, str]:
    """(root that the leaf folds to, hash of all siblings), both in hex."""
    at, siblings = 0, sha256()
    while at < len(witness):
        k, size = witness[at], witness[at + 1]
        others = [witness[p:p + 32].hex() for p in range(at + 2, at + 2 + 32 * (size - 1), 32)]
        siblings.update("".join(others).encode())
        digest = sha256("".join([*others[:k], digest, *others[k:]]).encode()).hexdigest()
        at += 2 + 32 * (size - 1)
    return digest, siblings.hexdigest()


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos`` in its ``grp``, from 0, and ``n``, the group's rows."""
    rows = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.expr("shiftright(at, 33)")), "merkle-sorted")
    parts = rows.groupBy("grp", "part").agg(F.min("at").alias("low"), F.count("*").alias("size"))
    of = Window.partitionBy("grp")  # one row for each partition that the group lies in
    before = F.sum("size").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("size").over(of)}).drop("size")
    return rows.join(parts, ["grp", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("low")).drop("part", "at", "low", "before")


def appended(nodes: DataFrame, arity: int, height: int, keep: list[str]) -> DataFrame:
    """``nodes`` (grp, pos, n, digest and ``keep``) with their witness inside their block, and the root of every block as a
    node of the next round (``root`` is true, pos is the block, n the group's blocks)."""
    span = arity ** height
    schema = T.StructType(NODE.fields + [nodes.schema[c] for c in keep])

    def run(batches):
        arrow = None
        out = []

        def block(rows):
            frontier, n = Frontier(arity), rows[0][2]
            for r in rows:
                frontier.append(r[3])
            root = frontier.finish(height if n > span else None)
            out.extend((*r[:4], bytes(w), False, *r[4:]) for r, w in zip(rows, frontier.witnesses))
            out.append((rows[0][0], rows[0][1] // span, -(-n // span), root, None, True, *[None] * len(keep)))

        def batch():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

        held, key = [], None
        for b in batches:
            types = b.schema.types
            arrow = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), *types[4:]]
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and key != (r[0], r[1] // span):
                    block(held)
                    held = []
                    if len(out) >= OUT_ROWS:
                        yield batch()
                key = (r[0], r[1] // span)
                held.append(r)
        if held:
            block(held)
        if out:
            yield batch()

    small_batches(nodes.sparkSession)
    rows = nodes.select("grp", "pos", "n", "digest", *keep)
    rows = rows.repartition("grp", F.expr(f"pos div {span}")).sortWithinPartitions("grp", "pos")
    return rows.mapInArrow(run, schema)


def witnessed(nodes: DataFrame, keep: list[str], arity: int, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (grp, pos, n, digest, keep): the nodes with their block and partial witness, the blocks (grp, block, path, top)
    whose path leads on to the group's root ``top``, and the roots (grp, top)."""
    rounds, now = [], nodes
    while True:
        rounds.append(stored(appended(now, arity, height, keep if not rounds else []), "merkle-round"))
        now = rounds[-1].where("root and n > 1").select("grp", "pos", "n", "digest")
        if now.isEmpty():
            break
    tops = [r.where("root and n = 1").select("grp", F.col("pos").alias("block"), F.lit(b"").alias("path"), F.col("digest").alias("top")) for r in rounds]
    blocks, span = tops[-1], arity ** height
    for r, top in list(zip(rounds[1:], tops))[::-1]:
        inner = r.where("not root").withColumn("block", F.expr(f"pos div {span}"))
        inner = inner.join(blocks, ["grp", "block"]).select("grp", F.col("pos").alias("block"), F.concat("witness", "path").alias("path"), "top")
        blocks = top.unionByName(inner)
    leaves = rounds[0].where("not root").withColumn("block", F.expr(f"pos div {span}"))
    return leaves, blocks, reduce(DataFrame.unionByName, tops).select("grp", "top")


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source", arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """``leaves`` has the id, the group, ``leaf`` (hex) and any other columns.  Returns the id and the others with ``leaf``,
    ``subroot``, ``root`` (hex) and ``witness``, all siblings from the leaf to the root."""
    others = [c for c in leaves.columns if c not in (id_col, group_col, "leaf")]
    named = [F.col(f"`{id_col}`").alias("k_id"), *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(others)]]
    keep = ["k_id", *[f"k_{i}" for i in range(len(others))]]
    # a key without nulls in the same order: the null group first, then bytewise
    grp = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    nodes = leaves.select(grp.alias("grp"), F.unhex("leaf").alias("digest"), *named)
    rows, blocks, tops = witnessed(placed(nodes, ["k_id", "digest"]), keep, arity, height)

    groups = placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("top").alias("digest")), ["key"])
    above, last, _ = witnessed(groups, ["key"], arity, height)
    above = above.join(last, ["grp", "block"]).select(F.col("key").alias("grp"), F.concat("witness", "path").alias("rest"), F.col("top").alias("whole"))
    blocks = stored(blocks.join(above, "grp").select("grp", "block", F.concat("path", "rest").alias("path"), "top", "whole"), "merkle-blocks")

    text = lambda c: F.lower(F.hex(c))
    return rows.join(blocks, ["grp", "block"]).select(
        F.col("k_id").alias(id_col), *[F.col(f"k_{i}").alias(c) for i, c in enumerate(others)], text("digest").alias("leaf"),
        text("top").alias("subroot"), text("whole").alias("root"), F.concat("witness", "path").alias("witness"))


def folded(rows: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``rows`` with ``folded_root``, what the digest in ``leaf_col`` and the witness fold to, and ``proof_sha256``, the hash of
    the witness's siblings; the witness itself goes."""
    plain = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "witness"], "witness")
    schema = T.StructType(plain.schema.fields[:-1] + [T.StructField("folded_root", T.StringType()), T.StructField("proof_sha256", T.StringType())])
    at = plain.columns.index(leaf_col)

    def run(batches):
        for b in batches:
            found = [climb(d, w) for d, w in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f for f, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.string())], names=schema.fieldNames())

    small_batches(rows.sparkSession)
    return plain.mapInArrow(run, schema)
