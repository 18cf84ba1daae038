"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments.  If two fingerprints differ in at most four bits, one
segment differs in at most two, so the radius-1 Hamming balls of that segment meet: each fingerprint
enters the 33 keys of the ball of each segment, fingerprints that meet at a key are candidates, and the
complete distance is verified.

Groups of copies stay linear: equal fingerprints are one node; pairs one bit apart are looked up first
(64 exact keys per fingerprint, never a hot key) and merged into clusters; the ball keys are then joined
only where they hold more than one cluster, and only across clusters.  A key that holds a single
cluster, however large, yields no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blanks_split, columns_of, parallelism, small_batches, stored, text_key, text_or_empty, whole_rows
from tessera.llm.components import components

XXH_SEED = 42
BLOCK = 1 << 15  # shingles whose bits are unpacked at once
SEGMENT_BITS = 32
MAX_LINK_BITS = 5  # two segments with radius-1 balls on both sides cover up to five differing bits


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash (as a signed long) of the word shingles; a bit is set if over half the hashes set it."""
    words = blanks_split(text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], XXH_SEED) for s, e in zip(starts.tolist(), ends[k - 1:].tolist())],
                      dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, text_key, fp) for every row of ``docs``; fp is a bigint, 0 for a text without words."""
    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], names=[id_col, "text_key", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), text_key(text_col).alias("text_key"), text_or_empty(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, text_key bigint, fp bigint")


def link_fingerprints(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """``nodes`` has distinct bigints ``fp``.  Returns (fp, root): fingerprints linked, directly or through
    others, by at most ``max_bits`` differing bits share the root."""
    if max_bits > MAX_LINK_BITS:
        raise ValueError(f"at most {MAX_LINK_BITS} differing bits are covered by two radius-1 segment balls")
    spark = nodes.sparkSession
    wide = nodes.select("fp").repartition(parallelism(spark), "fp")
    root = nodes.select("fp", F.col("fp").alias("root"))
    if max_bits >= 1:
        probes = wide.select("fp", F.explode(F.expr(
            "filter(transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)), p -> p > fp)")).alias("probe"))
        near = probes.join(nodes.select(F.col("fp").alias("probe")), "probe")
        first = components(near.select(F.col("fp").alias("u"), F.col("probe").alias("v")))
        root = nodes.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("root"))
    if max_bits < 2:
        return root
    root = stored(root, "simhash-roots")
    ball = f"transform(sequence(0, {SEGMENT_BITS}), i -> if(i = {SEGMENT_BITS}, s, s ^ shiftleft(1L, i)))"
    keys = F.expr(f"""concat(
        transform(array(shiftrightunsigned(fp, 32)), s -> {ball})[0],
        transform(transform(array(fp & 4294967295L), s -> {ball})[0], k -> k | 4294967296L))""")
    items = root.repartition(parallelism(spark), "fp").select("fp", "root", F.explode(keys).alias("key"))
    mixed = items.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    # one exchange of the items serves the grouping and the join; the candidates left are few and joined anew below
    met = stored(items.join(mixed, "key", "left_semi"), "simhash-candidates")
    other = met.select("key", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    links = met.join(other, (met["key"] == other["key"]) & (F.col("root") < F.col("root2"))
                     & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits))
    second = components(links.select(F.col("root").alias("u"), F.col("root2").alias("v")))
    return root.join(second.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select(
        "fp", F.coalesce("last", "root").alias("root"))


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """(id_col, text_key, fp, root, component_id): ``root`` names the component, also where components share their smallest id."""
    members = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    nodes = stored(members.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-nodes")
    linked = stored(link_fingerprints(nodes, max_bits), "simhash-linked")
    # stored: the join below then has its own exchange on both sides, and Spark can split a hot component
    least = stored(linked.join(nodes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = linked.join(least, "root").select("fp", "root", "component_id")
    return members.join(named, "fp").select(id_col, "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: (id_col, text_key, fp, component_id).

    ``component_id`` is the smallest id among all documents reachable over links of at most ``max_bits``
    differing fingerprint bits, the document itself included; null ids do not count, so it is null only
    if the whole component has null ids.  Texts without words have fingerprint 0 and are linked like any other.
    """
    return _components(docs, id_col, text_col, shingle, max_bits).select(id_col, "text_key", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
             max_bits: int = 4) -> DataFrame:
    """``docs`` with one document per component: the one whose id is the component id (of several, the smallest text key),
    exact repeats of it once.  Components that share their smallest id, null included, keep one each."""
    found = _components(docs, id_col, text_col, shingle, max_bits)
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct(F.col(id_col).alias("id"), "text_key")).alias("least"))
    keep = keep.select(F.col("least.id").alias("__id"), F.col("least.text_key").alias("__key"))
    rows = docs.select(whole_rows(docs), F.col(f"`{id_col}`").alias("__doc"), text_key(text_col).alias("__row_key"))
    kept = rows.join(keep, rows["__doc"].eqNullSafe(keep["__id"]) & (rows["__row_key"] == keep["__key"]), "left_semi")
    return kept.dropDuplicates(["__doc", "__row_key"]).select(*columns_of(docs))
