"""Exact substring deduplication with prefix-partitioned suffix trees over words.

Every window of ``min_words`` consecutive words is the path of a suffix down to depth ``min_words``.  A repeated
substring of that length or more is an internal node at that depth; longer (maximal) repeats are chains of such nodes
at consecutive places, so the tree is cut at this depth and a node is named by a hash of its path.

1. Prefix counts.  Suffixes are counted by the hash bucket of their first word, first two and first four words (tables
   of ``BUCKETS`` counts, a fixed size, summed over the tasks).
2. Variable-length prefixes.  A suffix belongs to its one-word prefix if that bucket has at most ``GROUP_SUFFIXES``
   suffixes, else to its two-word, else to its four-word, else to its whole path.  Equal paths are merged inside each
   chunk of documents: only the first of them goes to the group; the others are later repeats for certain and go
   straight to the bucket of their document (see 4), so copies spread over the buckets however many there are.
   Buckets are packed into groups of about ``GROUP_SUFFIXES`` suffixes.  A path that is too frequent at every length
   adds one suffix per chunk (about ``6 * CHUNK_WORDS`` bytes of text or one Arrow batch) to its group on top of that:
   partial minima of several chunks are not merged on the way.
3. Subtrees.  A group sorts its suffixes by path; every run of equal paths is a deep internal node, its first leaf (by
   document id, text key and place) stays, the other leaves are later repeats and go back to their documents.
4. Documents and their later repeats meet in as many buckets as there are groups, so a bucket's texts fit in memory
   too, and each document drops the words that its later repeats cover.

Suffixes travel as packed columns (8 bytes of path hash, about one byte of place); the text is shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blanks_split, parallelism, small_batches, stored, text_key, text_or_empty

MIN_WORDS = 20
BUCKETS = 1 << 16  # by the upper 16 bits of the prefix hash
GROUP_SUFFIXES = 1 << 21
CHUNK_WORDS = 1 << 19  # words whose windows a task holds at once
LADDER = (1, 2, 4)  # prefix lengths; the last resort is the whole path
MIX = np.uint64(0x9E3779B97F4A7C15)
ZSTD = "zstd"
NAMES = ["grp", "n_docs", "n", "ids", "known", "keys", "counts", "places", "paths"]
PACKED = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5


def _pack(values: np.ndarray) -> bytes:
    """Compressed by byte planes: the upper bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes), codec=ZSTD, asbytes=True)


def _unpack(data, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec=ZSTD, asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def _step(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * MIX
    return h ^ (h >> np.uint64(32))


class _Chunk:
    """The windows of some whole documents, in their order: ``doc`` (index of the document), ``place``, ``path`` and
    prefix buckets."""

    def __init__(self, texts, depth: int, paths: bool):
        digest, hashed = xxhash.xxh64_intdigest, []
        for t in texts:
            words = blanks_split(t)
            hashed.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        counts = np.fromiter(map(len, hashed), np.int64, len(hashed))
        flat = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        del hashed
        n_windows = np.maximum(counts - depth + 1, 0)
        total = int(n_windows.sum())
        self.doc = np.repeat(np.arange(len(counts), dtype=np.int32), n_windows)
        self.place = (np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)).astype(np.int32)
        at = self.place + np.repeat(np.cumsum(counts) - counts, n_windows)
        h = np.zeros(total, np.uint64)
        self.buckets = []
        for k in range(depth if paths else LADDER[-1]):
            if k < depth:
                h = _step(h, flat[at + k])
            if k + 1 in LADDER:
                self.buckets.append((h >> np.uint64(48)).astype(np.uint16))
        self.path = h
        while len(self.buckets) < len(LADDER):
            self.buckets.append(self.buckets[-1])


def _slices(batches, text_column: int):
    """Parts of the batches whose texts hold about CHUNK_WORDS words (or one longer text)."""
    for b in batches:
        if not len(b):
            continue
        sizes = np.array([len(t.as_buffer()) for t in b.column(text_column).cast(pa.binary())])
        start, ends = 0, np.cumsum(sizes)
        while start < len(b):
            done = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + CHUNK_WORDS * 6, side="right")))
            yield b.slice(start, end - start)
            start = end


def _texts(column):
    return (t.as_py() for t in column.cast(pa.binary()))


def prefix_counts(docs: DataFrame, min_words: int) -> list[np.ndarray]:
    """Suffixes by bucket of their prefixes of LADDER lengths; BUCKETS numbers per length reach the driver."""
    def run(batches):
        total = np.zeros((len(LADDER), BUCKETS), np.int64)
        for b in _slices(batches, 0):
            for k, at in enumerate(_Chunk(_texts(b.column(0)), min_words, False).buckets):
                total[k] += np.bincount(at, minlength=BUCKETS)
        level, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(bucket.astype(np.int32)),
                                          pa.array(total[level, bucket])], names=["level", "bucket", "n"])
    rows = docs.mapInArrow(run, "level int, bucket int, n bigint").groupBy("level", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(LADDER), BUCKETS), np.int64)
    out[rows["level"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return list(out)


def _groups(counts: list[np.ndarray], at_least: int) -> tuple[list[np.ndarray], int]:
    """Group of every bucket of every prefix length (-1: the prefix is too frequent, take a longer one), and how many."""
    total = int(counts[0].sum())
    n = max(at_least, -(-total // GROUP_SUFFIXES))
    limit = max(1, total // n)
    where = []
    for c in counts:
        # neighbouring buckets fill a group up to the limit; the lengths share the groups
        group = (np.cumsum(c) - c) // limit % n
        where.append(np.where(c > limit, -1, group).astype(np.int32))
    return where, n


def _later(doc_id_order: tuple, path: np.ndarray) -> np.ndarray:
    """True for every suffix whose path also starts earlier; doc_id_order: sort keys, last one first, as for lexsort."""
    order = np.argsort(path)
    p = path[order]
    same = np.zeros(len(p), bool)
    same[1:] = p[1:] == p[:-1]
    member = same.copy()
    member[:-1] |= same[1:]
    order = order[member]  # leaves of deep internal nodes only
    order = order[np.lexsort(tuple(k[order] for k in doc_id_order) + (path[order],))]
    p = path[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(p) else order  # the node's first leaf
    out = np.zeros(len(path), bool)
    for k in doc_id_order:  # a leaf that only repeats the first one's row is not another place
        out[order] |= k[order] != k[first]
    return out


def _opened(_, n_docs, n, ids, known, keys, counts, gaps, paths=b""):
    """(ids, known, keys, counts) of the documents of a packed row and its places and paths."""
    counts = _unpack(counts, n_docs, np.uint32).astype(np.int64)
    gaps = _unpack(gaps, n, np.uint32).astype(np.int64)
    run = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    place = run - np.repeat(run[first] - gaps[first], counts)
    return (np.cumsum(_unpack(ids, n_docs, np.int64)), _unpack(known, n_docs, np.bool_), _unpack(keys, n_docs, np.int64), counts,
            place.astype(np.uint32), np.frombuffer(paths, np.uint64))


def _bucket(ids: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a document; the same as ``bucket_of``, spread by id so that copies of a text do not meet."""
    return np.mod(ids ^ keys, n).astype(np.int32)


def bucket_of(id_col: str, key_col: str, n: int):
    return F.pmod(F.coalesce(F.col(id_col), F.lit(0)).bitwiseXOR(F.col(key_col)), F.lit(n)).cast("int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, id, key): ``key`` tells apart the documents that share an id, null included, by 64 bits of their text; it is 0
    where the id occurs once, so that it costs nothing on the way."""
    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(f"`{id_col}`").cast("bigint").alias("id"))
    often = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("often"), F.lit(True).alias("shared")), "shared-ids")
    rows = rows.join(often, rows["id"].eqNullSafe(often["often"]), "left")
    return rows.select("text", "id", F.when(F.col("shared"), text_key("text")).otherwise(F.lit(0)).cast("bigint").alias("key"))


def packed_suffixes(rows: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """From ``keyed`` rows, packed suffixes by group, and the number of groups.  Rows without paths hold the places that are later than another
    place in their own chunk; their group is the bucket of the document."""
    spark = rows.sparkSession
    small_batches(spark)
    where, n_groups = _groups(prefix_counts(rows.select("text"), min_words), parallelism(spark))
    plan = spark.sparkContext.broadcast(where)  # fixed size: one int per bucket and prefix length

    def split(batches):
        groups = plan.value
        for b in _slices(batches, 0):
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(1).fill_null(0).to_numpy()
            keys = b.column(2).to_numpy()
            order = np.lexsort((keys, ids, known))  # documents in order; rows that repeat an id and a text are one
            ids, keys, known = ids[order], keys[order], known[order]
            new = np.ones(len(order), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])
            ids, keys, known = ids[new], keys[new], known[new]
            chunk = _Chunk(_texts(b.column(0).take(pa.array(order[new]))), min_words, True)
            doc, place, path = chunk.doc, chunk.place, chunk.path
            if not len(path):
                continue
            group = np.full(len(doc), -1, np.int32)
            for table, bucket in zip(groups, chunk.buckets):
                group = np.where(group < 0, table[bucket], group)
            whole = group < 0
            group[whole] = (path[whole] % np.uint64(n_groups)).astype(np.int32)
            later = _later((place, doc), path)
            made = []
            for known_later in (False, True):  # later than another place in this chunk: decided, sent to its document
                to = _bucket(ids, keys, n_groups)[doc] if known_later else group
                sent = np.flatnonzero(later == known_later)
                small = to[sent].astype(np.int16) if n_groups < 1 << 15 else to[sent]
                sent = sent[np.argsort(small, kind="stable")]
                bounds = np.searchsorted(to[sent], np.arange(n_groups + 1))
                for g in np.flatnonzero(np.diff(bounds)):
                    at = sent[bounds[g]:bounds[g + 1]]
                    d, p = doc[at], place[at]
                    first = np.flatnonzero(np.diff(d, prepend=-1))
                    gaps = np.diff(p, prepend=0)
                    gaps[first] = p[first]
                    d = d[first]
                    made.append([g, len(d), len(at), _pack(np.diff(ids[d], prepend=0)), _pack(known[d]), _pack(keys[d]),
                                 _pack(np.diff(np.append(first, len(at))).astype(np.uint32)), _pack(gaps.astype(np.uint32)),
                                 b"" if known_later else path[at].tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*made), [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6)], names=NAMES)

    return rows.mapInArrow(split, "grp int, n_docs int, n bigint, ids binary, known binary, keys binary, counts binary, "
                                  "places binary, paths binary"), n_groups


def later_repeats(rows: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """From ``keyed`` rows, packed start places of the windows that also start earlier, by bucket of the document (``bucket_of``), and the number
    of buckets; a document's places may come in several rows."""
    packed, n_groups = packed_suffixes(rows, min_words)

    def opened(row):
        return _opened(*row)

    def subtree(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c] for c in NAMES)))
        rows = [[v.as_py() if k < 3 else v.as_buffer() for k, v in enumerate(r)] for r in rows]
        parts = [opened(r) for r in rows if len(r[8])]
        decided = [opened(r) for r in rows if not len(r[8])]  # later than a place in their own chunk, in this bucket
        found = [[np.repeat(p[k], p[3]) for k in range(3)] + [p[4]] for p in decided]
        if parts:
            counts = np.concatenate([p[3] for p in parts])
            doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            ids, known, keys = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
            rank = np.empty(len(ids), np.int32)  # documents in order, the same one in several parts once
            order = np.lexsort((keys, ids, known))
            ids, known, keys = ids[order], known[order], keys[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])
            rank[order] = np.cumsum(new) - 1
            ids, known, keys, doc = ids[new], known[new], keys[new], rank[doc]
            place, path = (np.concatenate([p[k] for p in parts]) for k in (4, 5))
            at = np.flatnonzero(_later((place, doc), path))
            found.append([ids[doc[at]], known[doc[at]], keys[doc[at]], place[at]])
        ids, known, keys, place = (np.concatenate([f[k] for f in found]) for k in range(4))
        made = list(packed_rows(_bucket(ids, keys, n_groups), ids, known, keys, place))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*made), PACKED)] if made else [pa.array([], t) for t in PACKED], names=NAMES[:8])

    def packed_rows(bucket, ids, known, keys, place):
        """Rows (bucket, n_docs, n, ids, known, keys, counts, places), one per bucket."""
        order = np.lexsort((place, keys, ids, known, bucket))
        bucket, ids, known, keys, place = bucket[order], ids[order], known[order], keys[order], place[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(bucket))):
            i, k, y, p = ids[lo:hi], known[lo:hi], keys[lo:hi], place[lo:hi].astype(np.int64)
            new = np.ones(hi - lo, bool)
            new[1:] = (i[1:] != i[:-1]) | (y[1:] != y[:-1]) | (k[1:] != k[:-1])
            first = np.flatnonzero(new)
            gaps = np.diff(p, prepend=0)
            gaps[first] = p[first]
            yield [int(bucket[lo]), len(first), int(hi - lo), _pack(np.diff(i[first], prepend=0)), _pack(k[first]), _pack(y[first]),
                   _pack(np.diff(np.append(first, hi - lo)).astype(np.uint32)), _pack(gaps.astype(np.uint32))]

    found = packed.groupBy("grp").applyInArrow(subtree, "bucket int, n_docs int, n bigint, ids binary, known binary, keys binary, "
                                                        "counts binary, places binary".replace("bucket", "grp"))
    return found.withColumnRenamed("grp", "bucket"), n_groups


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_words, n_removed, kept_text), kept_text the words left, joined by a blank.

    A word goes if a window of ``min_words`` words of its document that covers it also starts at an earlier place: a
    smaller id (null first; rows of one id in the order of their text key), or further up in the same document.  Windows
    are judged on the input.  Documents of fewer words lose nothing.  ``id_col`` is an integer column.
    """
    rows = keyed(docs, id_col, text_col)
    found, n_buckets = later_repeats(rows, min_words)
    rows = rows.select("id", "key", "text", bucket_of("id", "key", n_buckets).alias("bucket"))

    def cut(texts: pa.Table, parts: pa.Table) -> pa.Table:
        gone: dict = {}
        for row in zip(*(parts[c].to_pylist() for c in parts.column_names)):
            ids, known, keys, counts, place, _ = _opened(*row)
            ends = np.cumsum(counts)
            for i, ok, key, lo, hi in zip(ids.tolist(), known.tolist(), keys.tolist(), (ends - counts).tolist(), ends.tolist()):
                gone.setdefault((i if ok else None, key), []).append(place[lo:hi])
        out = []
        for i, key, t in zip(texts["id"], texts["key"], texts["text"].cast(pa.binary())):
            words = blanks_split(t.as_py())
            n, starts = len(words), gone.get((i.as_py(), key.as_py()))
            if starts:
                at = np.concatenate(starts).astype(np.int64)
                edge = np.bincount(at, minlength=n + 1) - np.bincount(at + min_words, minlength=n + 1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:n] == 0).tolist()]
            out.append((i.as_py(), n, n - len(words), b" ".join(words)))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                         pa.array(columns[3], pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept_text"])

    return rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(
        cut, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_text string")
