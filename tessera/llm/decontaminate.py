"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every training token: each row of the index is one segment, the postings
of about ``SEGMENT_WORDS`` words of consecutive documents (sorted term hashes, and for each term the sorted places).
A segment is written once in the shared folder and read by every search after it.

``find_matches`` takes the windows of the benchmark (a stated query set) in blocks of bounded size.  Per block the
corpus counts of its terms are summed over the segments; then, inside each segment, the offset-adjusted postings of a
window's rarest terms give the candidate starts, and the postings of the other terms, rarest first, are intersected
with them.  All terms in place: an exact phrase.  Enough terms within ``slack`` words of their place, counted from any
start: a proximity match.  If ``misses`` terms may be missing, one of the ``misses + 1`` rarest is there, so candidates
come from all of these, widened by ``slack``.  Matches leave the segment as merged runs per document and item; no
postings are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alnum_split, columns_of, small_batches, stored, text_key, text_or_empty, whole_rows

SEGMENT_WORDS = 1 << 18
SEGMENT_DOCS = 1 << 12
BLOCK_WINDOWS = 50_000  # benchmark windows searched at once (13 terms each: about 5 MB)
WINDOW = 13
SLACK = 4  # words a term may stand off its place in a proximity match
CANDIDATES = 1 << 18  # candidate starts held at once
NEAR_SHARE = 0.8  # share of a window's terms that a proximity match needs
HASH_SEED = 42


def _term_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, HASH_SEED) for w in words], np.uint64).view(np.int64)


def _segment(ids, keys, words, counts, gap):
    """One row of the index; places of different documents are ``gap`` words apart, so no window crosses them."""
    counts = np.array(counts, np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) + gap * np.arange(len(counts))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    terms = _term_hashes(coded.dictionary.to_pylist())
    order = np.argsort(terms, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.int32)
    places = np.arange(len(words), dtype=np.int64) + np.repeat(gap * np.arange(len(counts)), counts)
    places = places[np.argsort(codes, kind="stable")].astype(np.int32)
    ends = np.cumsum(np.bincount(codes, minlength=len(terms)))
    return [ids, keys, counts.tolist(), starts.astype(np.int32).tobytes(), terms[order].tobytes(),
            ends.astype(np.int32).tobytes(), places.tobytes()]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                slack: int = SLACK) -> DataFrame:
    """The stored index: rows (segment, ids, keys, counts, starts, terms, ends, places).  Documents longer than a
    segment make one of their own.  Null texts have no words."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    gap = window + 2 * slack + 1

    def run(batches):
        schema = None
        ids, keys, words, counts = [], [], [], []

        def flush():
            row = _segment(ids, keys, words, counts, gap)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema)], names=NAMES[1:])
        for b in batches:
            schema = [pa.list_(b.schema.types[0]), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.binary()] * 4
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                w = alnum_split(t.as_py())
                if ids and (len(words) + len(w) > SEGMENT_WORDS or len(ids) >= SEGMENT_DOCS):
                    yield flush()
                    ids, keys, words, counts = [], [], [], []
                ids.append(i)
                keys.append(k)
                words += w
                counts.append(len(w))
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col), text_key(text_col), text_or_empty(text_col))
    index = rows.mapInArrow(run, f"ids array<{id_type}>, keys array<bigint>, counts array<bigint>, starts binary, "
                                 "terms binary, ends binary, places binary")
    return stored(index.select(F.expr("uuid()").alias("segment"), *NAMES[1:]), "postings", block_mb=16)


NAMES = ["segment", "ids", "keys", "counts", "starts", "terms", "ends", "places"]


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(item, nth, terms): every window of every item as term hashes; an item of fewer words is one window, one
    without words none.  Repeated items give repeated windows, which do no harm."""
    item_type = items.schema[item_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0), b.column(1).cast(pa.binary())):
                h = _term_hashes(alnum_split(t.as_py()))
                n = max(len(h) - window + 1, 1) if len(h) else 0
                for s in range(0, n, 4096):
                    part = [h[j:j + window] for j in range(s, min(s + 4096, n))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i.as_py()] * len(part), b.schema.types[0]), pa.array(range(s, s + len(part)), pa.int64()),
                         pa.array(part, pa.list_(pa.int64()))], names=["item", "nth", "terms"])

    return items.select(F.col(item_col), text_or_empty(text_col)).mapInArrow(
        run, f"item {item_type}, nth bigint, terms array<bigint>")


class _Postings:
    """A segment row opened for search."""

    def __init__(self, starts, terms, ends, places):
        self.starts, self.terms = np.frombuffer(starts, np.int32), np.frombuffer(terms, np.int64)
        self.ends, self.places = np.frombuffer(ends, np.int32), np.frombuffer(places, np.int32)

    def find(self, wanted: np.ndarray):
        """Index of each wanted term, or -1."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def sizes(self, at: np.ndarray) -> np.ndarray:
        bounds = np.concatenate(([0], self.ends))
        return np.where(at < 0, 0, bounds[at + 1] - bounds[np.maximum(at, 0)])


TERM = 1 << 32  # distance of the postings of neighbouring terms in ``keys``; places are below 2 ** 31


def _check(keys, windows, w, start, within):
    """The starts of windows ``w`` with at most ``misses`` terms further than ``within`` words from their place: (w, start,
    whether all terms are in place, first and last place of a term that is there)."""
    at, offsets, sizes, misses = windows
    exact, missed = np.ones(len(w), bool), np.zeros(len(w), np.int16)
    low, high = np.full(len(w), TERM, np.int64), np.full(len(w), -1, np.int64)
    for k in range(at.shape[1]):
        if not len(w):
            break
        want = at[w, k] * TERM + start + offsets[w, k]  # a term that the segment lacks (-1) is far from every key
        j = np.searchsorted(keys, want)
        right, left = keys[np.minimum(j, len(keys) - 1)], keys[np.maximum(j - 1, 0)]
        nearest = np.where(np.abs(right - want) < np.abs(left - want), right, left)
        far, there = np.abs(nearest - want), k < sizes[w]
        place, near = nearest % TERM, there & (far <= within)
        low, high = np.where(near, np.minimum(low, place), low), np.where(near, np.maximum(high, place), high)
        exact &= (far == 0) | ~there
        missed += there & ~near
        left = missed <= misses[w]
        w, start, exact, missed, low, high = (x[left] for x in (w, start, exact, missed, low, high))
    return w, start, exact, low, high


def _distinct(w, start):
    both = np.unique(w * (2 * TERM) + (start + TERM // 2))  # starts are above -TERM / 2
    return both // (2 * TERM), both % (2 * TERM) - TERM // 2


def _intersect(seg: _Postings, windows, slack: int):
    """Parts (window, start, exact, first and last place) of the exact and proximity matches of all windows.  ``windows`` has
    the segment's index of every term (-1: not there) and its offset, one row per window, rarest term first, and for
    every window its number of terms and how many of them may be missing."""
    at, offsets, sizes, misses = windows
    counts = np.diff(seg.ends, prepend=0)
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * TERM + seg.places
    w, k = np.nonzero((at >= 0) & (np.arange(at.shape[1]) <= misses[:, None]) & (np.arange(at.shape[1]) < sizes[:, None]))
    lead = at[w, k]
    ends = np.cumsum(counts[lead])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
        nth = np.arange(lo, min(lo + CANDIDATES, int(ends[-1])))
        of = np.searchsorted(ends, nth, side="right")
        place = seg.places[seg.ends[lead[of]] - (ends[of] - nth)].astype(np.int64)
        # a start is within slack of a candidate, so its terms are within twice that of their place from there
        cand = _check(keys, windows, *_distinct(w[of], place - offsets[w[of], k[of]]), 2 * slack)
        shift = np.arange(-slack, slack + 1)
        got = _check(keys, windows, *_distinct(np.repeat(cand[0], len(shift)), (cand[1][:, None] + shift).ravel()), slack)
        if len(got[0]):
            yield got


def _merge(doc, item, first, last):
    """Union of overlapping or touching [first, last) per (doc, item)."""
    order = np.lexsort((first, item, doc))
    doc, item, first, last = doc[order], item[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] > last[:-1])
    at = np.flatnonzero(new)
    return doc[at], item[at], first[at], np.maximum.reduceat(last, at)


def find_matches(index: DataFrame, windows: DataFrame, slack: int = SLACK, near_share: float = NEAR_SHARE,
                 block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(segment, nth_doc, item, kind, first, last): merged runs of words [first, last) in the nth document of the
    segment; kind is ``exact`` or ``near``."""
    spark = index.sparkSession
    windows = stored(windows, "benchmark-windows")
    blocks = max(1, -(-windows.count() // block_windows))
    item_type = windows.schema["item"].dataType.simpleString()
    found = None
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("item", "nth"), F.lit(blocks)) == b).toArrow()
        items, terms = rows["item"].to_pylist(), [np.array(t, np.int64) for t in rows["terms"].to_pylist()]
        part = _search_block(index, items, rows.schema.field("item").type, terms, item_type, slack, near_share)
        found = part if found is None else found.unionByName(part)
    return found


def _search_block(index, items, arrow_type, terms, item_type, slack, near_share):
    spark = index.sparkSession
    flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    wanted = spark.sparkContext.broadcast(np.unique(flat))

    def count(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for b in batches:
            for terms_, ends in zip(*b.columns):
                seg = _Postings(b"", terms_.as_buffer(), ends.as_buffer(), b"")
                total += seg.sizes(seg.find(wanted.value))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted.value[at]), pa.array(total[at])], names=["term", "n"])

    # at most one row per term of the block reaches the driver
    counts = index.select("terms", "ends").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()
    freq = np.zeros(len(wanted.value), np.int64)
    freq[np.searchsorted(wanted.value, counts["term"].to_numpy())] = counts["n"].to_numpy()
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    nth, offsets = np.full((2, len(terms), int(sizes.max(initial=0))), -1, np.int64)  # terms as places in wanted, rarest first
    for n, t in enumerate(terms):
        at = np.searchsorted(wanted.value, t)
        order = np.lexsort((np.arange(len(t)), freq[at]))
        nth[n, :len(t)], offsets[n, :len(t)] = at[order], order
    misses = ((1 - near_share) * sizes + 1e-9).astype(np.int64)
    codes = np.unique([repr(i) for i in items], return_inverse=True)[1]
    by_code = dict(zip(codes.tolist(), items))
    plan = spark.sparkContext.broadcast((by_code, codes, nth, offsets, sizes, misses))

    def search(batches):
        by_code, codes, nth, offsets, sizes, misses = plan.value
        for b in batches:
            for segment, *arrays in zip(*b.columns):  # one segment at a time, not copied
                seg = _Postings(*(a.as_buffer() for a in arrays))
                if not nth.size or not len(seg.terms):
                    continue
                at = np.where(nth >= 0, seg.find(wanted.value)[nth], -1)
                got = list(_intersect(seg, (at, offsets, sizes, misses), slack))
                if not got:
                    continue
                w, start, exact, low, high = (np.concatenate(x) for x in zip(*got))
                # an exact match covers its window, a proximity match the words from its first to its last term
                for kind, which in (("exact", exact), ("near", ~exact)):
                    if not which.any():
                        continue
                    first, last = low[which], high[which] + 1
                    doc = np.searchsorted(seg.starts, first, side="right") - 1
                    doc, code, first, last = _merge(doc, codes[w[which]], first - seg.starts[doc], last - seg.starts[doc])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([segment.as_py()] * len(doc)), pa.array(doc.astype(np.int32)),
                         pa.array([by_code[c] for c in code.tolist()], arrow_type), pa.array([kind] * len(doc)),
                         pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64))],
                        names=["segment", "nth_doc", "item", "kind", "first", "last"])

    return index.select("segment", "starts", "terms", "ends", "places").mapInArrow(
        search, f"segment string, nth_doc int, item {item_type}, kind string, first bigint, last bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
                  text_col: str = "text", window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """One row per row of ``docs``: (id_col, text_key, n_words, n_hit, items, n_near_items, contaminated).

    ``n_hit`` counts the words inside any exact occurrence of a window, ``items`` are the benchmark ids whose windows
    occur (as sorted strings; a null id does not count), ``n_near_items`` the items with a proximity match only.
    A document is contaminated if a twentieth of its words or more are hit.  No benchmark: nothing is hit.
    """
    index = build_index(docs, id_col, text_col, window, slack)
    found = find_matches(index, benchmark_windows(benchmark, item_col, text_col, window), slack)
    runs = found.groupBy("segment", "nth_doc").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "exact", F.struct("first", "last")))).alias("runs"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "exact", F.col("item").cast("string")))).alias("items"),
        F.collect_set(F.when(F.col("kind") == "near", F.col("item").cast("string"))).alias("near"))
    covered = runs.select("segment", "nth_doc", "items", F.size(F.array_except("near", "items")).alias("n_near_items"), F.expr(
        "aggregate(runs, struct(0L as n, 0L as reach), (a, r) -> struct("
        "a.n + greatest(r.last - greatest(r.first, a.reach), 0L) as n, greatest(a.reach, r.last) as reach)).n").alias("n_hit"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "keys", "counts")).alias("nth_doc", "d")).select(
        "segment", "nth_doc", F.col("d.ids").alias(id_col), F.col("d.keys").alias("text_key"), F.col("d.counts").alias("n_words"))
    out = rows.join(covered, ["segment", "nth_doc"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(id_col, "text_key", "n_words", hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("n_near_items", F.lit(0)).cast("bigint").alias("n_near_items"),
                      ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows.  The list of those rows is stored, so that Spark plans the anti join by
    its real size."""
    bad = stored(contamination(docs, benchmark, id_col, item_col, text_col).where("contaminated").select(
        F.col(id_col).alias("__id"), F.col("text_key").alias("__key")), "contaminated")
    rows = docs.select(whole_rows(docs), F.col(f"`{id_col}`").alias("__doc"), text_key(text_col).alias("__row_key"))
    return rows.join(bad, rows["__doc"].eqNullSafe(bad["__id"]) & (rows["__row_key"] == bad["__key"]), "left_anti").select(*columns_of(docs))
