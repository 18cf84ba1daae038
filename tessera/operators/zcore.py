"""ZCore scores (I13, I14) and the exact medians they need; top-n selection by score (I15) is in select.py.

Our reading of the published method (the library body is not in the snapshot, so the
sampling law is a parameter): each draw picks ``sample_dim`` dimensions and a point in
their range (triangular between min, median and max, or uniform); the pool row nearest
to it (L1 in those dimensions) gets +1 coverage; the ``redund_nn`` rows nearest to that
covering row (same dimensions) lose a penalty with weights 1/d^redund_exp normalised to 1
(an exact duplicate takes the whole penalty).  Scores are min-max scaled to [0, 1].

Scale: draws come in numbered blocks, each from a generator seeded by its number, so any task makes the draws it needs
and none are sent.  The pool is cut into blocks by a hash of the row id and met with groups of draw blocks, as many
groups as the cluster has tasks for each pool block; one driver call plans the whole, whatever the number of draws.

1. Every (group, pool block) reports its nearest row per draw; a grouped ``min_by`` names the covering rows.
2. One pool block: its rows are all the neighbours, and the penalties are summed in the task.  Several: each reports the
   distances at ``RUNGS`` ranks up to its share of the neighbours; together they put the global reach of a draw between
   two bounds.  Rows nearer than the lower one are neighbours for sure and are only counted and weighed; the few between
   the bounds are merged by draw, which gives the exact reach and the sum of the weights.  With these each block sums its
   own penalties, so neighbour lists are never sent.
3. Credits and penalties are one ``groupBy(row_id)``.

A task takes the draws by their dimensions, and its rows in the order of a draw's first dimension: rows farther in that
dimension alone than a bound are never looked at.

I14 guards: constant dimensions are dropped first; if all are constant every score is 1;
the draw dimension is min(sample_dim, remaining dims).  (The reference ignores its
constructor's sample_dim and always uses 2 - our default is 2.)
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.session import cut_lineage

POOL_BLOCK = 1 << 16  # rows of a pool block
DRAW_BLOCK = 2000
BLOCKS_A_GROUP = 32  # at most: bounds the rows that a task reports
CELLS = 1 << 21  # distances held at once
RUNGS = 32  # distances that a block reports for a draw
CLOSE = 64  # rows on either side that give a first bound of the nearest
DIGIT = 11  # bits of a value that one pass of the median settles


# ---------------------------------------------------------------- exact medians
def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the floats (negative zero counts as zero)."""
    x = x + x.dtype.type(0)
    kind, top = (np.uint32, 31) if x.dtype == np.float32 else (np.uint64, 63)
    b = x.view(kind)
    sign = kind(1) << kind(top)
    return np.where(b & sign, ~b, b | sign)


def _float_of(bits: int, single: bool) -> float:
    kind, top = (np.uint32, 31) if single else (np.uint64, 63)
    sign = kind(1) << kind(top)
    b = kind(bits)
    return float((b ^ sign if b & sign else ~b).view(np.float32 if single else np.float64))


def dimension_stats(pool: DataFrame):
    """Rows of the pool and, per dimension, min, exact median and max.

    The two middle values of a dimension are found digit by digit: each pass counts, among the values that share the
    digits settled so far, the next ``DIGIT`` bits, and a window over those few counts picks the digit that holds the
    rank.  A pass returns two rows a dimension, so no task ever holds a dimension's values."""
    ends = pool.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()  # one row a dimension
    if not ends:
        return 0, np.zeros(0), np.zeros(0), np.zeros(0)
    d, n = len(ends), int(ends[0].n)
    single = isinstance(pool.schema["features"].dataType.elementType, T.FloatType)
    width = 32 if single else 64
    prefix = np.zeros((d, 2), np.uint64)  # settled bits of the two middle values
    rank = np.tile(np.array([(n - 1) // 2, n // 2], np.int64), (d, 1))
    for done in range(0, width, DIGIT):
        bits = min(DIGIT, width - done)
        shift, known = width - done - bits, prefix.copy()

        def count(it):
            total = np.zeros((d, 2, 1 << bits), np.int64)
            for pdf in it:
                if len(pdf):
                    x = np.concatenate(pdf["features"].to_numpy()).astype(np.float32 if single else np.float64).reshape(len(pdf), -1)
                    key = _ordered_bits(x).astype(np.uint64)
                    digit = (key >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                    above = key >> np.uint64(shift + bits) if done else np.zeros_like(key)
                    for i in range(d):
                        for k in range(2):
                            total[i, k] += np.bincount(digit[above[:, i] == known[i, k], i].astype(np.int64), minlength=1 << bits)
            i, k, at = total.nonzero()
            yield pd.DataFrame({"i": i, "k": k, "digit": at, "n": total[i, k, at]})

        counts = pool.select("features").mapInPandas(count, "i int, k int, digit int, n long").groupBy("i", "k", "digit").agg(F.sum("n").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("i", "k").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = F.element_at(F.lit([int(r) for r in rank.ravel()]), (F.col("i") * 2 + F.col("k") + 1).cast("int"))
        held = counts.withColumn("before", before).where((F.col("before") <= ranks) & (ranks < F.col("before") + F.col("n")))
        for r in held.collect():  # two rows a dimension
            prefix[r.i, r.k] = (prefix[r.i, r.k] << np.uint64(bits)) | np.uint64(r.digit)
            rank[r.i, r.k] -= r.before
    middle = np.array([[_float_of(int(b), single) for b in row] for row in prefix])
    return n, np.array([r.lo for r in ends], float), middle.mean(axis=1), np.array([r.hi for r in ends], float)


# ---------------------------------------------------------------- draws
class Draws:
    """All draws, by blocks: ``block(b)`` has the dimensions and the point of each draw of block b."""

    def __init__(self, n: int, lo, med, hi, sample_dim: int, seed: int, sampler: str, size: int = DRAW_BLOCK):
        self.n, self.size, self.seed, self.sampler = n, size, seed, sampler
        self.lo, self.med, self.hi = lo, med, hi
        self.keep = np.flatnonzero(hi > lo)
        self.dims = min(sample_dim, len(self.keep))
        self.blocks = -(-n // size)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        m = min(self.size, self.n - b * self.size)
        rng = np.random.default_rng(int(hashlib.md5(f"{self.seed}|{b}".encode()).hexdigest()[:8], 16))
        picks = np.zeros((m, 0), np.int64)
        for k in range(self.dims):  # without replacement: a place among those left, moved past the ones taken
            place = rng.integers(0, len(self.keep) - k, m)
            for taken in np.sort(picks, axis=1).T:
                place = place + (place >= taken)
            picks = np.column_stack((picks, place))
        dims = self.keep[picks]
        lo, hi = self.lo[dims], self.hi[dims]
        return dims, rng.triangular(lo, np.clip(self.med[dims], lo, hi), hi) if self.sampler == "triangular" else rng.uniform(lo, hi)


def _distances(x: np.ndarray, dims: np.ndarray, points: np.ndarray) -> np.ndarray:
    """L1 distance of every row (columns of ``x``) to each draw's point in its dimensions."""
    out = np.abs(x[dims[:, 0]] - points[:, :1])
    for k in range(1, dims.shape[1]):
        out += np.abs(x[dims[:, k]] - points[:, k:k + 1])
    return out


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row ids in order and their values, one row per dimension: the first of equal distances has the lowest id."""
    pdf = pdf.sort_values("row_id")
    return pdf["row_id"].to_numpy(), np.ascontiguousarray(V.stack(pdf["features"]).T)


class _Block:
    """Rows of a pool block, sought in the order of one dimension after another."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.x = _rows(pdf)
        self.rows = len(self.ids)

    def runs(self, dims: np.ndarray):
        """The places of the draws with equal dimensions, one choice of dimensions after another; the block is then in the
        order of the first, ``first`` its values there, ``others`` those of the other dimensions."""
        if not len(dims):
            return
        by = np.lexsort(dims.T[::-1])
        now = None
        for at in np.split(by, np.flatnonzero((dims[by[1:]] != dims[by[:-1]]).any(axis=1)) + 1):
            picked = dims[at[0]]
            if picked[0] != now:
                now = picked[0]
                self.order = np.argsort(self.x[now], kind="stable")
                self.first = self.x[now][self.order]
                self.place = np.empty(self.rows, np.int64)
                self.place[self.order] = np.arange(self.rows)
            self.others = [self.x[k][self.order] for k in picked[1:]]
            yield at

    def span(self, at: float, far: float) -> tuple[int, int]:
        """The rows at most ``far`` from ``at`` in the first dimension (a few more by rounding)."""
        far += 8 * np.finfo(float).eps * (abs(at) + far)
        return int(self.first.searchsorted(at - far, "left")), int(self.first.searchsorted(at + far, "right"))

    def dist(self, lo: int, hi: int, point: np.ndarray, own: int = -1) -> np.ndarray:
        """Distances of the rows from ``lo`` to ``hi``, infinite at the row ``own``."""
        out = np.abs(self.first[lo:hi] - point[0])
        for other, p in zip(self.others, point[1:]):
            out += np.abs(other[lo:hi] - p)
        if lo <= own < hi:
            out[own - lo] = np.inf
        return out


def _weights(dist: np.ndarray, power: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return 1.0 / np.square(np.square(dist)) if power == 4 else np.power(dist, -power)


def _bounds(rungs: np.ndarray, n: np.ndarray, step: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Per draw two bounds of the distance of its ``want``-th nearest row: at most ``want`` rows are nearer than the lower, and
    as many are within the upper.  ``rungs`` (draws x blocks x ranks) are the distances at every ``step``-th rank of a block's
    list (its last one where it ends before), ``n`` the lengths of the lists."""
    draws, blocks, ranks = rungs.shape
    rank = np.minimum(step * np.arange(1, ranks + 1), n[:, :, None])
    weight = np.diff(rank, axis=2, prepend=0).reshape(draws, -1)
    # beyond the end of a full list the block may have more rows
    last = np.where(n < step * ranks, np.inf, rungs[:, :, -1]).min(axis=1)
    v = rungs.reshape(draws, -1)
    order = np.argsort(v, axis=1)
    v, weight = np.take_along_axis(v, order, 1), np.take_along_axis(weight, order, 1)
    seen = np.cumsum(weight, axis=1)
    full = seen >= want
    high = np.where(full.any(axis=1), v[np.arange(draws), full.argmax(axis=1)], np.inf)
    sure = (seen - weight + blocks * step <= want) & (v <= last[:, None])
    return np.where(sure, v, -np.inf).max(axis=1), high


def _nearest_mask(dist: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row of ``dist`` (columns ascend by id), ties at the edge to the lowest id."""
    if k >= dist.shape[1]:
        return np.isfinite(dist)
    edge = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
    below, equal = dist < edge, dist == edge
    return (below | (equal & (np.cumsum(equal, axis=1) <= k - below.sum(axis=1, keepdims=True)))) & np.isfinite(dist)


def penalties(dist: np.ndarray, mask: np.ndarray, power: float) -> np.ndarray:
    """Each draw's penalty on each row: 1 / d^power over the masked rows, normalised; a duplicate takes it all."""
    d = np.where(mask, dist, np.inf)
    first = d.argmin(axis=1)
    zero = d[np.arange(len(d)), first] == 0
    with np.errstate(divide="ignore"):
        w = 1.0 / np.square(np.square(d)) if power == 4 else np.power(d, -power)
    w[zero] = 0.0
    w[zero, first[zero]] = 1.0
    total = w.sum(axis=1, keepdims=True)
    return w / np.where(total > 0, total, 1.0)


# ---------------------------------------------------------------- scores
def zcore_scores(pool: DataFrame, n_sample: int = 1_000_000, sample_dim: int = 2, redund_nn: int = 1000,
                 redund_exp: float = 4.0, seed: int = 0, batch: int = DRAW_BLOCK, sampler: str = "triangular",
                 pool_block: int = POOL_BLOCK) -> DataFrame:
    """(row_id, score) for every pool row."""
    n, lo, med, hi = dimension_stats(pool)
    if not (hi > lo).any():
        return pool.select("row_id", F.lit(1.0).alias("score"))
    draws = Draws(int(n_sample), lo, med, hi, sample_dim, seed, sampler, batch)
    parts = max(1, math.ceil(n / pool_block))
    tasks = pool.sparkSession.sparkContext.defaultParallelism
    groups = min(draws.blocks, max(math.ceil(tasks / parts), math.ceil(draws.blocks / BLOCKS_A_GROUP)))
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    base = pool.select("row_id", "features")
    cut = base.select("*", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int").alias("p"), every(groups, "g"))

    def chunks(rows: int, at: np.ndarray):
        step = max(1, CELLS // max(rows, 1))
        return (at[lo:lo + step] for lo in range(0, len(at), step))

    def drawn(g: int):
        """Numbers, dimensions and points of the draws of a group."""
        at = range(g, draws.blocks, groups)
        dims, points = (np.concatenate(c) for c in zip(*map(draws.block, at)))
        return np.concatenate([np.arange(b * draws.size, min((b + 1) * draws.size, draws.n)) for b in at]), dims, points

    def nearest(key, pdf):
        block, (number, dims, points) = _Block(pdf), drawn(int(key[0]))
        row, dist, cover = np.zeros(len(number), np.int64), np.zeros(len(number)), np.zeros(points.shape)
        for at in block.runs(dims):
            missing = np.isnan(block.x[dims[at[0]]]).any()
            for i, start in zip(at, block.first.searchsorted(points[at, 0])):
                p, lo, hi = points[i], 0, block.rows
                if not missing:
                    lo, hi = block.span(p[0], block.dist(max(start - CLOSE, 0), start + CLOSE, p).min())
                d = block.dist(lo, hi, p)
                dist[i] = d.min()
                best = block.order[lo:hi][np.isnan(d) if missing else d == dist[i]].min()
                row[i], cover[i] = block.ids[best], block.x[dims[i], best]
        return pd.DataFrame({"draw": number, "row_id": row, "dist": dist, "cover": list(cover)})

    near = cut.groupBy("g", "p").applyInPandas(nearest, "draw long, row_id long, dist double, cover array<double>")
    if parts > 1:
        near = near.groupBy("draw").agg(F.min_by(F.struct("row_id", "cover"), F.struct("dist", "row_id")).alias("w")).select("draw", "w.*")
    near = cut_lineage(near.select("draw", "row_id", "cover"))
    block = F.floor(F.col("draw") / draws.size)
    covers = near.select("*", (block % groups).cast("int").alias("g"))

    def covered(key, rows, won):
        """For each chunk of the group's draws: their numbers, the ids of the block's rows, and the distances to the covering
        rows (infinite at the covering row itself)."""
        ids, x = _rows(rows) if len(rows) else (np.zeros(0, np.int64), np.zeros((len(lo), 0)))
        won = won.sort_values("draw")
        number, own = won["draw"].to_numpy(), won["row_id"].to_numpy()
        point = V.stack(won["cover"])
        for b in np.unique(number // draws.size):
            here = np.flatnonzero(number // draws.size == b)
            dims = draws.block(int(b))[0][number[here] - b * draws.size]
            for at in chunks(len(ids), np.arange(len(here))):
                dist = _distances(x, dims[at], point[here[at]])
                mine = np.minimum(np.searchsorted(ids, own[here[at]]), max(len(ids) - 1, 0))
                if len(ids):
                    same = ids[mine] == own[here[at]]
                    dist[np.flatnonzero(same), mine[same]] = np.inf
                yield number[here[at]], ids, dist

    if parts == 1:
        def punish(key, rows, won):
            ids, total = np.sort(rows["row_id"].to_numpy()), np.zeros(len(rows))
            for _, _, dist in covered(key, rows, won):
                total += penalties(dist, _nearest_mask(dist, redund_nn), redund_exp).sum(axis=0)
            return pd.DataFrame({"row_id": ids, "s": -total})

        lost = cut.groupBy("g").cogroup(covers.groupBy("g")).applyInPandas(punish, "row_id long, s double")
    else:
        want = min(redund_nn, n - 1)
        share = math.ceil(want / parts)
        sizes = [r[0] for r in base.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(parts))).count().select("count").collect()]  # one row a block
        top = min(want, share + 4 * math.isqrt(share) + 16)
        if sum(min(top, m - 1) for m in sizes) < want:  # ids dealt very unevenly
            top = want
        step = math.ceil(top / RUNGS)
        top = step * RUNGS
        met = cut.groupBy("g", "p")
        spread = lambda df: df.select("*", every(parts, "p")).groupBy("g", "p")
        some = F.floor(F.col("draw") / F.lit(max(1, min(draws.size, CELLS // (RUNGS * parts))))).alias("some")  # draws merged at once

        def around(key, rows, won):
            """The block, and for each draw of the group its place in ``won`` (in the order of draws), its cover's point and the
            cover's place in the block (-1: not there)."""
            block, (number, dims, _) = _Block(rows), drawn(int(key[0]))
            dims = dims[np.searchsorted(number, won["draw"].to_numpy())]
            own, point = won["row_id"].to_numpy(), V.stack(won["cover"])
            mine = np.minimum(np.searchsorted(block.ids, own), block.rows - 1)
            there = block.ids[mine] == own
            return block, point, ((i, point[i], int(block.place[mine[i]]) if there[i] else -1) for at in block.runs(dims) for i in at)

        def ladder(key, rows, won):
            """Distances at every ``step``-th rank of the block's nearest rows, and how many these are."""
            if not len(rows):
                return pd.DataFrame({"draw": [], "rungs": [], "n": []})
            won = won.sort_values("draw")
            rungs, count = np.full((len(won), RUNGS), np.inf), np.zeros(len(won), np.int64)
            block, _, each = around(key, rows, won)
            half = top + math.isqrt(2 * top * block.rows)
            for i, p, own in each:
                start = int(block.first.searchsorted(p[0]))
                a, z = max(start - half, 0), min(start + half, block.rows)
                d, far = block.dist(a, z, p, own), np.inf
                if len(d) > top:
                    far = np.partition(d, top - 1)[top - 1]
                lo, hi = block.span(p[0], far) if far < np.inf else (0, block.rows)
                if lo < a or hi > z:
                    d = block.dist(lo, hi, p, own)
                d = np.sort(d[(d <= far) & np.isfinite(d)])[:top]
                if len(d):
                    count[i], rungs[i] = len(d), d[np.minimum(step * np.arange(1, RUNGS + 1), len(d)) - 1]
            return pd.DataFrame({"draw": won["draw"].to_numpy(), "rungs": list(rungs), "n": count})

        def bounded(pdf):
            pdf = pdf.sort_values("draw")
            draw, count = np.unique(pdf["draw"].to_numpy(), return_counts=True)
            low, high = _bounds(V.stack(pdf["rungs"]).reshape(len(draw), count[0], RUNGS), pdf["n"].to_numpy().reshape(len(draw), -1), step, want)
            return pd.DataFrame({"draw": draw, "low": low, "high": high})

        reached = met.cogroup(spread(covers)).applyInPandas(ladder, "draw long, rungs array<double>, n long")
        bound = reached.groupBy(some).applyInPandas(bounded, "draw long, low double, high double")

        def between(key, rows, won):
            """The block's rows between the bounds of each draw; how many are nearer and their weight; the first duplicate."""
            names = ["draw", "ids", "dist", "n", "w", "zero"]
            if not len(rows):
                return pd.DataFrame({c: [] for c in names})
            won = won.sort_values("draw")
            low, high, draw = won["low"].to_numpy(), won["high"].to_numpy(), won["draw"].to_numpy()
            block, _, each = around(key, rows, won)
            out = []
            for i, p, own in each:
                lo, hi = block.span(p[0], high[i]) if high[i] < np.inf else (0, block.rows)
                d, at = block.dist(lo, hi, p, own), block.order[lo:hi]
                sure, edge = d < low[i], np.flatnonzero((d >= low[i]) & (d <= high[i]) & np.isfinite(d))
                held = int(sure.sum())
                if len(edge) > want - held:  # the block's first ones will do
                    edge = edge[np.lexsort((at[edge], d[edge]))[:want - held]]
                zero = at[d == 0]
                out.append((draw[i], block.ids[at[edge]], d[edge], held, _weights(d[sure], redund_exp).sum(), block.ids[zero.min()] if len(zero) else None))
            return pd.DataFrame(out, columns=names).astype({"zero": "Int64"})

        def settled(pdf):
            """Per draw: the distance of the last neighbour, its id, how many rows of that id at that distance count, the sum of the
            weights, and the first duplicate, which takes the whole penalty."""
            draw, own = np.unique(pdf["draw"].to_numpy(), return_inverse=True)
            left = want - np.bincount(own, pdf["n"]).astype(np.int64)
            place = np.repeat(own, pdf["ids"].map(len))
            ids = np.concatenate([np.asarray(a, np.int64) for a in pdf["ids"]])
            dist = np.concatenate([np.asarray(a, np.float64) for a in pdf["dist"]])
            order = np.lexsort((ids, dist, place))
            place, ids, dist = place[order], ids[order], dist[order]
            count = np.bincount(place, minlength=len(draw))
            start = np.cumsum(count) - count
            taken = np.arange(len(place)) - start[place] < left[place]
            total = np.bincount(own, pdf["w"], len(draw)) + np.bincount(place[taken], _weights(dist[taken], redund_exp), len(draw))
            some_taken = np.minimum(left, count) > 0
            end = np.where(some_taken, start + np.minimum(left, count) - 1, 0)
            low = np.full(len(draw), -np.inf)
            low[own] = pdf["low"]
            edge = np.where(some_taken, dist[end], low) if len(dist) else low
            last = np.where(some_taken, ids[end], 0) if len(ids) else np.zeros(len(draw), np.int64)
            tied = taken & (ids == last[place]) & (dist == edge[place])
            zero = pdf.groupby("draw")["zero"].min().astype("Int64").to_numpy()
            return pd.DataFrame({"draw": draw, "edge": edge, "last": last, "copies": np.bincount(place[tied], minlength=len(draw)), "total": total,
                                 "zero": pd.array(zero, "Int64")})

        ends = cut_lineage(covers.join(bound, "draw"))
        lists = met.cogroup(spread(ends)).applyInPandas(between, "draw long, ids array<long>, dist array<double>, n long, w double, zero long")
        merged = lists.join(ends.select("draw", "low"), "draw").groupBy(some).applyInPandas(
            settled, "draw long, edge double, last long, copies long, total double, zero long")
        merged = cut_lineage(covers.join(merged, "draw"))

        def punish(key, rows, won):
            if not len(rows):
                return pd.DataFrame({"row_id": [], "s": []})
            won = won.sort_values("draw")
            edge, last, copies, total = (won[c].to_numpy() for c in ("edge", "last", "copies", "total"))
            block, _, each = around(key, rows, won)
            lost = np.zeros(block.rows)
            for i, p, own in each:
                if not np.isfinite(edge[i]) or not total[i] > 0:
                    continue
                lo, hi = block.span(p[0], edge[i])
                d, at = block.dist(lo, hi, p, own), block.order[lo:hi]
                keep = d < edge[i]
                tied = np.flatnonzero(d == edge[i]) if copies[i] else np.zeros(0, np.int64)
                if len(tied):
                    own_ids = block.ids[at[tied]]
                    keep[tied[own_ids < last[i]]] = True
                    keep[tied[own_ids == last[i]][:copies[i]]] = True
                lost[at[keep]] += _weights(d[keep], redund_exp) / total[i]
            return pd.DataFrame({"row_id": block.ids, "s": -lost})

        lost = met.cogroup(spread(merged.where("zero is null"))).applyInPandas(punish, "row_id long, s double").unionByName(
            merged.where("zero is not null").select(F.col("zero").alias("row_id"), F.lit(-1.0).alias("s")))
    credits = near.select("row_id", F.lit(1.0).alias("s")).unionByName(lost).groupBy("row_id").agg(F.sum("s").alias("s"))
    raw = cut_lineage(base.select("row_id").join(credits, "row_id", "left").fillna(0.0, subset=["s"]))
    low, high = raw.agg(F.min("s"), F.max("s")).first()
    return raw.select("row_id", ((F.col("s") - F.lit(low)) / F.lit((high - low) or 1.0)).alias("score"))
