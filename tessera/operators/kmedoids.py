"""K-medoids selection (I6-I11) on a pool (row_id long, features array<float>).

Scale design
------------
* Distances are never materialised as an n x n table.  The pool is packed once into
  blocks of bytes, many rows in one, so that a pass moves bytes instead of lists.  Every
  pass streams the blocks through ``mapInArrow`` and compares them with a *bounded*
  broadcast block (the k medoids); the block size is checked (``vectors.check_broadcast``).
  A pass is one job: partitions add up their rows, the driver a bounded number of results
  (``STATES``), and tasks those of more partitions before (``_gathered``).
* Seeding (k-medoids++, I9): greedy D^2 sampling with ``2 + ln k`` local trials
  per round.  Candidates are drawn with exponential keys ``-ln(u) / D^2`` (u is
  the seeded hash of the row); each partition sends its lowest few, not its rows.  The
  nearest-medoid distance column is carried from round to round and cut with a
  reliable checkpoint every ``checkpoint_every`` rounds.
* Update (I10, alternate / Voronoi iteration): the new medoid of a cluster is the
  member with the least summed distance to the other members.
  - cosine: the sum is n - x.(sum of members), exact in one linear pass;
  - euclidean: exact with pruning.  The sum is at least n |x - mean| (triangle
    inequality); members whose bound is not below the best sum found so far cannot
    win.  In large pools the bound is also taken from the second moments of the cluster
    (close where distances are alike, as in many dimensions) and from the means of cells
    (close in few dimensions).  A bounded number of candidates is broadcast and meets
    the members where they are; more meet the members of their cluster in blocks of up
    to ``TILE`` rows on the executors.  Partial sums are added by a grouped sum and at
    most ``HELD`` distances are held at once.  No candidate cap, no pair rows.
* Python workers take ``FEW`` rows of an Arrow batch at a time, so that full batches of a
  large pool need no more memory than the small ones of a small pool.
* The assignment is recomputed from the pool and the medoid ids each iteration,
  so lineage never grows with the number of iterations.  The pool itself is dealt
  over the cluster and checkpointed once.
"""

from __future__ import annotations

import math
import pickle
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.functions.hashing import TWO_POW_32, seeded_order
from tessera.session import cut_lineage

KEY = "row_id"
VEC = "features"
HIST_BUCKETS = 1024        # radius histogram per cluster for the reverse-triangle bound
TILE, TILE_LEAST = 1 << 15, 1 << 11  # rows of a block of candidates or members
HELD = (256, 1024)         # distances held at once: candidates x members
FEW = 1 << 11              # rows of an Arrow batch that a task works on at once
SENT = 1 << 20             # values of candidates, or of cells' means, that are broadcast
FEW_PAIRS = 1 << 27        # distances that are not worth a second bound
CELL_PAIRS = 32            # distances that cost less than a value in the sums of a cell
WIDEST = 4                 # coordinates over which cells are laid
PART_ROWS = 500_000        # rows of a partition of a large pool
PART_VALUES = 1 << 22      # and values of their vectors: what a Python worker gets at once
BLOCK = 1 << 17            # values of the vectors in a block of a packed pool
STATES = 1 << 23           # values of partial results that the driver adds up
BLOCKS = "rows int, dims int, ids binary, vecs binary"  # a packed pool: vectors of many rows in one


def _prep(pool: DataFrame, key: str, vec: str) -> DataFrame:
    return pool.select(F.col(key).cast("long").alias(KEY), F.col(vec).alias(VEC))


def _few(frames):
    """The rows of the frames, at most ``FEW`` at a time: what a Python worker holds does not grow with the batches it gets."""
    for pdf in frames:
        for lo in range(0, len(pdf), FEW):
            yield pdf.iloc[lo:lo + FEW]


def _is_packed(pool) -> bool:
    return "vecs" in getattr(pool, "columns", ())


def _vectors(col: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a table of its own type."""
    flat, wide = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if col.null_count or (wide != wide[:1]).any():
        raise ValueError("vectors must be there and of one length")
    return flat.reshape(len(col), wide[0] if len(col) else 0)


def _blocks_of(ids: np.ndarray, x: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """The rows as one row of bytes."""
    held = {"rows": pa.array([x.shape[0]], pa.int32()), "dims": pa.array([x.shape[1]], pa.int32())}
    for name, v in {"ids": ids, "vecs": x, **more}.items():
        held[name] = pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(list(held.values()), names=list(held))


def _packed(pool: DataFrame) -> DataFrame:
    """The pool with many rows in one, so that a pass over it moves bytes instead of values."""
    def fn(batches):
        for batch in batches:
            if batch.num_rows:
                if batch.column(KEY).null_count:
                    raise ValueError("rows without a key")
                ids, x = batch.column(KEY).to_numpy(zero_copy_only=False), _vectors(batch.column(VEC))
                step = max(FEW, BLOCK // x.shape[1])
                for lo in range(0, len(x), step):
                    yield _blocks_of(ids[lo:lo + step], x[lo:lo + step])
    return pool.select(KEY, VEC).mapInArrow(fn, BLOCKS)


def _block(batch: pa.RecordBatch, at: int) -> dict[str, np.ndarray]:
    """The columns of a block, as they lie in the batch."""
    n, d = batch.column("rows")[at].as_py(), batch.column("dims")[at].as_py()
    raw = {c: batch.column(c)[at].as_buffer() for c in batch.schema.names if c not in ("rows", "dims", "least")}
    held = {c: np.frombuffer(v, {"ids": np.int64, "cluster": np.int32}.get(c, np.float64)) for c, v in raw.items() if c != "vecs"}
    return held | {"vecs": np.frombuffer(raw["vecs"], np.float32 if raw["vecs"].size == 4 * n * d else np.float64).reshape(n, d)}


def _chunks(batches):
    """(ids, vectors, clusters, distances) of the rows of a pool or of assigned rows, packed or not, a bounded number at a time.
    What the rows don't have is None, and the cluster 0."""
    for batch in batches:
        if "vecs" in batch.schema.names:
            for at in range(batch.num_rows):
                b = _block(batch, at)
                yield b["ids"], b["vecs"].astype(np.float64), b.get("cluster", np.zeros(len(b["ids"]), np.int32)), b.get("dist")
            continue
        for lo in range(0, batch.num_rows, FEW):
            part = batch.slice(lo, FEW)
            b = {c: part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names if c != VEC}
            x = _vectors(part.column(VEC)).astype(np.float64)
            yield b.get(KEY), x, b.get("cluster", np.zeros(len(x), np.int32)), b.get("dist")


def _groups(cl: np.ndarray):
    """Each cluster of a chunk with its rows: a slice where clusters lie one after the other, as in the blocks of ``assign``."""
    order = None if (cl[1:] >= cl[:-1]).all() else np.argsort(cl, kind="stable")
    own = cl if order is None else cl[order]
    ends = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for lo, hi in zip(ends[:-1], ends[1:]):
        if hi > lo:
            yield int(own[lo]), slice(lo, hi) if order is None else order[lo:hi]


def _rows(pool: DataFrame) -> DataFrame:
    """A row per row of a packed pool, with the cluster and the bound where it has them."""
    if not _is_packed(pool):
        return pool
    more = {c: kind for c, kind in (("cluster", "int"), ("lb", "double")) if c in pool.columns}

    def fn(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                b = _block(batch, at)
                for lo in range(0, len(b["ids"]), FEW):
                    x = b["vecs"][lo:lo + FEW].astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(b["ids"][lo:lo + FEW]), lists, *[pa.array(b[c][lo:lo + FEW]) for c in more]], names=[KEY, VEC, *more])
    return pool.mapInArrow(fn, ", ".join([f"{KEY} long", f"{VEC} array<float>", *[f"{c} {kind}" for c, kind in more.items()]]))


def _gathered(frame: DataFrame, fold, merge, values: int):
    """What ``fold`` makes of the chunks of each partition, put together by ``merge``; None for an empty frame.  ``values``: about
    how many numbers one has.  The driver gets ``STATES`` numbers or two results at most, tasks merge the others before."""
    def fn(batches):
        got = fold(_chunks(batches))
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(got)], pa.binary())], names=["part", "state"])

    def together(states):
        out = None
        for s in states:
            out = pickle.loads(s) if out is None else merge(out, pickle.loads(s))
        return out
    states, most = frame.mapInArrow(fn, "part long, state binary"), max(2, min(4096, STATES // max(1, values)))
    if frame.rdd.getNumPartitions() > most:
        states = states.groupBy((F.col("part") % most).alias("part")).applyInPandas(
            lambda own: pd.DataFrame({"part": own["part"].iloc[:1], "state": [pickle.dumps(together(own.sort_values("part")["state"]))]}), "part long, state binary")
    return together(r["state"] for r in sorted(states.toArrow().to_pylist(), key=lambda r: r["part"]))


def _fetch(pool: DataFrame, ids: list[int]) -> np.ndarray:
    """Vectors of a bounded id list (k medoids), in the order of ids."""
    V.check_broadcast(len(ids), 1)
    if _is_packed(pool):
        def fold(chunks):
            return {int(own[i]): x[i] for own, x, _, _ in chunks for i in np.flatnonzero(np.isin(own, ids))}
        by_id = _gathered(pool, fold, lambda a, b: a | b, len(ids))
        return np.vstack([by_id[i] for i in ids])
    rows = pool.filter(F.col(KEY).isin(ids)).select(KEY, VEC).collect()
    by_id = {r[KEY]: np.asarray(r[VEC], dtype=np.float64) for r in rows}
    return np.vstack([by_id[i] for i in ids])


def _prepare_block(m: np.ndarray, metric: str) -> np.ndarray:
    return V.normalise(m) if metric == "cosine" else m


# ---------------------------------------------------------------- I6: pairwise distances of a bounded block
def distances_to(pool: DataFrame, ids: list[int], metric: str = "euclidean") -> DataFrame:
    """(row_id, target_id, dist) of every pool row to a bounded list of target rows."""
    sc = pool.sparkSession.sparkContext
    m = _prepare_block(_fetch(pool, ids), metric)
    V.check_broadcast(*m.shape)
    b = sc.broadcast((np.asarray(ids, dtype=np.int64), m))

    def fn(it):
        tid, mm = b.value
        for pdf in _few(it):
            x = V.stack(pdf[VEC])
            x = V.normalise(x) if metric == "cosine" else x
            d = V.pairwise(x, mm, metric)
            yield pd.DataFrame({KEY: np.repeat(pdf[KEY].to_numpy(), len(tid)),
                                "target_id": np.tile(tid, len(pdf)), "dist": d.ravel()})
    return pool.mapInPandas(fn, "row_id long, target_id long, dist double")


# ---------------------------------------------------------------- assignment
def assign(pool: DataFrame, medoid_ids: list[int], metric: str = "euclidean",
           medoid_vectors: np.ndarray | None = None) -> DataFrame:
    """Nearest medoid per row: (row_id, features, cluster, dist); ties -> lowest cluster index."""
    sc = pool.sparkSession.sparkContext
    m = medoid_vectors if medoid_vectors is not None else _fetch(pool, medoid_ids)
    m = _prepare_block(m, metric)
    V.check_broadcast(*m.shape)
    b = sc.broadcast(m)

    if _is_packed(pool):
        def blocks(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    held = _block(batch, at)
                    x, cl, dist = held["vecs"].astype(np.float64), np.zeros(len(held["ids"]), np.int32), np.zeros(len(held["ids"]))
                    for lo in range(0, len(x), FEW):
                        d = V.pairwise(V.normalise(x[lo:lo + FEW]) if metric == "cosine" else x[lo:lo + FEW], b.value, metric)
                        cl[lo:lo + FEW] = d.argmin(1)
                        dist[lo:lo + FEW] = d[np.arange(len(d)), cl[lo:lo + FEW]]
                    by = np.argsort(cl, kind="stable")
                    yield _blocks_of(held["ids"][by], held["vecs"][by], cluster=cl[by], dist=dist[by])
        return pool.mapInArrow(blocks, f"{BLOCKS}, cluster binary, dist binary")

    def fn(it):
        mm = b.value
        for pdf in _few(it):
            x = V.stack(pdf[VEC])
            xn = V.normalise(x) if metric == "cosine" else x
            d = V.pairwise(xn, mm, metric)
            j = d.argmin(1)
            yield pd.DataFrame({KEY: pdf[KEY].to_numpy(), VEC: pdf[VEC], "cluster": j.astype(np.int32),
                                "dist": d[np.arange(len(j)), j]})
    return pool.mapInPandas(fn, "row_id long, features array<float>, cluster int, dist double")


# ---------------------------------------------------------------- seeding: random (I7), heuristic (I8), k-medoids++
def init_random(pool: DataFrame, k: int, seed: int) -> list[int]:
    """K distinct rows in seeded hash order."""
    rows = _rows(pool).select(KEY).orderBy(seeded_order(seed, F.col(KEY)), F.col(KEY)).limit(k).collect()
    return [r[KEY] for r in rows]


def _cluster_sums(assigned: DataFrame, metric: str, k: int, with_cost: bool = False, with_ends: bool = False):
    """Per cluster: member count, sum of member vectors (normalised for cosine) and, with
    ``with_cost``, the summed assignment distance, with ``with_ends`` also the ends of the coordinates.  Each partition adds up its rows, and the driver
    gets a bounded number of k x (d + 2) sums whatever the number of partitions: one pass."""
    def fold(chunks):
        acc = {}
        for _, x, cl, dist in chunks:
            x = V.normalise(x) if metric == "cosine" else x
            for c, at in _groups(cl):
                own = x[at]
                new = np.concatenate(([len(own), dist[at].sum() if dist is not None else 0.0], own.sum(0))), own.min(0), own.max(0)
                acc[c] = add(acc[c], new) if c in acc else new
        return acc or None

    def add(a, b):
        return a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])
    sums = _gathered(assigned, fold, lambda a, b: a | b | {c: add(a[c], b[c]) for c in a.keys() & b.keys()}, 256 * k) or {}
    d = max((len(v[1]) for v in sums.values()), default=0)
    values, ends = np.zeros((k, d + 2)), np.zeros((2, k, d))
    for c, v in sums.items():
        values[c], ends[0, c], ends[1, c] = v
    n, cost, s = np.rint(values[:, 0]).astype(np.int64), values[:, 1], values[:, 2:]
    return (n, s, cost, ends) if with_ends else (n, s, cost) if with_cost else (n, s)


def _spread(assigned: DataFrame, n: np.ndarray, s: np.ndarray, moments: bool = False) -> dict[str, np.ndarray]:
    """Per cluster, in one pass: the member farthest from the mean (``far``, at ``r``), the ``low`` and ``high`` ends of the
    coordinates and, with ``moments``, the sums that ``_Moments`` needs."""
    k, d = s.shape
    if not np.isfinite(s).all():
        raise ValueError("vectors with missing values")
    bm = assigned.sparkSession.sparkContext.broadcast(s / np.maximum(n, 1)[:, None])
    upper = np.triu_indices(d)

    def fold(chunks):
        mu, out = bm.value, None
        for ids, x, cl, _ in chunks:
            if out is None:
                out = {"r": np.full(k, -1.0), "id": np.zeros(k, np.int64), "far": np.zeros((k, d)), "low": np.full((k, d), np.inf),
                       "high": np.full((k, d), -np.inf), "sums": np.zeros((k, 2 + d + len(upper[0]) if moments else 0))}
            for c, at in _groups(cl):
                own, key = x[at], ids[at]
                v = own - mu[c]
                q = (v * v).sum(1)
                i = np.flatnonzero(q == q.max())
                i = i[np.argmax(key[i])]
                r = np.linalg.norm(v[i])
                if (r, key[i]) > (out["r"][c], out["id"][c]):
                    out["r"][c], out["id"][c], out["far"][c] = r, key[i], own[i]
                out["low"][c], out["high"][c] = np.minimum(out["low"][c], own.min(0)), np.maximum(out["high"][c], own.max(0))
                if moments:
                    out["sums"][c] += np.concatenate(([q.sum(), q @ q], q @ v, (v.T @ v)[upper]))
        return out

    def merge(a, b):
        more = (b["r"] > a["r"]) | ((b["r"] == a["r"]) & (b["id"] > a["id"]))
        return {"r": np.maximum(a["r"], b["r"]), "id": np.where(more, b["id"], a["id"]), "far": np.where(more[:, None], b["far"], a["far"]),
                "low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"]), "sums": a["sums"] + b["sums"]}
    got = _gathered(assigned, fold, merge, k * (3 + 3 * d + (2 + d + len(upper[0]) if moments else 0)))
    for c in np.flatnonzero(n == 0):
        got["r"][c], got["low"][c], got["high"][c] = 0.0, 0.0, 0.0
    return got


def _corners(n: np.ndarray, s: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """What ``_spread`` tells, from the ends of the coordinates only: the low corner is the far point."""
    mu = s / np.maximum(n, 1)[:, None]
    reach = np.linalg.norm(np.maximum(ends[1] - mu, mu - ends[0]), axis=1)
    return {"r": np.maximum(reach, np.linalg.norm(ends[1] - ends[0], axis=1) / 2), "far": ends[0], "low": ends[0], "high": ends[1]}


class _Reverse:
    """Lower bound of S(x) = sum over members y of |x - y| for every member x (euclidean): the maximum of
      n |x - mu|                                  (triangle inequality on the sum), and
      sum_y | |x - a| - |y - a| |  for anchors a   (reverse triangle inequality).
    Anchors per cluster: the mean and the member farthest from it, or a corner of the cluster (in near-1-D
    clusters the second makes the bound almost exact).  Each reverse bound is exact over the other buckets
    of a per-(cluster, anchor) distance histogram (k x 2 x HIST_BUCKETS counts and sums on the
    driver) and counts 0 inside x's own bucket."""

    def __init__(self, n, s, spread):
        self.n, self.anchors = n.astype(np.float64), np.stack((s / np.maximum(n, 1)[:, None], spread["far"]), 1)
        # |x - mu| <= r and |x - far| <= |x - mu| + |mu - far| <= 2 r: fixed ranges, no extra pass
        hi = np.stack((spread["r"], 2.0 * spread["r"]), 1)
        self.width = np.where(hi > 0, hi / HIST_BUCKETS, 1.0)

    def measured(self, cl, x):
        """Distance to both anchors and bucket of that distance."""
        d = np.stack([np.linalg.norm(x - self.anchors[cl, j], axis=1) for j in (0, 1)], 1)
        return d, np.clip(np.floor(d / self.width[cl]), 0, HIST_BUCKETS - 1).astype(int)

    def start(self):
        return np.zeros((len(self.n), 2, 2, HIST_BUCKETS))

    def add(self, t, cl, x):
        d, bk = self.measured(cl, x)
        for j in (0, 1):
            at = (cl.astype(np.int64) * 4 + 2 * j) * HIST_BUCKETS + bk[:, j]
            np.add.at(t.reshape(-1), at, 1.0)
            np.add.at(t.reshape(-1), at + HIST_BUCKETS, d[:, j])

    def finish(self, t):
        cnt, sd = t[:, :, 0], t[:, :, 1]
        c_below, s_below = np.cumsum(cnt, 2) - cnt, np.cumsum(sd, 2) - sd
        c_above, s_above = cnt.sum(2, keepdims=True) - np.cumsum(cnt, 2), sd.sum(2, keepdims=True) - np.cumsum(sd, 2)
        self.slope, self.base = c_below - c_above, s_above - s_below

    def lower(self, cl, x):
        d, bk = self.measured(cl, x)
        lb = self.n[cl] * d[:, 0]
        for j in (0, 1):
            lb = np.maximum(lb, d[:, j] * self.slope[cl, j, bk[:, j]] + self.base[cl, j, bk[:, j]])
        return lb


def _sent(frame: DataFrame, value):
    """Broadcasts objects of this module; executors need no copy of it."""
    return frame.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def _tables(assigned: DataFrame, bounds: list) -> None:
    """Gathers in one pass what the bounds count over the members."""
    b = _sent(assigned, bounds)

    def fold(chunks):
        own, held = pickle.loads(b.value), None
        for _, x, cl, _ in chunks:
            held = held or [bound.start() for bound in own]
            for bound, t in zip(own, held):
                bound.add(t, cl, x)
        return held
    got = _gathered(assigned, fold, lambda a, c: [x + y for x, y in zip(a, c)], sum(bound.start().size for bound in bounds))
    for bound, t in zip(bounds, got):
        bound.finish(t)


def _with_bounds(cands: DataFrame, bounds: list) -> DataFrame:
    """The candidates with the largest of the bounds, and of ``lb`` if they have one."""
    b = _sent(cands, bounds)

    def fn(it):
        own = pickle.loads(b.value)
        for pdf in _few(it):
            cl, x = pdf["cluster"].to_numpy(), V.stack(pdf[VEC])
            lb = pdf["lb"].to_numpy().copy() if "lb" in pdf else np.zeros(len(pdf))
            for bound in own:
                lb = np.fmax(lb, bound.lower(cl, x))
            yield pd.DataFrame({KEY: pdf[KEY].to_numpy(), VEC: pdf[VEC], "cluster": cl, "lb": lb})
    return cands.select(KEY, VEC, "cluster", *[c for c in ("lb",) if c in cands.columns]).mapInPandas(
        fn, "row_id long, features array<float>, cluster int, lb double")


def _lower_bounds(assigned: DataFrame, n: np.ndarray, s: np.ndarray, metric: str) -> DataFrame:
    """Lower bound of the summed distance of every member to its cluster (``_Reverse``)."""
    bound = _Reverse(n, s, _spread(assigned, n, s))
    _tables(assigned, [bound])
    return _with_bounds(_whole(assigned), [bound])


def _whole(pool: DataFrame) -> DataFrame:
    """Rows with a cluster, the one of a pool that has none."""
    own = _rows(pool)
    return own if "cluster" in own.columns else own.withColumn("cluster", F.lit(0))


def _by_cluster(values) -> "F.Column":
    """The value of a row's cluster."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)


def _summed(x: np.ndarray, m: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Summed (weighted) distance of every row of x to the rows of m."""
    out = np.zeros(len(x))
    wide = max(HELD[1], min(HELD[0] * HELD[1] // max(1, min(len(x), HELD[0])), BLOCK // max(1, m.shape[1])))  # few rows meet more at once
    for lo in range(0, len(m), wide):
        block = m[lo:lo + wide]
        for at in range(0, len(x), HELD[0]):
            d = V.pairwise(x[at:at + HELD[0]], block, "euclidean")
            out[at:at + HELD[0]] += d.sum(1) if weight is None else d @ weight[lo:lo + wide]
    return out


def _sent_sums(cl: np.ndarray, x: np.ndarray, members: DataFrame) -> np.ndarray:
    """Summed distance of a bounded number of candidates to the members of their clusters: candidates are broadcast, every
    partition adds up the distances to its members."""
    b = members.sparkSession.sparkContext.broadcast((cl, x))

    def fold(chunks):
        own, held = b.value
        total = np.zeros(len(own))
        for _, y, at, _ in chunks:
            for c, rows in _groups(at):
                mine = np.flatnonzero(own == c)
                if len(mine):
                    total[mine] += _summed(held[mine], y[rows])
        return total
    return _gathered(members, fold, lambda a, c: a + c, len(cl))


def _tile_sums(cands: DataFrame, members: DataFrame, k: int, n: np.ndarray, width: int) -> DataFrame:
    """(row_id, cluster, total): exact summed distance of every candidate to the members of its cluster (``n`` a cluster).

    A bounded number of candidates is broadcast, and every partition adds up the distances to its members.  More are cut
    into blocks by cluster, as are the members, and meet block by block; blocks are as large as the tasks of the cluster and
    ``TILE`` allow, because each row is sent once per block of the other side."""
    out = "row_id long, cluster int, s double"
    sc, most = members.sparkSession.sparkContext, max(1, SENT // max(1, width))
    cands = cands.select(KEY, VEC, "cluster")
    rows = cands.limit(most + 1).collect()
    if len(rows) <= most:
        ids, cl = np.array([r[KEY] for r in rows], np.int64), np.array([r["cluster"] for r in rows], np.int32)
        total = _sent_sums(cl, np.array([r[VEC] for r in rows], np.float64), members)
        return members.sparkSession.createDataFrame(list(zip(ids.tolist(), cl.tolist(), total.tolist())), out).groupBy(KEY, "cluster").agg(F.sum("s").alias("total"))
    else:
        members = _whole(members)
        counts = np.zeros(k, np.int64)
        for r in cands.groupBy("cluster").count().collect():
            counts[r["cluster"]] = r["count"]
        pairs = float((counts * n.astype(np.float64)).sum())
        side = int(min(TILE, max(TILE_LEAST, math.sqrt(pairs / (4 * sc.defaultParallelism)))))
        n_a, n_b = (_by_cluster([int(max(1, -(-c // side))) for c in sizes]) for sizes in (counts, n))
        cut = lambda m: F.pmod(F.xxhash64(KEY), m).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        left = cands.withColumn("_a", cut(n_a)).withColumn("_b", every(n_b))
        right = members.filter(_by_cluster([bool(c) for c in counts])).select(  # new column ids: both may come from the same table
            *[F.col(c).alias(c) for c in (KEY, VEC, "cluster")]).withColumn("_b", cut(n_b)).withColumn("_a", every(n_a)).drop(KEY)

        def part(c: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            if not len(c) or not len(m):
                return pd.DataFrame({KEY: [], "cluster": [], "s": []})
            x = V.stack(c[VEC])
            return pd.DataFrame({KEY: c[KEY], "cluster": c["cluster"], "s": sum(_summed(x, V.stack(own[VEC])) for own in _few([m]))})
        parts = left.groupBy("cluster", "_a", "_b").cogroup(right.groupBy("cluster", "_a", "_b")).applyInPandas(part, out)
    return parts.groupBy(KEY, "cluster").agg(F.sum("s").alias("total"))


def _grid(low: np.ndarray, high: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates (at most ``WIDEST`` of the widest), their edge lengths and numbers of bins, for at most ``cells`` cubes."""
    wide = np.argsort(low - high, kind="stable")[:WIDEST]
    extent = (high - low)[wide]
    edge = 1.0
    for m in range(1, len(wide) + 1):
        if extent[m - 1] > 0:
            edge = math.exp((np.log(extent[:m]).sum() - math.log(cells)) / m)
        if m == len(wide) or extent[m] <= edge:
            break
    bins = np.maximum(np.floor(extent[:m] / edge), 1).astype(np.int64)
    return wide[:m], np.where(extent[:m] > 0, extent[:m] / bins, 1.0), bins


class _Moments:
    """Bound from the second moments of a cluster.

    With u = x - mean and v = y - mean, z = |x - y|^2 has mean |u|^2 + E|v|^2 and variance 4 u'Cu - 4 u.E[v|v|^2] + Var|v|^2
    over the members y (C: their covariance), and Hoelder's inequality gives E sqrt(z) >= (E z)^(3/2) / (E z^2)^(1/2)."""

    def __init__(self, n, s, spread):
        k, d = s.shape
        upper = np.triu_indices(d)
        self.n, self.means = n.astype(np.float64), s / np.maximum(n, 1)[:, None]
        mean = spread["sums"] / np.maximum(n, 1)[:, None]
        self.cov = np.zeros((k, d, d))
        self.cov[:, upper[0], upper[1]] = self.cov[:, upper[1], upper[0]] = mean[:, 2 + d:]
        self.spread, self.var, self.skew = mean[:, 0], mean[:, 1] - mean[:, 0] ** 2, mean[:, 2:2 + d]

    def lower(self, cl, x):
        lb = np.zeros(len(x))
        for c, at in _groups(cl):
            u = x[at] - self.means[c]
            z = (u * u).sum(1) + self.spread[c]
            zz = z * z + np.maximum(4 * ((u @ self.cov[c]) * u).sum(1) - 4 * (u @ self.skew[c]) + self.var[c], 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                lb[at] = np.fmax(0, self.n[c] * z * np.sqrt(z / zz) * (1 - 1e-9))  # sums differ in the last bits
        return lb


def _few_moments(s: np.ndarray) -> bool:
    """k x d^2 / 2 sums reach the driver, at most ``SENT``."""
    k, d = s.shape
    return k * (2 + d + d * (d + 1) // 2) <= SENT


def _moment_bounds(cands: DataFrame, assigned: DataFrame, n: np.ndarray, s: np.ndarray) -> DataFrame:
    """``lb`` of the candidates from the second moments of their cluster (``_Moments``), as it is where these are too many."""
    return _with_bounds(cands, [_Moments(n, s, _spread(assigned, n, s, True))]) if _few_moments(s) else cands


class _Cells:
    """Bound from cells: the members of a cell with mean m have a summed distance of at least their number times |x - m|, and of
    at most their number times sqrt(|x - m|^2 + E|y - m|^2).  Cells are cubes over the widest coordinates of a cluster, about
    n^(2/3) of them."""

    def __init__(self, n, s, spread):
        k, d = s.shape
        most = max(64, SENT // ((d + 2) * k))
        self.means, self.low = s / np.maximum(n, 1)[:, None], spread["low"]
        self.grids = [_grid(spread["low"][c], spread["high"][c], int(min(most, max(64, n[c] ** (2 / 3))))) for c in range(k)]
        self.first = np.cumsum([0, *[int(np.prod(g[2])) for g in self.grids]])

    def start(self):
        return np.zeros((self.means.shape[1] + 2, self.first[-1]))

    def add(self, t, cl, x):
        for c, rows in _groups(cl):
            v, (wide, edge, bins) = x[rows], self.grids[c]
            at = np.ravel_multi_index(tuple(np.clip(((v[:, wide] - self.low[c, wide]) / edge).astype(np.int64), 0, bins - 1).T), tuple(bins))
            own, v = t[:, self.first[c]:self.first[c + 1]], v - self.means[c]
            for i, w in enumerate((None, *v.T, (v * v).sum(1))):
                own[i] += np.bincount(at, w, own.shape[1])

    def finish(self, t):
        self.held = []
        for c in range(len(self.grids)):
            own = t[:, self.first[c]:self.first[c + 1]]
            own = own[:, own[0] > 0]
            mean = (own[1:-1] / own[0]).T
            self.held.append((own[0], mean, np.maximum(own[-1] / own[0] - (mean * mean).sum(1), 0)))

    def lower(self, cl, x):
        lb = np.zeros(len(x))
        for c, at in _groups(cl):
            count, mean, _ = self.held[c]
            lb[at] = _summed(x[at] - self.means[c], mean, count) * (1 - 1e-9)  # sums differ in the last bits
        return lb

    def upper(self, c, x):
        """For a few rows of one cluster."""
        count, mean, var = self.held[c]
        return (np.sqrt(V.pairwise(x - self.means[c], mean, "euclidean") ** 2 + var) @ count) * (1 + 1e-9)


def _cell_bounds(cands: DataFrame, assigned: DataFrame, n: np.ndarray, s: np.ndarray) -> DataFrame:
    """``lb`` of the candidates from cells of their cluster (``_Cells``)."""
    bound = _Cells(n, s, _spread(assigned, n, s))
    _tables(assigned, [bound])
    return _with_bounds(cands, [bound])


def _few_dimensions(spread: dict[str, np.ndarray]) -> bool:
    """Whether the widest coordinates have nearly all of the extent, so that cells are close."""
    extent = np.sort((spread["high"] - spread["low"]) ** 2, axis=1)
    return extent[:, -WIDEST:].sum() >= 0.9 * extent.sum()


def _may_win(assigned: DataFrame, bounds: list, cells: "_Cells | None", most: np.ndarray) -> DataFrame:
    """The members, packed, whose bounds are below the sum ``most`` of their cluster.  With cells, a few members of each chunk
    have an upper bound that lowers ``most``, so that few members meet the cells; ``least`` tells how far it went."""
    b = _sent(assigned, (bounds, cells, most))

    def fn(batches):
        cheap, near, least = pickle.loads(b.value)
        least = least.copy()
        for ids, x, cl, _ in _chunks(batches):
            lb = np.max([bound.lower(cl, x) for bound in cheap], axis=0)
            at = np.flatnonzero(lb < least[cl])
            if near:
                for c in np.unique(cl[at]):
                    own = at[cl[at] == c]
                    own = own[np.argsort(lb[own], kind="stable")[:TRIED]]
                    least[c] = min(least[c], near.upper(c, x[own]).min())
                at = at[lb[at] < least[cl[at]]]
                lb[at] = np.maximum(lb[at], near.lower(cl[at], x[at]))
                at = at[lb[at] < least[cl[at]]]
            if len(at):
                block = _blocks_of(ids[at], x[at], cluster=cl[at].astype(np.int32), lb=lb[at])
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array([least], pa.list_(pa.float64()))], names=[*block.schema.names, "least"])
    return assigned.mapInArrow(fn, f"{BLOCKS}, cluster binary, lb binary, least array<double>")


def _closer(n: np.ndarray, s: np.ndarray):
    """The second bounds, each with the number of pairs up to which scoring costs less: cells send up to d values a row."""
    return (_moment_bounds, FEW_PAIRS), (_cell_bounds, max(FEW_PAIRS, CELL_PAIRS * s.shape[1] * int(n.sum())))


# candidates per cluster that are scored first, to have a good threshold for the others
FIRST_CANDIDATES = 8
TRIED = 2                  # rows of a cluster and chunk whose sum is bounded from above


def _held(lbs: DataFrame, most: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """A bounded number of members that may win, lowest bounds first, and the lowest of ``least``."""
    rows = [r.asDict() for r in lbs.collect()]
    blocks = [_block(pa.RecordBatch.from_pylist([r]), 0) for r in rows]
    held = pd.DataFrame({c: np.concatenate([b[name] for b in blocks] or [np.zeros(0, kind)]) for c, name, kind in (
        (KEY, "ids", np.int64), ("cluster", "cluster", np.int32), ("lb", "lb", np.float64))})
    held[VEC] = [v for b in blocks for v in b["vecs"].astype(np.float64)]
    return held.sort_values(["lb", KEY]), np.min([most, *[r["least"] for r in rows]], axis=0)


def _best_members_euclidean(assigned: DataFrame, k: int, start_ids: list[int], start_cost: np.ndarray, sums=None,
                            vectors: dict | None = None, cells_first: bool = True):
    """Exact argmin over members of the summed distance to the cluster, with bound pruning: the few members with the
    lowest bounds of each cluster give a threshold; every member whose bound is below it is then scored in one job.  In large
    pools the bounds are also taken from moments and from cells, at once where few coordinates matter, else where many members
    are left.  A bounded number of members that may win is sorted out on the driver; of more, one row per cluster reaches it.
    ``vectors`` gets the vectors of the members scored, as far as the driver has them."""
    n, s, *ends = sums if sums is not None else _cluster_sums(assigned, "euclidean", k)
    if not np.isfinite(s).all():
        raise ValueError("vectors with missing values")
    large = float((n.astype(np.float64) ** 2).sum()) > FEW_PAIRS
    moments = large and _few_moments(s) and s.shape[1] > WIDEST
    spread = _corners(n, s, *ends) if ends and s.shape[1] <= WIDEST else _spread(assigned, n, s, moments)
    bounds = [_Reverse(n, s, spread)]
    cells = _Cells(n, s, spread) if cells_first and large and _few_dimensions(spread) else None
    _tables(assigned, [*bounds, *([cells] if cells else [])])
    if moments:
        bounds.append(_Moments(n, s, spread))
    best_val = np.asarray(start_cost, dtype=np.float64).copy()
    best_id = list(start_ids)
    lbs = _may_win(assigned, bounds, cells, best_val).persist()

    total = F.round("total", 9)  # sums differ in the last bits by the order of addition

    def take(c: int, v: float, i: int):
        if v < best_val[c] - 1e-9 or (abs(v - best_val[c]) <= 1e-9 and i < best_id[c]):
            best_val[c], best_id[c] = v, i

    def below():
        return F.col("lb") < F.array(*[F.lit(float(v)) for v in best_val])[F.col("cluster")]
    w = Window.partitionBy("cluster").orderBy("lb", KEY)
    done = []

    def rest(rows: DataFrame) -> DataFrame:
        return rows.filter(below()).filter(~F.col(KEY).isin(done))

    def score_first(rows: DataFrame) -> DataFrame:
        """Scores the rows with the lowest bounds, a few per cluster, and returns the others that may still win."""
        first = rows.filter(below()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= FIRST_CANDIDATES).drop("_r")
        for r in _tile_sums(first, assigned, k, n, s.shape[1]).select("cluster", total.alias("v"), KEY).collect():
            take(r["cluster"], r["v"], r[KEY])
            done.append(r[KEY])
        return rest(rows)

    def left(rows: DataFrame) -> tuple[int, float]:
        found = rows.groupBy("cluster").count().collect()
        return sum(r["count"] for r in found), sum(float(r["count"]) * float(n[r["cluster"]]) for r in found)

    def score(own: pd.DataFrame):
        """Scores rows on the driver."""
        if len(own):
            x = np.vstack(own[VEC])
            found = pd.Series(_sent_sums(own["cluster"].to_numpy(), x, assigned)).groupby([own["cluster"].to_numpy(), own[KEY].to_numpy()]).sum()
            for (c, i), v in found.items():
                take(int(c), round(float(v), 9), int(i))
                done.append(int(i))
            if vectors is not None:
                vectors.update(zip(own[KEY].tolist(), x))
    few, closer = max(FEW_PAIRS, CELL_PAIRS * s.shape[1] * int(n.sum())), [lbs]
    if (lbs.agg(F.sum("rows")).collect()[0][0] or 0) <= max(1, SENT // max(1, s.shape[1])):
        held, least = _held(lbs, best_val)
        held = held[held["lb"] < least[held["cluster"]]]
        if float(n[held["cluster"]].sum()) > 2 * FEW_PAIRS:
            score(held[held.groupby("cluster").cumcount() < FIRST_CANDIDATES])
        held = held[(held["lb"] < best_val[held["cluster"]]) & ~held[KEY].isin(done)]
        if more := not cells and float(n[held["cluster"]].sum()) > few:
            rows = rest(_rows(lbs))
        else:
            score(held)
    else:
        least = best_val.copy()
        for r in lbs.select(F.posexplode("least").alias("c", "v")).groupBy("c").agg(F.min("v").alias("v")).collect():
            least[r["c"]] = r["v"]
        more, rows = True, score_first(_rows(lbs))
    if more:
        evaluated, pairs = left(rows)
        if pairs > few and not cells:
            closer.append(_cell_bounds(rows, assigned, n, s).persist())
            rows = score_first(closer[-1])
            evaluated, pairs = left(rows)
        if evaluated:
            best = _tile_sums(rows, assigned, k, n, s.shape[1]).groupBy("cluster").agg(F.min(F.struct(total.alias("v"), F.col(KEY))).alias("b")).collect()
            for r in best:
                take(r["cluster"], r["b"]["v"], r["b"][KEY])
    else:
        evaluated = 0
    # rows of one key count together, so that the sum found may be above the upper bound of one
    over = cells and (least < best_val).any()
    for df in closer:
        df.unpersist()
    if over:
        return _best_members_euclidean(assigned, k, start_ids, start_cost, (n, s, *ends), vectors, False)
    return best_id, best_val, evaluated + len(done)


def init_heuristic(pool: DataFrame, k: int, metric: str = "euclidean") -> list[int]:
    """I8: the k rows with the smallest summed distance to the whole pool (exact).

    cosine: closed form n - x.(sum of rows).  euclidean: the few rows with the lowest bounds are scored, and rows whose bound
    exceeds the k-th smallest sum found drop.  Where many are left, their bounds are first taken again (``_closer``); the
    rest are scored exactly in one job.
    """
    one = pool  # a pool without clusters is one
    n, s = _cluster_sums(one, metric, 1)
    sc = pool.sparkSession.sparkContext
    if metric == "cosine":
        b = sc.broadcast(s[0])

        def fn(batches):
            for ids, x, _, _ in _chunks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(float(n[0]) - V.normalise(x) @ b.value)], names=[KEY, "score"])
        sc_df = pool.mapInArrow(fn, "row_id long, score double")
        return [r[KEY] for r in sc_df.orderBy("score", KEY).limit(k).collect()]
    held = [_lower_bounds(one, n, s, metric).persist()]

    def may_win() -> DataFrame:
        first = held[-1].orderBy("lb", KEY).limit(4 * k + FIRST_CANDIDATES)
        kth = [r["total"] for r in _tile_sums(first, one, 1, n, s.shape[1]).orderBy("total").limit(k).collect()][-1]
        return held[-1].filter(F.col("lb") <= F.lit(kth + 1e-9 * (1 + abs(kth))))  # sums differ in the last bits
    cands = may_win()
    for bounds, few in _closer(n, s):
        if cands.count() * float(n[0]) > few:
            held.append(bounds(cands, one, n, s).persist())
            cands = may_win()
    best = _tile_sums(cands, one, 1, n, s.shape[1]).orderBy(F.round("total", 9), KEY).limit(k).collect()  # k rows
    for df in held:
        df.unpersist()
    return [r[KEY] for r in best]


def init_kmedoidspp(pool: DataFrame, k: int, seed: int, metric: str = "euclidean",
                    n_local_trials: int | None = None, checkpoint_every: int = 8) -> list[int]:
    """Greedy k-medoids++ (D^2 sampling with local trials), all draws seeded by row hash."""
    sc = pool.sparkSession.sparkContext
    trials = n_local_trials or (2 + int(math.log(k)))
    first = _rows(pool).select(KEY).orderBy(seeded_order(seed, F.col(KEY)), F.col(KEY)).limit(1).collect()[0][KEY]
    chosen = [first]
    pool = pool if _is_packed(pool) else _packed(pool)
    state = assign(pool, [first], metric).drop("cluster")
    state = cut_lineage(state)
    for r in range(1, k):
        def draw(chunks, salt=f"{seed}:{r}|".encode()):
            """The rows with the lowest keys -ln(u) / D^2, where u is ``seeded_unit`` of the round and the row."""
            best = []
            for ids, x, _, dmin in chunks:
                w = dmin * dmin
                at = np.flatnonzero(w > 0)
                order = np.frombuffer(b"".join([md5(b"%b%d" % (salt, i)).digest()[:4] for i in ids[at].tolist()]), ">u4")
                u = (order.astype(np.float64) + 0.5) / TWO_POW_32
                keys = -np.log(u) / w[at]
                own = np.lexsort((ids[at], keys))[:trials]
                best = sorted([*best, *[(keys[j], int(ids[at[j]]), x[at[j]]) for j in own]], key=lambda v: v[:2])[:trials]
            return best or None
        cand = _gathered(state, draw, lambda a, b: sorted([*a, *b], key=lambda v: v[:2])[:trials], 64 * trials)
        if not cand:
            break  # every row coincides with a medoid
        ids = [c[1] for c in cand]
        vecs = _prepare_block(np.vstack([c[2] for c in cand]), metric)
        b = sc.broadcast(vecs)

        def pot(chunks, b=b):
            acc = np.zeros(len(b.value))
            for _, x, _, dmin in chunks:
                for lo in range(0, len(x), FEW):
                    part = x[lo:lo + FEW]
                    d = V.pairwise(V.normalise(part) if metric == "cosine" else part, b.value, metric)
                    dm = dmin[lo:lo + FEW, None]
                    acc += np.minimum(dm * dm, d * d).sum(0)
            return acc
        pv = _gathered(state, pot, lambda a, c: a + c, len(ids))
        best = min(range(len(ids)), key=lambda j: (pv[j], j))
        chosen.append(ids[best])
        if r == k - 1:
            break
        nb = sc.broadcast(vecs[best:best + 1])

        def upd(batches, nb=nb):
            for batch in batches:
                for at in range(batch.num_rows):
                    held = _block(batch, at)
                    x = held["vecs"].astype(np.float64)
                    d = V.pairwise(V.normalise(x) if metric == "cosine" else x, nb.value, metric)[:, 0]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, 1) for c in batch.schema.names if c != "dist"], pa.array([np.minimum(held["dist"], d).tobytes()], pa.binary())],
                                                     names=[*[c for c in batch.schema.names if c != "dist"], "dist"])
        prev = state
        state = state.mapInArrow(upd, f"{BLOCKS}, dist binary")
        # reliable checkpoint every few rounds (survives executor loss); cached in between so the
        # two jobs of the next round do not recompute the chain of updates
        state = cut_lineage(state) if r % checkpoint_every == 0 else state.persist()
        state.count()  # the new state is filled from the cached old one before that goes
        prev.unpersist()
    state.unpersist()
    return chosen


# ---------------------------------------------------------------- I10: iterate
def kmedoids(pool: DataFrame, k: int, seed: int = 42, metric: str = "euclidean", init: str = "k-medoids++",
             max_iter: int = 300, key: str = "row_id", vec: str = "features",
             verbose: bool = False, tol: float = 0.0):
    """K-medoids (alternate updates).  Returns (medoid ids in cluster order, info dict).

    n >= N returns the whole pool (I2).  ``info`` reports iterations, candidates
    scored exactly and the final cost.  The loop ends when the medoids are stable (the
    reference rule, ``tol = 0``) or, with ``tol > 0``, when an iteration lowers the total
    cost by less than that relative amount.
    """
    p = _prep(pool, key, vec)
    n_rows = p.count()
    if k >= n_rows:
        return [r[KEY] for r in p.select(KEY).orderBy(KEY).collect()], {"iterations": 0, "whole_pool": True}
    tasks = p.sparkSession.sparkContext.defaultParallelism
    d = p.select(F.size(VEC)).head()[0] or 1
    p = cut_lineage(_packed(p.repartition(max(2 * tasks, math.ceil(n_rows / PART_ROWS), math.ceil(n_rows * d / PART_VALUES)), KEY)))
    if init == "random":
        medoids = init_random(p, k, seed)
    elif init == "heuristic":
        medoids = init_heuristic(p, k, metric)
    else:
        medoids = init_kmedoidspp(p, k, seed, metric)
    info = {"iterations": 0, "candidates_scored": 0}
    prev_cost, vectors = None, {}
    for it in range(max_iter):
        known = metric == "euclidean" and all(m in vectors for m in medoids)
        a = assign(p, medoids, metric, np.vstack([vectors[m] for m in medoids]) if known else None).persist()
        n, s, cur, ends = _cluster_sums(a, metric, k, with_cost=True, with_ends=True)
        if metric == "cosine":
            b = a.sparkSession.sparkContext.broadcast(s)

            def fn(batches, b=b):
                tot = b.value
                for ids, x, cl, _ in _chunks(batches):
                    own = pd.DataFrame({"cluster": cl, KEY: ids, "score": (V.normalise(x) * tot[cl]).sum(1)})
                    own = own.sort_values(["score", KEY], ascending=[False, True]).drop_duplicates("cluster")
                    yield pa.RecordBatch.from_pandas(own, preserve_index=False)
            best = (a.mapInArrow(fn, "cluster int, row_id long, score double")
                    .groupBy("cluster").agg(F.max_by(KEY, F.struct(F.col("score"), -F.col(KEY))).alias(KEY))
                    .collect())
            new = list(medoids)
            for r in best:
                new[r["cluster"]] = r[KEY]
        else:
            vectors = {m: v for m, v in vectors.items() if m in medoids}
            new, _, ev = _best_members_euclidean(a, k, medoids, cur, (n, s, ends), vectors)
            info["candidates_scored"] += ev
        a.unpersist()
        info["iterations"] = it + 1
        if verbose:
            print(f"iter {it}: cost {cur.sum():.4f} changed {sum(x != y for x, y in zip(new, medoids))} "
                  f"scored {info['candidates_scored']}", flush=True)
        info["cost"] = float(cur.sum())
        if new == medoids:
            break
        if tol > 0 and prev_cost is not None and prev_cost - cur.sum() < tol * prev_cost:
            medoids = new
            break
        prev_cost = cur.sum()
        medoids = new
    return medoids, info


def kmedoids_summary(pool: DataFrame, medoids: list[int], metric: str = "euclidean",
                     key: str = "row_id", vec: str = "features") -> DataFrame:
    """Medoid, cluster size and cost (summed distance) per cluster, computed by Spark over the pool."""
    p = _prep(pool, key, vec)
    own = _packed(p.withColumn(KEY, F.lit(0).cast("long")))  # keys of the medoids only are needed
    a = assign(own, medoids, metric, _fetch(p, medoids))

    def fn(batches):
        for _, _, cl, dist in _chunks(batches):
            found = pd.DataFrame({"cluster": cl, "dist": dist}).groupby("cluster", as_index=False).agg(
                size=("cluster", "size"), cost=("dist", lambda v: v.sum(min_count=1)))
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)
    parts = a.mapInArrow(fn, "cluster int, size long, cost double").groupBy("cluster").agg(F.sum("size").alias("size"), F.sum("cost").alias("cost"))
    ids = p.sparkSession.createDataFrame([(i, int(m)) for i, m in enumerate(medoids)], "cluster int, medoid long")
    return parts.join(F.broadcast(ids), "cluster").select("cluster", "medoid", "size", "cost")


# ---------------------------------------------------------------- I11
def duplicate_medoids(pool: DataFrame, medoids: list[int], key: str = "row_id", vec: str = "features") -> DataFrame:
    """For each medoid vector: the first medoid that has it, how many medoids share it and how often it occurs in the
    pool.  Vectors are compared by value."""
    p = pool.select(F.col(key).alias(KEY), F.col(vec).alias("vh"))
    ids = p.sparkSession.createDataFrame([(int(m),) for m in medoids], "row_id long")
    med = p.join(F.broadcast(ids), KEY, "left_semi").groupBy("vh").agg(F.min(KEY).alias("medoid"), F.count(F.lit(1)).alias("n_medoids"))
    occ = p.join(med.select("vh"), "vh", "left_semi").groupBy("vh").agg(F.count(F.lit(1)).alias("pool_count"))
    return med.join(occ, "vh").select("medoid", "n_medoids", "pool_count")
