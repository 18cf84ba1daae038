"""Approximate nearest neighbours over balanced posting lists.

1. Centroids.  A sample of at most ``MAX_SAMPLE`` vectors (by a hash of the id) is clustered on the unit sphere; clusters over
   twice the mean size are split again, so lists are balanced.  Centroids and their neighbour graph have a fixed
   largest size and are broadcast.
2. Postings.  Every vector finds its nearest centroids by a beam search in the graph and joins the nearest list; vectors
   near a boundary join up to ``MAX_REPLICAS`` further lists within ``REPLICA_RATIO`` of the nearest distance, unless a list
   already joined is nearer to that centroid than the vector is.
   Where the sample gives fewer lists than ``LIST_SIZE`` asks for, over-full lists are split again on the executors: a
   sample of each list, in proportion to its size, is clustered in its own task into at most ``FAN_OUT`` lists, its
   vectors move on block by block, and so on until no list is over twice the mean size or none can be split (equal
   vectors).  Lists stay balanced at any number of vectors; queries walk down the same levels.
3. Search.  A query takes the lists within ``PROBE_RATIO`` of its nearest centroid's distance, and further ones until they
   hold ``MIN_CANDIDATES`` vectors.  Lists and their queries are cut into blocks of bounded size that meet block by block,
   so a hot list is spread over many tasks; each block gives its best few, scored exactly on the original vectors.

All rows are indexed; only the set of lists a query visits is approximate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored

MAX_SAMPLE = 50_000
LIST_SIZE = 200
SAMPLE_PER_LIST = 20
ROUNDS = 8
LINKS, LONG_LINKS = 24, 8
BEAM = 96
MAX_REPLICAS, REPLICA_RATIO = 4, 1.1
PROBE_RATIO = 1.3
MIN_CANDIDATES = 400
FAN_OUT = 1000
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 512
TIE = 1e-9  # slack of the matrix product against the exact score


def usable(rows: DataFrame, id_col: str, vec_col: str, dims: int | None = None) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part: not null, no null or non-finite component, not zero, and of length ``dims``; and
    that length, by default the most frequent one (of several, the largest; 0 without vectors)."""
    x = F.col(vec_col)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda e: e.cast("double")).alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and exists(v, e -> e <> 0) "
                      "and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity'))")
    if dims is None:
        lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()
        dims = lengths["d"] or 0
    return rows.where(F.size("v") == dims), dims


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of the rows of x and q; the same rows give the same bits wherever they stand."""
    nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    odd = ~(np.isfinite(nx * nq) & (nx * nq > 0))  # squares out of range: scale first
    if odd.any():
        x, q = x.copy(), q.copy()
        x[odd], q[odd] = unit(x[odd]), unit(q[odd])
        nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    return (x * q).sum(axis=1) / (nx * nq)


def _lloyd(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c, (x @ c.T).argmax(axis=1)


def balanced_centroids(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """About k centroids of the unit vectors x; clusters over twice the mean size are split as long as they can be."""
    rng = np.random.default_rng(seed)
    c, at = _lloyd(x, min(k, len(x)), rng)
    limit, done, open_ = max(2.0 * len(x) / len(c), 2), [], [np.flatnonzero(at == j) for j in range(len(c))]
    while open_:
        own = open_.pop()
        if not len(own):
            continue
        if len(own) > limit:
            _, side = _lloyd(x[own], 2, rng)
            if 0 < side.sum() < len(own):
                open_ += [own[side == 0], own[side == 1]]
                continue
        mean = x[own].mean(axis=0)
        size = np.sqrt((mean * mean).sum())
        done.append(mean / size if size > 1e-12 else x[own[0]])
    return np.array(done)


def neighbour_graph(c: np.ndarray, seed: int = 6) -> np.ndarray:
    """Links of every centroid: its nearest ones and a few random ones (long links)."""
    rng = np.random.default_rng(seed)
    n = min(LINKS, len(c) - 1)
    near = np.concatenate([np.argsort(-(c[i:i + 1024] @ c.T), axis=1, kind="stable")[:, :n + 1] for i in range(0, len(c), 1024)])
    far = rng.integers(0, len(c), (len(c), LONG_LINKS))
    return np.concatenate((near, far), axis=1).astype(np.int32)


def beam_search(c: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each unit vector in q: centroids, nearest first, and their distances.  All queries walk the graph
    together, one expansion of the best unexpanded centroid a step; a beam that covers the graph is searched plainly."""
    if beam >= len(c):
        d = np.sqrt(np.maximum(2.0 - 2.0 * (q @ c.T), 0.0))
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.take_along_axis(d, order, axis=1)
    n, rows = len(q), np.arange(len(q))[:, None]
    entry = np.linspace(0, len(c) - 1, min(beam, 32)).astype(np.int64)
    seen = np.zeros((n, len(c)), bool)
    seen[:, entry] = True
    ids = np.tile(entry, (n, 1))
    dist = np.sqrt(np.maximum(2.0 - 2.0 * (q @ c[entry].T), 0.0))
    pad = beam - len(entry)
    ids = np.concatenate((ids, np.zeros((n, pad), np.int64)), axis=1)
    dist = np.concatenate((dist, np.full((n, pad), np.inf)), axis=1)
    todo = np.isfinite(dist)
    while True:
        best = np.where(todo, dist, np.inf).argmin(axis=1)
        live = np.flatnonzero(todo[np.arange(n), best])
        if not len(live):
            break
        node = ids[live, best[live]]
        todo[live, best[live]] = False
        near = links[node].astype(np.int64)
        fresh = ~seen[live[:, None], near]
        ordered = np.sort(near, axis=1)  # a centroid linked twice counts once
        twice = np.zeros_like(fresh)
        place = np.argsort(near, axis=1, kind="stable")
        np.put_along_axis(twice, place[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
        fresh &= ~twice
        seen[live[:, None], near] = True
        d = np.where(fresh, np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("nd,nmd->nm", q[live], c[near]), 0.0)), np.inf)
        all_d, all_i = np.concatenate((dist[live], d), axis=1), np.concatenate((ids[live], near), axis=1)
        all_t = np.concatenate((todo[live], fresh), axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], ids[live] = np.take_along_axis(all_d, keep, axis=1), np.take_along_axis(all_i, keep, axis=1)
        todo[live] = np.take_along_axis(all_t, keep, axis=1) & np.isfinite(dist[live])
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _replicas(c, ids, dist):
    """Lists that each vector joins: True where it does; nearest first."""
    join = np.zeros(ids.shape, bool)
    join[:, 0] = True
    for k in range(1, min(ids.shape[1], 2 * MAX_REPLICAS)):
        ok = (dist[:, k] <= REPLICA_RATIO * dist[:, 0] + 1e-12) & (join.sum(axis=1) < MAX_REPLICAS)
        for j in range(k):  # a joined centroid nearer to this one than the vector is already stands for it
            gap = np.sqrt(np.maximum(2.0 - 2.0 * (c[ids[:, j]] * c[ids[:, k]]).sum(axis=1), 0.0))
            ok &= ~(join[:, j] & (gap < dist[:, k]))
        join[:, k] = ok
    return join


def _emit(v_type, v_column, id_column, lists, join):
    at, which = np.nonzero(join)
    return pa.RecordBatch.from_arrays([pa.array(lists[at, which].astype(np.int32)), id_column.take(pa.array(at)), v_column.take(pa.array(at))],
                                      names=["list", "id", "v"])


def build_index(rows: DataFrame):
    """(centroids, links, stored postings (list, id, v)) of ``rows`` (id, v)."""
    spark = rows.sparkSession
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(MAX_SAMPLE).select("v").toArrow()["v"].combine_chunks()
    x = unit(matrix(sample)) if len(sample) else np.zeros((1, 1))
    k = max(1, min(-(-n // LIST_SIZE), max(1, len(x) // SAMPLE_PER_LIST)))
    c = balanced_centroids(x, k)
    links = neighbour_graph(c)
    shared = spark.sparkContext.broadcast((c, links))

    def assign(batches):
        c, links = shared.value
        for b in batches:
            for s in range(0, len(b), 1024):
                p = b.slice(s, 1024)
                ids, dist = beam_search(c, links, unit(matrix(p.column(1))), 2 * MAX_REPLICAS if len(c) <= 2 * MAX_REPLICAS else BEAM // 2)
                yield _emit(p.schema.types[1], p.column(1), p.column(0), ids, _replicas(c, ids, dist))

    return c, links, stored(rows.mapInArrow(assign, "list int, id bigint, v array<double>"), "postings")


def _probes(queries: DataFrame, c, links, sizes: np.ndarray) -> DataFrame:
    """(list, id, v) for every list that a query visits."""
    shared = queries.sparkSession.sparkContext.broadcast((c, links, sizes))

    def run(batches):
        c, links, sizes = shared.value
        for b in batches:
            for s in range(0, len(b), 512):
                p = b.slice(s, 512)
                q = unit(matrix(p.column(1)))
                ids, dist = beam_search(c, links, q)
                held = np.cumsum(sizes[ids], axis=1) - sizes[ids]
                visit = (dist <= PROBE_RATIO * dist[:, :1] + 1e-12) | (held < MIN_CANDIDATES)
                yield _emit(p.schema.types[1], p.column(1), p.column(0), ids, visit & np.isfinite(dist))

    return queries.mapInArrow(run, "list int, id bigint, v array<double>")


def _cut(df: DataFrame, sizes: DataFrame, parts: str, block: int) -> DataFrame:
    """``df`` with the number of blocks of its list (``sizes`` has list, n) and the block of each row, by a hash of its id."""
    n = F.ceil(F.col("n") / F.lit(block)).cast("int")
    return df.join(sizes.select("list", n.alias(parts)), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col(parts)).cast("int"))


def _split_lists(postings: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Postings whose lists over twice LIST_SIZE are split, level by level, and the centres (list, to, c, n) of every level: the
    list ``list`` was split into lists ``to`` with centre c and n vectors.  A new list's number is a hash; two lists that
    share one are searched together."""
    levels, seed = [], 0
    postings = postings.withColumn("list", F.col("list").cast("bigint")).withColumn("open", F.lit(True))
    while True:
        sizes = postings.where("open").groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > 2 * LIST_SIZE)
        if sizes.isEmpty():
            return postings.drop("open"), levels
        sizes, seed = stored(sizes, "list-sizes"), seed + 1
        into = F.least(F.ceil(F.col("n") / F.lit(LIST_SIZE)), F.lit(FAN_OUT)).cast("int")
        lot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = postings.where("open").join(sizes.withColumn("parts", into), "list").where(lot < F.col("parts") * SAMPLE_PER_LIST / F.col("n"))

        def cluster(rows: pa.Table) -> pa.Table:
            """Centres of one list, from at most about FAN_OUT * SAMPLE_PER_LIST of its vectors."""
            x = np.unique(unit(matrix(rows["v"].combine_chunks())), axis=0)
            c = balanced_centroids(x, min(rows["parts"][0].as_py(), len(x))) if len(x) > 1 else x[:0]
            return pa.table({"list": pa.array([rows["list"][0].as_py()] * len(c), pa.int64()), "sub": pa.array(range(len(c)), pa.int32()),
                             "c": pa.array(list(c), pa.list_(pa.float64()))})

        centres = sample.select("list", "v", "parts").groupBy("list").applyInArrow(cluster, "list bigint, sub int, c array<double>")
        centres = stored(centres.withColumn("to", F.xxhash64("list", "sub", F.lit(seed))), "list-centres")
        blocks = _cut(postings.where("open"), sizes, "parts", BLOCK_VECTORS)
        spread = centres.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.lit(BLOCK_VECTORS)).cast("int") - 1)))

        def move(vectors: pa.Table, parts: pa.Table) -> pa.Table:
            parts = parts.sort_by("sub")
            c, to = matrix(parts["c"].combine_chunks()), parts["to"].to_numpy()
            at, where = [], []
            if len(vectors) and len(c) > 1:
                x = unit(matrix(vectors["v"].combine_chunks()))
                for s in range(0, len(x), 512):
                    d = np.sqrt(np.maximum(2.0 - 2.0 * (x[s:s + 512] @ c.T), 0.0))
                    ids = np.argsort(d, axis=1, kind="stable")[:, :2 * MAX_REPLICAS]
                    rows, which = np.nonzero(_replicas(c, ids, np.take_along_axis(d, ids, axis=1)))
                    at.append(rows + s)
                    where.append(to[ids[rows, which]])
            if not at:  # not to be split: the list stays as it is
                return pa.table({"list": vectors["list"], "id": vectors["id"], "v": vectors["v"], "open": pa.array([False] * len(vectors))})
            at, where = np.concatenate(at), np.concatenate(where)
            return pa.table({"list": pa.array(where), "id": vectors["id"].take(pa.array(at)), "v": vectors["v"].take(pa.array(at)),
                             "open": pa.array([True] * len(at))})

        moved = blocks.select("list", "block", "id", "v").groupBy("list", "block").cogroup(
            spread.select("list", "block", "sub", "c", "to").groupBy("list", "block")).applyInArrow(move, "list bigint, id bigint, v array<double>, open boolean")
        rest = postings.join(sizes.select("list"), "list", "left_anti").select("list", "id", "v", "open")
        postings = stored(rest.unionByName(moved), "postings")
        counts = postings.groupBy(F.col("list").alias("to")).agg(F.count("*").alias("n"))
        levels.append(stored(centres.join(counts, "to").select("list", "to", "c", "n"), "list-level"))


def _walk_down(probes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The probes of first-level lists, moved on to the lists that these were split into: those within PROBE_RATIO of the
    nearest centre's distance, and further ones until they hold MIN_CANDIDATES vectors."""
    def choose(asked: pa.Table, parts: pa.Table) -> pa.Table:
        if not len(asked) or not len(parts):
            return asked.select(["list", "id", "v"])
        parts = parts.sort_by("to")
        c, to, n = matrix(parts["c"].combine_chunks()), parts["to"].to_numpy(), parts["n"].to_numpy()
        q, at, where = unit(matrix(asked["v"].combine_chunks())), [], []
        for s in range(0, len(q), 512):
            d = np.sqrt(np.maximum(2.0 - 2.0 * (q[s:s + 512] @ c.T), 0.0))
            ids = np.argsort(d, axis=1, kind="stable")
            d = np.take_along_axis(d, ids, axis=1)
            held = np.cumsum(n[ids], axis=1) - n[ids]
            rows, which = np.nonzero((d <= PROBE_RATIO * d[:, :1] + 1e-12) | (held < MIN_CANDIDATES))
            at.append(rows + s)
            where.append(to[ids[rows, which]])
        at = pa.array(np.concatenate(at))
        return pa.table({"list": pa.array(np.concatenate(where)), "id": asked["id"].take(at), "v": asked["v"].take(at)})

    for centres in levels:
        split = centres.select("list").distinct()
        sizes = probes.join(split, "list", "left_semi").groupBy("list").agg(F.count("*").alias("n"))
        blocks = _cut(probes.join(split, "list", "left_semi"), sizes, "parts", BLOCK_QUERIES)
        spread = centres.join(sizes.withColumnRenamed("n", "asked"), "list").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("asked") / F.lit(BLOCK_QUERIES)).cast("int") - 1)))
        moved = blocks.select("list", "block", "id", "v").groupBy("list", "block").cogroup(
            spread.select("list", "block", "to", "c", "n").groupBy("list", "block")).applyInArrow(choose, "list bigint, id bigint, v array<double>")
        probes = stored(probes.join(split, "list", "left_anti").select("list", "id", "v").unionByName(moved).dropDuplicates(["list", "id"]), "probes")
    return probes


def _blocks(counts: np.ndarray, size: int) -> np.ndarray:
    return np.maximum(1, -(-counts // size)).astype(np.int64)


def _best_of_block(k: int):
    """The k best vectors of a block for each of its queries."""
    def meet(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(vectors) or not len(asked):
            return _result([], [], [])
        x, q = matrix(vectors["v"].combine_chunks()), matrix(asked["v"].combine_chunks())
        ids, owners = vectors["id"].to_numpy(), asked["id"].to_numpy()
        ux, out = unit(x), ([], [], [])
        for s in range(0, len(q), 256):
            near = unit(q[s:s + 256]) @ ux.T
            near[ids[None, :] == owners[s:s + 256, None]] = -np.inf
            if near.shape[1] > k:
                bar = -np.partition(-near, k - 1, axis=1)[:, k - 1]
            else:
                bar = np.full(len(near), -2.0)
            at, which = np.nonzero((near >= bar[:, None] - TIE) & np.isfinite(near))
            score = cosine(x[which], q[s:s + 256][at])
            order = np.lexsort((ids[which], -score, at))  # the k best of the block, ties to the smaller id
            at, which, score = at[order], which[order], score[order]
            same = np.zeros(len(at), bool)
            same[1:] = (at[1:] == at[:-1]) & (ids[which][1:] == ids[which][:-1]) & (score[1:] == score[:-1])
            at, which, score = at[~same], which[~same], score[~same]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            best = place < k
            out[0].append(owners[s:s + 256][at[best]])
            out[1].append(ids[which[best]])
            out[2].append(score[best])
        return _result(*out)
    return meet


FOUND = "query_id bigint, vec_id bigint, score double"


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every vector of ``queries`` its ``k`` nearest found among ``rows``, itself (its id)
    left out; score is the cosine in double precision on the original vectors, ties go to the smaller id.  Vectors that
    ``usable`` drops take no part; rows that repeat an id and a vector are one candidate.  All candidates, if fewer."""
    spark = rows.sparkSession
    clean, dims = usable(rows, id_col, vec_col)
    asked, _ = usable(queries, id_col, vec_col, dims)  # one length for both sides
    c, links, postings = build_index(clean)

    def per_list(df):
        got = df.groupBy("list").count().toArrow()  # one row per centroid at most
        out = np.zeros(len(c), np.int64)
        out[got["list"].to_numpy()] = got["count"].to_numpy()
        return out
    sizes = per_list(postings)
    probes = stored(_probes(asked, c, links, sizes), "probes")
    if sizes.max(initial=0) > 2 * LIST_SIZE and clean.count() > LIST_SIZE * len(c):  # the sample gave too few lists
        postings, levels = _split_lists(postings)
        probes = _walk_down(probes.withColumn("list", F.col("list").cast("bigint")), levels)
        return _ranked(_meet_lists(postings, probes, k), k)
    v_parts, q_parts = _blocks(sizes, BLOCK_VECTORS), _blocks(per_list(probes), BLOCK_QUERIES)
    cuts = F.from_json(F.lit(str([{"a": int(a), "b": int(b)} for a, b in zip(v_parts, q_parts)]).replace("'", '"')), "array<struct<a:int,b:int>>")
    side = lambda df, own, other: df.withColumn("cut", cuts[F.col("list")]).select(
        "list", "id", "v", F.pmod(F.xxhash64("id"), F.col(f"cut.{own}")).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.col(f"cut.{other}") - 1)).alias(other))
    left, right = side(postings, "a", "b"), side(probes, "b", "a")

    return _ranked(left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInArrow(_best_of_block(k), FOUND), k)


def _meet_lists(postings: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """As the end of ``nearest``, for lists too many to have their block counts on the driver."""
    counts = lambda df, out: df.groupBy("list").agg(F.count("*").alias(out))
    cuts = counts(probes, "q").join(counts(postings, "n"), "list").select(
        "list", F.ceil(F.col("n") / F.lit(BLOCK_VECTORS)).cast("int").alias("as"), F.ceil(F.col("q") / F.lit(BLOCK_QUERIES)).cast("int").alias("bs"))
    cuts = stored(cuts, "list-cuts")

    def side(df, own, other):
        return df.join(cuts, "list").select("list", "id", "v", F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int").alias(own),
                                            F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))
    left, right = side(postings, "a", "b"), side(probes, "b", "a")
    return left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInArrow(_best_of_block(k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _result(owners, ids, scores) -> pa.Table:
    flat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
    return pa.table({"query_id": flat(owners, pa.int64()), "vec_id": flat(ids, pa.int64()), "score": flat(scores, pa.float64())})
