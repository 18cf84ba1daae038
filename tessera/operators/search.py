"""Supervised subset search as batch candidate operators.

A population is a sparse membership table ``candidates(candidate_id, row_id)``
over a labelled pool (row_id, label, ...).  Every generation step is a set of
DataFrame operations over all candidates at once; only the short generation
loop runs on the driver.  Random choices are seeded row hashes per candidate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_order

MAX_SELECTION = 500


def _h(seed, cand: Column, key: Column) -> Column:
    return seeded_order(F.concat(F.lit(f"{seed}:"), cand.cast("string")), key)


# ---------------------------------------------------------------- C1
def random_candidates(pool: DataFrame, n_candidates: int, size: int, seed: int = 42) -> DataFrame:
    """n_candidates random subsets of ``size`` rows, each with >= 1 row per class (min hash per
    class, then the lowest hashes of the rest), at every size."""
    cand = pool.select("row_id", "label").withColumn(
        "candidate_id", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    h = _h(seed, F.col("candidate_id"), F.col("row_id"))
    cand = cand.withColumn("h", h)
    firsts = cand.groupBy("candidate_id", "label").agg(F.min_by("row_id", F.struct("h", "row_id")).alias("row_id"))
    n_cls = firsts.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_cls"))
    rest = cand.join(firsts.select("candidate_id", "row_id"), ["candidate_id", "row_id"], "left_anti")
    w = Window.partitionBy("candidate_id").orderBy("h", "row_id")
    rest = (rest.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.lit(size))
            .join(F.broadcast(n_cls), "candidate_id").filter(F.col("pos") <= F.lit(size) - F.col("n_cls")))
    return firsts.select("candidate_id", "row_id").unionByName(rest.select("candidate_id", "row_id"))


# ---------------------------------------------------------------- C2, C3
def reduction(size: Column, n_classes: Column, max_size: int = MAX_SELECTION) -> Column:
    """0.5 (1 - s/500) + 0.5 (0.5 + 0.5 (1 - (log2 s - log2 C) / (log2 500 - log2 C)))."""
    lin = F.lit(1.0) - size / F.lit(float(max_size))
    lg = F.lit(1.0) - (F.log2(size) - F.log2(n_classes)) / (F.lit(math.log2(max_size)) - F.log2(n_classes))
    return 0.5 * lin + 0.5 * (0.5 + 0.5 * lg)


def fitness(val_auc: Column, red: Column, alpha: float, size: Column, all_classes: Column, max_size: int | None = None) -> Column:
    """Alpha * val_auc + (1 - alpha) * reduction; 0 if size < 2, a class is absent or, with ``max_size`` (the largest
    context a scorer takes; 20,000 in the published method), the subset is larger.  A classifier failure gives val_auc 0
    while the reduction part still counts."""
    f = F.lit(alpha) * F.coalesce(val_auc, F.lit(0.0)) + F.lit(1.0 - alpha) * red
    bad = (size < 2) | ~all_classes
    return F.when(bad if max_size is None else bad | (size > max_size), F.lit(0.0)).otherwise(f)


def candidate_metrics(cands: DataFrame, pool: DataFrame, val_auc: DataFrame, alpha: float = 0.5) -> DataFrame:
    """C3 over a population: size, classes present, reduction, fitness per candidate.
    ``val_auc`` is (candidate_id, val_auc) from a scorer run grouped by candidate (E1/E7)."""
    n_cls_pool = pool.select(F.count_distinct("label")).scalar()
    m = (cands.join(pool.select("row_id", "label"), "row_id")
         .groupBy("candidate_id").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("label").alias("n_cls")))
    m = m.join(val_auc, "candidate_id", "left").withColumn("n_classes", n_cls_pool)
    red = reduction(F.col("size").cast("double"), F.col("n_classes").cast("double"))
    return (m.withColumn("reduction", red)
            .withColumn("fitness", fitness(F.col("val_auc"), F.col("reduction"), alpha, F.col("size"),
                                           F.col("n_cls") == F.col("n_classes"))))


# ---------------------------------------------------------------- C4
def crossover(cands: DataFrame, pairs: DataFrame, seed: int, p_cross: float = 0.7) -> DataFrame:
    """C4: uniform crossover; ``pairs`` is (child_id, parent_a, parent_b).  Each row's membership is
    taken from parent a or b by a hash coin (prob 1/2); with prob 1 - p_cross the child copies a.  Children with the same
    ``coin_id`` (optional; the child's id without it) toss the same coins: with a and b swapped, each takes what the other leaves."""
    if "coin_id" not in pairs.columns:
        pairs = pairs.withColumn("coin_id", F.col("child_id"))
    a = cands.select(F.col("candidate_id").alias("parent_a"), "row_id", F.lit(1).alias("in_a"))
    b = cands.select(F.col("candidate_id").alias("parent_b"), "row_id", F.lit(1).alias("in_b"))
    pa = pairs.join(a, "parent_a")
    pb = pairs.join(b, "parent_b")
    j = pa.join(pb, ["child_id", "parent_a", "parent_b", "coin_id", "row_id"], "full_outer")
    coin = _h(seed, F.col("coin_id"), F.col("row_id")) % 2 == 0
    do_cross = (seeded_order(f"{seed}:x", F.col("coin_id")).cast("double") / 4294967296.0) < p_cross
    take_b = do_cross & coin
    on = F.when(take_b, F.coalesce("in_b", F.lit(0))).otherwise(F.coalesce("in_a", F.lit(0)))
    return j.filter(on == 1).select(F.col("child_id").alias("candidate_id"), "row_id").distinct()


# ---------------------------------------------------------------- C5, C6, C7, C8
def protected_rows(cands: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows that are the only selected row of their class in a candidate."""
    j = cands.join(pool.select("row_id", "label"), "row_id")
    w = Window.partitionBy("candidate_id", "label")
    return j.withColumn("n", F.count(F.lit(1)).over(w)).filter("n = 1").select("candidate_id", "row_id")


def mutation_counts(n_candidates: int, sizes: dict, n_genes: int, p_mut: float, seed: int) -> dict:
    """C5 counts on the driver (one small record per candidate): flips ~ Binomial(n, p) capped at
    min(10, size/2); adds and removes drawn independently at 40/60 (so adds + removes != flips)."""
    rng = np.random.default_rng(seed)
    out = {}
    for c in range(n_candidates):
        flips = min(int(rng.binomial(n_genes, p_mut)), 10, sizes.get(c, 0) // 2)
        adds = int(rng.binomial(flips, 0.4))
        removes = int(rng.binomial(flips, 0.6))
        out[c] = (adds, removes)
    return out


def mutate(cands: DataFrame, pool: DataFrame, counts: dict, seed: int) -> DataFrame:
    """C5 apply: remove the lowest-hash active rows, never the last one of a class (rows are ranked within their class
    and the highest-hash one of each class stays, as a check after every single removal would give), and add the
    lowest-hash inactive rows."""
    spark = cands.sparkSession
    cnt = F.broadcast(spark.createDataFrame([(int(c), int(a), int(r)) for c, (a, r) in counts.items()],
                                            "candidate_id long, n_add int, n_remove int"))
    own = cands.join(pool.select("row_id", "label"), "row_id").withColumn(
        "h", _h(f"{seed}r", F.col("candidate_id"), F.col("row_id")))
    last = own.groupBy("candidate_id", "label").agg(F.max_by("row_id", F.struct("h", "row_id")).alias("row_id"))
    active = cands.join(last.select("candidate_id", "row_id"), ["candidate_id", "row_id"], "left_anti")
    wr = Window.partitionBy("candidate_id").orderBy(_h(f"{seed}r", F.col("candidate_id"), F.col("row_id")), "row_id")
    rm = (active.withColumn("pos", F.row_number().over(wr)).filter(F.col("pos") <= 10)
          .join(cnt, "candidate_id").filter(F.col("pos") <= F.col("n_remove")).select("candidate_id", "row_id"))
    ids = cnt.select("candidate_id")
    inactive = (pool.select("row_id").withColumn("candidate_id", F.explode(F.array(*[F.lit(int(c)) for c in counts])))
                .join(cands, ["candidate_id", "row_id"], "left_anti"))
    wa = Window.partitionBy("candidate_id").orderBy(_h(f"{seed}a", F.col("candidate_id"), F.col("row_id")), "row_id")
    add = (inactive.withColumn("pos", F.row_number().over(wa)).filter(F.col("pos") <= 10)
           .join(cnt, "candidate_id").filter(F.col("pos") <= F.col("n_add")).select("candidate_id", "row_id"))
    kept = cands.join(ids, "candidate_id", "left_semi").join(rm, ["candidate_id", "row_id"], "left_anti")
    return kept.unionByName(add).distinct()


def repair(cands: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """Add one random row (min hash) of each class missing from a candidate."""
    ids = cands.select("candidate_id").distinct()
    classes = [r[0] for r in pool.select("label").distinct().collect()]  # class list, bounded
    want = ids.withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))
    have = cands.join(pool.select("row_id", "label"), "row_id").select("candidate_id", "label").distinct()
    miss = want.join(have, ["candidate_id", "label"], "left_anti")
    pick = (miss.join(pool.select("row_id", "label"), "label")
            .withColumn("h", _h(f"{seed}p", F.col("candidate_id"), F.col("row_id")))
            .groupBy("candidate_id", "label").agg(F.min_by("row_id", F.struct("h", "row_id")).alias("row_id")))
    return cands.unionByName(pick.select("candidate_id", "row_id"))


def shrink(cands: DataFrame, pool: DataFrame, target: int, seed: int) -> DataFrame:
    """Shrink every candidate to ``target`` rows at random, keeping protected rows (one row per class: the lowest
    hash), also where they outnumber the target."""
    h = _h(f"{seed}s", F.col("candidate_id"), F.col("row_id"))
    own = cands.join(pool.select("row_id", "label"), "row_id").withColumn("h", h)
    prot = own.groupBy("candidate_id", "label").agg(F.min_by("row_id", F.struct("h", "row_id")).alias("row_id"))
    prot = prot.select("candidate_id", "row_id", F.lit(0).alias("p"))
    j = cands.join(prot, ["candidate_id", "row_id"], "left").withColumn("p", F.coalesce("p", F.lit(1)))
    w = Window.partitionBy("candidate_id").orderBy("p", _h(f"{seed}s", F.col("candidate_id"), F.col("row_id")), "row_id")
    return j.withColumn("pos", F.row_number().over(w)).filter((F.col("pos") <= F.lit(target)) | (F.col("p") == 0)).select(
        "candidate_id", "row_id")


# ---------------------------------------------------------------- C9, C10
def flip_neighbours(cands: DataFrame, pool: DataFrame, attempts: int, seed: int, remove_share: float = 0.7) -> DataFrame:
    """``attempts`` single-flip neighbours per candidate (70 % removals of unprotected rows,
    30 % additions), as (candidate_id, flip_id, row_id, op) for scoring in one job."""
    n_rm = int(round(attempts * remove_share))
    prot = protected_rows(cands, pool)
    act = cands.join(prot, ["candidate_id", "row_id"], "left_anti")
    w1 = Window.partitionBy("candidate_id").orderBy(_h(f"{seed}f", F.col("candidate_id"), F.col("row_id")), "row_id")
    rm = act.withColumn("flip_id", F.row_number().over(w1) - 1).filter(F.col("flip_id") < n_rm) \
        .withColumn("op", F.lit("remove"))
    ids = [r[0] for r in cands.select("candidate_id").distinct().collect()]  # population ids, bounded
    inactive = (pool.select("row_id").withColumn("candidate_id", F.explode(F.array(*[F.lit(i) for i in ids])))
                .join(cands, ["candidate_id", "row_id"], "left_anti"))
    w2 = Window.partitionBy("candidate_id").orderBy(_h(f"{seed}g", F.col("candidate_id"), F.col("row_id")), "row_id")
    ad = (inactive.withColumn("flip_id", F.row_number().over(w2) - 1 + n_rm)
          .filter(F.col("flip_id") < attempts).withColumn("op", F.lit("add")))
    return rm.unionByName(ad)


def tournament(metrics: DataFrame, n_pairs: int, seed: int) -> DataFrame:
    """C10 selection: binary tournaments; each pick is the fitter of two different hash-chosen candidates (the only one,
    if the population is one)."""
    ids = metrics.select("candidate_id", "fitness")
    pop = ids.count()
    t = metrics.sparkSession.range(n_pairs * 2).withColumnRenamed("id", "slot")
    a = t.withColumn("candidate_id", seeded_order(f"{seed}:ta", F.col("slot")) % pop)
    step = F.lit(1) + seeded_order(f"{seed}:tb", F.col("slot")) % max(pop - 1, 1)
    b = t.withColumn("candidate_id", (seeded_order(f"{seed}:ta", F.col("slot")) + step) % pop)
    ranked = ids.withColumn("idx", F.row_number().over(Window.orderBy("candidate_id")) - 1)
    ja = a.join(ranked.select(F.col("idx").alias("candidate_id"), F.col("candidate_id").alias("ca"), F.col("fitness").alias("fa")), "candidate_id")
    jb = b.join(ranked.select(F.col("idx").alias("candidate_id"), F.col("candidate_id").alias("cb"), F.col("fitness").alias("fb")), "candidate_id")
    j = ja.drop("candidate_id").join(jb.drop("candidate_id"), "slot")
    return j.select("slot", F.when(F.col("fb") > F.col("fa"), F.col("cb")).otherwise(F.col("ca")).alias("winner"))


def elitist_replacement(old: DataFrame, new: DataFrame, population: int) -> DataFrame:
    """C10 replacement: the ``population`` fittest of parents and children (ties by id)."""
    return old.unionByName(new).orderBy(F.col("fitness").desc(), "candidate_id").limit(population)


# ---------------------------------------------------------------- C11, C12
def best_curve(entries: DataFrame, by=("dataset", "fold"), size: str = "size", score: str = "val_auc", tie: str | None = None) -> DataFrame:
    """C11 (set form): drop score <= 0, best score per size (of equal ones, the smallest ``tie``), keep entries whose score
    is at least the best score at every smaller-or-equal size."""
    g = list(by)
    pos = entries.filter(F.col(score) > 0)
    w1 = Window.partitionBy(*g, size).orderBy(F.col(score).desc(), *([tie] if tie else []))
    best = pos.withColumn("_r", F.row_number().over(w1)).filter("_r = 1").drop("_r")
    w2 = Window.partitionBy(*g).orderBy(size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return best.withColumn("_m", F.max(score).over(w2)).filter(F.col(score) >= F.col("_m")).drop("_m")


def history_summary(history: DataFrame, by=()) -> DataFrame:
    """Per (by..., initial_size, step): mean fitness, population std, best fitness and its candidate (of equal ones the
    lowest id)."""
    return history.groupBy(*by, "initial_size", "step").agg(
        F.avg("fitness").alias("mean_fitness"), F.stddev_pop("fitness").alias("std_fitness"),
        F.max("fitness").alias("best_fitness"),
        F.max_by("candidate_id", F.struct(F.col("fitness"), -F.col("candidate_id"))).alias("best_candidate"))


# ---------------------------------------------------------------- C14, C15
def kernel_smoother(points: DataFrame, n_grid: int = 200, x: str = "size", y: str = "auc", by: str = "dataset") -> DataFrame:
    """C14 for every dataset at once: Nadaraya-Watson smoother of y against log10(size), points pooled over folds, n_grid
    points between the dataset's smallest and largest log size, Gaussian weights with bandwidth log10(n_train) / 100;
    weighted mean and weighted std.  ``points`` also has ``n_train``.  The grid is exploded per point and summed
    map-side; the ends of the grid come from an aggregate joined back, so no job runs while the plan is built."""
    p = points.select(by, F.log10(F.col(x).cast("double")).alias("lx"), F.col(y).cast("double").alias("y"),
                      (F.log10(F.col("n_train").cast("double")) / 100.0).alias("bw"))
    ends = p.groupBy(by).agg(F.min("lx").alias("lo"), F.max("lx").alias("hi"))
    g = p.join(ends, by).withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    gx = F.col("lo") + F.col("gi") * (F.col("hi") - F.col("lo")) / F.lit(max(n_grid - 1, 1))
    wgt = F.exp(-0.5 * ((F.col("gx") - F.col("lx")) / F.col("bw")) ** 2)
    s = g.withColumn("gx", gx).withColumn("w", wgt).groupBy(by, "gi", "gx").agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("swy"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("swyy"))
    mean = F.col("swy") / F.col("sw")
    return s.select(by, "gi", (F.lit(10.0) ** F.col("gx")).alias("size"), mean.alias("mean"),
                    F.sqrt(F.greatest(F.col("swyy") / F.col("sw") - mean * mean, F.lit(0.0))).alias("std"))


def pair_random_and_curve(random_scores: DataFrame, curve: DataFrame, budgets: DataFrame,
                          by=("dataset", "fold")) -> DataFrame:
    """For each budget n, the random score at the largest random size <= n and the curve score at
    the largest curve size <= n (two chained as-of lookups)."""
    from tessera.operators.select import curve_lookup
    r = curve_lookup(random_scores, budgets, by).withColumnRenamed("size", "random_size")
    c = curve_lookup(curve, budgets, by).withColumnRenamed("size", "curve_size")
    return r.join(c, list(by) + ["n_selected"], "inner")


# ---------------------------------------------------------------- C9 (apply), C13, C16
def flipped_members(cands: DataFrame, flips: DataFrame) -> DataFrame:
    """Membership of every flip neighbour: (candidate_id, flip_id, row_id).  Additions add the row,
    removals drop it; the base membership is replicated per flip (bounded: size x attempts)."""
    ids = flips.select("candidate_id", "flip_id").distinct()
    base = cands.join(ids, "candidate_id")
    rm = flips.filter("op = 'remove'").select("candidate_id", "flip_id", "row_id")
    add = flips.filter("op = 'add'").select("candidate_id", "flip_id", "row_id")
    return base.join(rm, ["candidate_id", "flip_id", "row_id"], "left_anti").unionByName(add)


def local_search_step(cands: DataFrame, metrics: DataFrame, flip_metrics: DataFrame) -> DataFrame:
    """C9 keep-best: per candidate, the best flip if it beats the candidate's fitness.
    ``flip_metrics`` is (candidate_id, flip_id, fitness) for all flips scored in one job.
    Returns (candidate_id, flip_id or NULL when the candidate stays)."""
    whole = F.round("fitness", 9)  # sums differ in the last bits by the order of addition
    best = flip_metrics.groupBy("candidate_id").agg(
        F.max_by(F.struct("flip_id", whole.alias("fitness")), F.struct(whole, -F.col("flip_id"))).alias("b"))
    j = best.join(metrics.select("candidate_id", whole.alias("f0")), "candidate_id")
    return j.select("candidate_id", F.when(F.col("b.fitness") > F.col("f0"), F.col("b.flip_id")).alias("flip_id"))


def size_ladder(targets: list[int], reached: int) -> list[int]:
    """Target sizes still to search (descending), dropping those the curve already reached
    (reached = smallest size in the curve)."""
    return [t for t in sorted(set(targets), reverse=True) if t < reached]
