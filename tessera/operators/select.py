"""Label-free and balanced selection operators.

A selection is a set of ``row_id`` values of the pool.  All random choices are
seeded hash orders of ``row_id`` (``tessera.functions.hashing``), so results do
not depend on partitioning.

Top-n per group is written as ``row_number() over (...) <= literal``: Spark
plans that as a window group limit, which keeps at most n rows per group in
each map partition *before* the shuffle, so a class that holds a third of the
pool never sorts in one task.  Budgets nest (the top-n for a smaller n is a
prefix of the top-n for a larger one), so every budget and seed comes out of
one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_hex, seeded_order
from tessera.functions.joins import small_broadcast


def _seeds_budgets(spark, seeds, budgets) -> DataFrame:
    return spark.createDataFrame([(int(s), int(n)) for s in seeds for n in budgets], "seed int, n_selected int")


# ---------------------------------------------------------------- I1, I2
def random_selection(pool: DataFrame, budgets, seeds, key: str = "row_id") -> DataFrame:
    """Uniform selection without replacement for every (seed, budget).

    Output (seed, n_selected, row_id, pos).  n >= N gives the whole pool (I2).
    """
    budgets, seeds = list(budgets), list(seeds)
    n_max = max(budgets)
    # the keys alone are dealt out first: a scan of few row groups would leave all seeds' hashes to few tasks
    per_seed = pool.select(key).repartition(key).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    w = Window.partitionBy("seed").orderBy(seeded_hex(F.col("seed"), F.col(key)), F.col(key))
    top = per_seed.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.lit(n_max))
    grid = small_broadcast(_seeds_budgets(pool.sparkSession, seeds, budgets))
    return top.join(grid, "seed").filter(F.col("pos") <= F.col("n_selected")).select("seed", "n_selected", key, "pos")


# ---------------------------------------------------------------- I3, I4
def min_one_per_class(pool: DataFrame, n: int, seed: int, label: str = "label", key: str = "row_id") -> DataFrame:
    """I4: one random row per class (min hash per class: a partial aggregate, skew-safe), then
    uniform over the remaining rows up to n.  I3: if n < #classes, plain random selection."""
    n_classes = pool.select(F.count_distinct(label)).first()[0]
    if n < n_classes:
        return random_selection(pool, [n], [seed], key).select(key)
    h = seeded_order(seed, F.col(key))
    firsts = pool.groupBy(label).agg(F.min_by(F.col(key), F.struct(h, F.col(key))).alias(key)).select(key)
    rest = (pool.select(key).join(firsts, key, "left_anti")
            .orderBy(seeded_order(seed, F.col(key)), F.col(key)).limit(max(n - n_classes, 0)))
    return firsts.unionByName(rest)


# ---------------------------------------------------------------- I5
def balanced_quotas(sizes: DataFrame, n: int, seed: int, label: str = "label", size: str = "size") -> DataFrame:
    """(label, quota) from one row per class (label, size).

    Every class gets an even share of n, or all its rows.  The seats left over go round by round, one a class, to the
    classes with room, those with most room first (ties by a seeded hash) - so that all classes with more room than the
    number of whole rounds gain that number, the smaller ones are used up, and the last, broken round seats the roomiest.
    The number of whole rounds follows from the running sum of the sorted rooms; nothing is dealt seat by seat."""
    whole = Window.partitionBy()  # one row per class
    q = sizes.select(label, F.col(size).cast("long").alias("_size")).withColumn("_k", F.count(F.lit(1)).over(whole))
    q = q.withColumn("_share", F.least(F.col("_size"), F.floor(F.lit(n) / F.col("_k"))))
    q = q.withColumn("_room", F.col("_size") - F.col("_share")).withColumn("_left", F.lit(n) - F.sum("_share").over(whole))
    rising = whole.orderBy("_room", label)
    # seats taken when every class has had as many rounds as this class has room
    used = F.coalesce(F.sum("_room").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) \
        + (F.col("_k") - F.row_number().over(rising) + 1) * F.col("_room")
    q = q.withColumn("_used", used)
    done = F.col("_used") <= F.col("_left")
    q = q.withColumn("_from", F.coalesce(F.max(F.when(done, F.col("_room"))).over(whole), F.lit(0)))
    q = q.withColumn("_spent", F.coalesce(F.max(F.when(done, F.col("_used"))).over(whole), F.lit(0)))
    open_classes = F.sum((F.col("_room") > F.col("_from")).cast("long")).over(whole)
    q = q.withColumn("_open", open_classes).withColumn("_more", F.col("_left") - F.col("_spent"))
    rounds = F.col("_from") + F.when(F.col("_open") > 0, F.floor(F.col("_more") / F.col("_open"))).otherwise(0)
    broken = F.when(F.col("_open") > 0, F.col("_more") % F.col("_open")).otherwise(0)
    roomiest = F.row_number().over(whole.orderBy(F.desc("_room"), seeded_order(seed, F.col(label)), label))
    extra = F.least(F.col("_room"), rounds) + ((roomiest <= broken) & (F.col("_room") > rounds)).cast("long")
    return q.select(label, (F.col("_share") + extra).cast("int").alias("quota"))


def balanced_selection(pool: DataFrame, n: int, seed: int, label: str = "label", key: str = "row_id") -> DataFrame:
    """Per-class quotas, rows by seeded hash within the class (window group limit; no quota is above n)."""
    quota = balanced_quotas(pool.groupBy(label).agg(F.count(F.lit(1)).alias("size")), n, seed, label)
    w = Window.partitionBy(label).orderBy(seeded_order(seed, F.col(key)), F.col(key))
    top = pool.select(key, label).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.lit(n))
    quota = quota.select(F.col(label).alias("_label"), "quota")
    return top.join(quota, top[label].eqNullSafe(quota["_label"])).filter(F.col("pos") <= F.col("quota")).select(key, label)


# ---------------------------------------------------------------- I15
def top_by_score(scores: DataFrame, budgets, score: str = "score", key: str = "row_id", by=()) -> DataFrame:
    """Top-n rows by score (desc, ties by row_id) for every budget; budgets nest."""
    budgets = list(budgets)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key)) if by else \
        Window.orderBy(F.col(score).desc(), F.col(key))
    if not by:
        # no grouping: TakeOrdered of the largest budget, then rank inside that bounded set
        top = scores.orderBy(F.col(score).desc(), F.col(key)).limit(max(budgets))
        top = top.withColumn("pos", F.row_number().over(w))
    else:
        top = scores.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= F.lit(max(budgets)))
    # every budget the row falls inside (budgets nest): an explode, no theta join
    arr = F.array(*[F.lit(int(x)) for x in sorted(set(budgets))])
    return (top.withColumn("n_selected", F.explode(F.filter(arr, lambda b: b >= F.col("pos"))))
            .select(*by, "n_selected", key, score, "pos"))


# ---------------------------------------------------------------- I16, I21
def curve_lookup(curve: DataFrame, budgets: DataFrame, by=("dataset", "fold")) -> DataFrame:
    """I16 backward as-of join: for each budget the stored candidate with the largest size <= n.

    ``curve`` has (by..., size, ...payload); ``budgets`` has (by..., n_selected).  Budgets with
    no smaller-or-equal entry drop (empty selection, skipped).  Equi-join on ``by`` plus the
    size condition, then ``max_by`` per budget.
    """
    by = list(by)
    payload = [c for c in curve.columns if c not in by]
    j = budgets.join(curve, by).filter(F.col("size") <= F.col("n_selected"))
    return (j.groupBy(*by, "n_selected")
            .agg(F.max_by(F.struct(*payload), F.col("size")).alias("hit"))
            .select(*by, "n_selected", "hit.*"))


def runs_with_curve(curve: DataFrame, by=("dataset", "fold")) -> DataFrame:
    """Runs that have a non-empty stored curve."""
    return curve.filter(F.col("size") > 0).select(*by).distinct()


# ---------------------------------------------------------------- I17, I18, I19, I20
def normalise_selection(selected: DataFrame, pool: DataFrame, key: str = "row_id") -> DataFrame:
    """Deduplicate and drop ids that are not in the pool."""
    return selected.select(key).distinct().join(pool.select(key), key, "left_semi")


def apply_selection(original: DataFrame, selected: DataFrame, key: str = "row_id") -> DataFrame:
    """The original rows (not the embedding rows) of a selection."""
    return original.join(selected.select(key).distinct(), key, "left_semi")


def class_coverage(pool: DataFrame, selected: DataFrame, label: str = "label", key: str = "row_id",
                   by=()) -> DataFrame:
    """Classes in the pool vs classes in the selection, and their ratio."""
    sel = pool.join(selected.select(*by, key), list(by) + [key], "inner") if by else \
        pool.join(selected.select(key), key, "left_semi")
    a = pool.groupBy().agg(F.count_distinct(label).alias("pool_classes"))
    b = sel.groupBy(*by).agg(F.count_distinct(label).alias("selected_classes"))
    j = b.withColumn("pool_classes", a.select("pool_classes").scalar())
    return j.withColumn("class_discovery", F.col("selected_classes") / F.col("pool_classes"))


def run_matrix(spark, spaces, methods, budgets, seeds_per_method: dict, base_seed: int = 42,
               folds=(0,)) -> DataFrame:
    """Task table space x method x budget x seed (base_seed + i) x fold, built with explode."""
    rows = [(s, m, int(seeds_per_method.get(m, 1))) for s in spaces for m in methods]
    t = spark.createDataFrame(rows, "space string, method string, runs int")
    return (t.withColumn("n_selected", F.explode(F.array(*[F.lit(int(b)) for b in budgets])))
            .withColumn("seed", F.explode(F.sequence(F.lit(base_seed), F.lit(base_seed) + F.col("runs") - 1)))
            .withColumn("fold", F.explode(F.array(*[F.lit(int(f)) for f in folds])))
            .drop("runs"))
