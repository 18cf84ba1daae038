"""The supervised subset search (C9, C10, C13, C16): generations over a population, a patience stop and a size ladder.

The loop runs on the driver and holds one small record per candidate; memberships, scoring and every genetic step are
DataFrame work over all candidates of a generation at once (``operators.search``).  Memberships live in an append-only
archive (``operators.search_archive``): a candidate that changes gets a new id, so every curve entry can be refitted
on the rows it was scored on, and no lineage grows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import TWO_POW_32
from tessera.operators import search as C
from tessera.operators.search_archive import CandidateArchive
from tessera.session import cut_lineage

MEMBER = ["candidate_id", "row_id"]
ENTRY = "size int, val_auc double, fitness double, candidate_id long"


@dataclass
class SearchRun:
    """What a run leaves: history rows (initial_size, step, candidate_id, fitness) of every generation's population, curve
    entries (size, val_auc, fitness, candidate_id) of every candidate that was scored, the archive with the members of all
    of them, and the ids of the last population."""
    archive: CandidateArchive
    history: list = field(default_factory=list)
    entries: list = field(default_factory=list)
    last: list = field(default_factory=list)

    @property
    def population(self) -> DataFrame:
        return self.archive.members(self.last)

    def curve(self) -> DataFrame:
        """The best-so-far curve (C11) over all entries of the run."""
        rows = self.archive.spark.createDataFrame(self.entries, ENTRY)
        return C.best_curve(rows.withColumn("run", F.lit(0)), by=("run",), tie="candidate_id").drop("run")

    def curve_members(self) -> DataFrame:
        """(size, val_auc, fitness, candidate_id, row_id): every point of the curve with its rows."""
        points = self.curve()
        ids = [r.candidate_id for r in points.select("candidate_id").collect()]  # one id per size, bounded by the ladder
        return points.join(self.archive.members(ids), "candidate_id")


def _records(metrics: DataFrame) -> list:
    """(fitness, -id, size, val_auc), best first: one record per candidate of a population, bounded."""
    return sorted(((float(r.fitness), -int(r.candidate_id), int(r["size"]), float(r.val_auc or 0.0)) for r in metrics.collect()), reverse=True)


def improving_flips(cands: DataFrame, train: DataFrame, score: Callable[[DataFrame], DataFrame], attempts: int, seed: int) -> DataFrame:
    """All flips of every candidate are scored in one job; the best flip of each candidate that it improves, as
    (candidate_id, row_id, op)."""
    flips = cut_lineage(C.flip_neighbours(cands, train, attempts, seed))
    keyed = C.flipped_members(cands, flips).withColumn("candidate_id", F.col("candidate_id") * attempts + F.col("flip_id"))
    scored = score(cut_lineage(keyed.select(*MEMBER))).select(F.floor(F.col("candidate_id") / attempts).cast("long").alias("candidate_id"),
                                                 F.pmod("candidate_id", F.lit(attempts)).cast("int").alias("flip_id"), "fitness")
    step = C.local_search_step(cands, score(cands), scored).filter("flip_id is not null")
    return flips.join(step, ["candidate_id", "flip_id"], "left_semi").select(*MEMBER, "op")


def flipped(cands: DataFrame, chosen: DataFrame) -> DataFrame:
    """The memberships after the chosen flips."""
    return cands.join(chosen.filter("op = 'remove'").select(*MEMBER), MEMBER, "left_anti").select(*MEMBER).unionByName(
        chosen.filter("op = 'add'").select(*MEMBER))


def local_search(cands: DataFrame, train: DataFrame, score: Callable[[DataFrame], DataFrame], attempts: int, seed: int) -> DataFrame:
    """C9 over a population: the memberships after each candidate's best improving flip."""
    return cut_lineage(flipped(cands, improving_flips(cands, train, score, attempts, seed)))


def _promising(kids: list, worst: float, seed: int, share: float, small: int) -> list[int]:
    """Children that local search is spent on: better than the worst of the population, smaller than ``small`` rows, or
    drawn with probability ``share`` (the seeded order of ``functions.hashing``, of an id on the driver)."""
    lot = lambda i: int(md5(f"{seed}:ls|{i}".encode()).hexdigest()[:8], 16) / TWO_POW_32
    return [-i for f, i, size, _ in kids if f > worst or size < small or lot(-i) < share]


def search(train: DataFrame, score: Callable[[DataFrame], DataFrame], targets: list[int], population: int = 20, patience: int = 70,
           max_steps: int = 500, p_cross: float = 0.7, p_mut: float = 0.01, local_attempts: int = 10, seed: int = 42, pairs: int = 1,
           local_share: float = 0.0625, local_size: int = 50, archive: CandidateArchive | None = None) -> SearchRun:
    """C10/C16.  ``score(members) -> (candidate_id, size, val_auc, fitness)``.  For each target size still above what the
    curve has reached, descending: the population starts at random (first size) or is shrunk to the size (C8).  A
    generation picks ``pairs`` pairs of parents by tournament; uniform crossover gives each pair two children that share
    out their genes, which are mutated, repaired and scored; promising children go through local search in the same
    generation (C9), as one scoring job over all their flips; the fittest of old and new stay.  A size ends after
    ``patience`` generations without a better best, or ``max_steps``."""
    spark = train.sparkSession
    run = SearchRun(archive or CandidateArchive(spark))
    store, train = run.archive, train.persist()
    n_genes, step_seed, best = train.count(), seed, []
    ladder, smallest = sorted(set(targets), reverse=True), None

    def scored(members: DataFrame, numbers: dict | None) -> list:
        """Archive new candidates and score what the archive holds."""
        first = store.batches
        store.add(members, numbers)
        return _records(score(store.members().where(F.shiftright("candidate_id", 20) == first)))

    def entered(rows: list) -> None:
        run.entries.extend((s, a, f, -i) for f, i, s, a in rows)

    while ladder:
        target = ladder[0]
        if not best:
            best = scored(C.random_candidates(train, population, target, seed), None)
        else:
            old = [-i for _, i, _, _ in best]
            best = scored(C.shrink(store.members(old), train, target, step_seed), {c: k for k, c in enumerate(old)})
        entered(best)
        smallest = min(s for _, _, s, _ in best)
        stale = step = 0
        run.history += [(target, step, -i, f) for f, i, _, _ in best]
        while step < max_steps and stale < patience:
            step, step_seed = step + 1, step_seed + 1
            metrics = spark.createDataFrame([(-i, f) for f, i, _, _ in best], "candidate_id long, fitness double")
            won = [int(r.winner) for r in C.tournament(metrics, pairs, step_seed).orderBy("slot").collect()]
            plan = []
            for k in range(0, len(won) - 1, 2):  # two children a pair: what one leaves of a parent the other takes
                plan += [(k, won[k], won[k + 1], k), (k + 1, won[k + 1], won[k], k)]
            kids = cut_lineage(C.crossover(store.members(won), spark.createDataFrame(
                plan, "child_id long, parent_a long, parent_b long, coin_id long"), step_seed, p_cross))
            sizes = {r[0]: r[1] for r in kids.groupBy("candidate_id").count().collect()}
            drawn = C.mutation_counts(len(plan), sizes, n_genes, p_mut, step_seed)
            new = scored(C.repair(C.mutate(kids, train, drawn, step_seed), train, step_seed), None)
            chosen = _promising(new, best[-1][0], step_seed, local_share, local_size) if local_attempts else []
            if chosen:
                own = store.members(chosen)
                flips = cut_lineage(improving_flips(own, train, score, local_attempts, step_seed))
                moved = sorted(r.candidate_id for r in flips.select("candidate_id").distinct().collect())
                if moved:
                    better = scored(flipped(store.members(moved), flips), {c: k for k, c in enumerate(moved)})
                    new = sorted([r for r in new if -r[1] not in moved] + better, reverse=True)
            entered(new)
            smallest = min([smallest, *(s for _, _, s, _ in new)])
            both = sorted(best + new, reverse=True)[:population]
            stale = 0 if both[0][0] > best[0][0] else stale + 1
            best = both
            run.history += [(target, step, -i, f) for f, i, _, _ in best]
        ladder = [t for t in C.size_ladder(ladder, smallest) if t < target]
    run.last = [-i for _, i, _, _ in best]
    train.unpersist()
    return run


def evaluate_curve(points: DataFrame, score_test: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each point of a curve refitted on its own rows and scored on the test fold.  ``points`` is one row per member
    (size, val_auc, candidate_id, row_id), as ``SearchRun.curve_members`` or ``stored_curve_members`` give it; the result
    has (size, val_auc, candidate_id, metric, value), one row per metric of ``score_test(members) -> (candidate_id, metric,
    value)``.  A point with another number of rows than its size is an error: its members are not those it was scored on."""
    sizes = points.groupBy("candidate_id", "size", "val_auc").agg(F.count(F.lit(1)).alias("n"))
    right = F.when(F.col("n") == F.col("size"), F.col("size")).otherwise(F.raise_error(F.format_string(
        "curve point %s has %s rows instead of %s", "candidate_id", "n", "size")).cast("int"))
    sizes = sizes.select("candidate_id", right.alias("size"), "val_auc")
    return sizes.join(score_test(points.select(*MEMBER)), "candidate_id").select("size", "val_auc", "candidate_id", "metric", "value")


def stored_curve_members(curve: DataFrame, pool: DataFrame, by=("dataset", "fold")) -> DataFrame:
    """The members of stored curves (S5): ``curve`` has ``genes``, one 0/1 per row of its training pool in row order; ``pool``
    is (by..., row_id).  Returns (by..., size, val_auc, candidate_id, row_id); the candidate of a size is its size."""
    g = list(by)
    on = curve.select(*g, "size", "val_auc", F.posexplode("genes").alias("gene", "on")).where("on = 1").drop("on")
    # a curve's genes are one value, so the pool of one curve can be ranked in one task
    w = C.Window.partitionBy(*g).orderBy("row_id")
    rows = pool.select(*g, "row_id").withColumn("gene", F.row_number().over(w) - 1)
    return on.join(rows, [*g, "gene"]).select(*g, "size", "val_auc", F.col("size").cast("long").alias("candidate_id"), "row_id")


def curve_genes(members: DataFrame, pool: DataFrame, by=("dataset", "fold")) -> DataFrame:
    """(by..., candidate_id, genes): the 0/1 genes of each candidate over its training pool in row order, as curve files hold
    them; ``members`` is (by..., candidate_id, row_id)."""
    g = list(by)
    ids = members.select(*g, "candidate_id").distinct()
    on = members.select(*g, *MEMBER).withColumn("on", F.lit(1))
    every = ids.join(pool.select(*g, "row_id"), g).join(on, [*g, *MEMBER], "left")
    pair = F.struct("row_id", F.coalesce("on", F.lit(0)).alias("on"))
    return every.groupBy(*g, "candidate_id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["on"]).alias("genes"))
