"""Budget and size grids (P13-P15), run matrix (I20), entry smoke check."""

from tessera.operators import prep as P
from tessera.operators import select as S


def test_budget_grid_rounds_half_even_and_clamps():
    # round(0.25 * 10) = 2 (half to even), 32 * 3 clamps to 10
    assert P.budget_grid(10, 3, percentages=(0.25,), multipliers=(1, 2, 32)) == [10, 6, 3, 2]


def test_search_and_comparison_sizes():
    assert P.train_size(100, 10) == 90
    assert P.search_sizes([200], 400, 3) == [100, 96, 48, 24, 12, 6, 3]
    assert P.search_sizes([250, 180, 100, 50], 4000, 2) == [250, 180, 128, 100, 64, 50, 32, 16, 8, 4, 2]
    assert P.comparison_sizes(400, 3) == [3, 6, 12, 24, 48, 96]


def test_run_matrix(spark):
    t = S.run_matrix(spark, ["Orig", "Emb"], ["Random", "All"], [4, 8], {"Random": 5}, folds=(0, 1))
    assert t.count() == 2 * (5 + 1) * 2 * 2
    seeds = {r.seed for r in t.filter("method = 'Random'").select("seed").distinct().collect()}
    assert seeds == {42, 43, 44, 45, 46}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields] == ["cluster", "medoid", "size", "cost"]
    assert len(rows) == 10 and sum(r["size"] for r in rows) == 500
