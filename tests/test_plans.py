"""Physical-plan properties the scale design relies on."""

import __spark_entry__ as E
from tessera.operators import results as G
from tessera.plans import analysis as A
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_uses_partial_window_group_limit(spark):
    for name in ("random_selection", "balanced_selection"):
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_aggregation_prunes_columns_and_combines_map_side(spark):
    p = plan(E.queries()["cell_means"](spark, SF_SMALL))
    assert "partial_avg" in p
    scan = [line for line in p.splitlines() if "lineitem.parquet" in line]
    assert scan and all("l_shipdate" not in line and "l_tax" not in line for line in scan)


def test_no_cartesian_or_nested_loop_joins(spark):
    for name in ("cell_means", "wide_table", "mean_ranks", "wilcoxon_pairs", "leave_one_dataset_out",
                 "missing_cells", "missing_metrics", "metrics_events", "top_by_score"):
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_keep_last_dedupe_is_an_aggregate(spark):
    p = plan(G.dedupe_batch(A.fact(spark, SF_SMALL), "value"))
    assert "Window" not in p and "max_by" in p
