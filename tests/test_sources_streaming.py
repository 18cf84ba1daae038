"""Result-file scan (S1-S3), keyed merge (S6), keyed store (S7-S11) and the streaming sink."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.herding import rdss
from tessera.plans import fixtures as FX
from tessera.sources.commits import CommitLog
from tessera.sources.results_io import (SelectionStore, RunStore, embedding_store, merge_results, prediction_store, scan_result_files,
                                        score_store)
from tessera.streaming.result_sink import read_results, result_stream, start_result_sink, upsert_batch
from tests.conftest import SF_SMALL

COLS = ["dataset", "fold", "space", "method", "n_selected", "seed", "evaluator", "metric", "value"]


def _write_csv(folder, name, rows, cols):
    os.makedirs(folder, exist_ok=True)
    pd.DataFrame(rows, columns=cols).to_csv(os.path.join(folder, name), index=False)


def test_scan_old_and_new_layout(spark, tmp_path):
    d = str(tmp_path / "raw")
    _write_csv(d, "exp_f0.csv", [["ds1", 0, "Orig", "Random", 4, 42, "KNN", "AUC", "0.7"],
                                 ["ds1", 0, "Orig", "Random", 4, 43, "KNN", "AUC", "oops"]], COLS)
    old = ["dataset", "instance_selection_space", "instance_selection_algorithm", "n_selected_samples",
           "evaluation_method", "AUC"]
    _write_csv(d, "exp_f1.csv", [["ds2", "Orig", "All", 100, "KNN", 0.9]], old)
    df = scan_result_files(spark, d + "/*.csv")
    got = {(r.dataset, r.fold, r.metric, r.seed, r.value) for r in df.collect()}
    assert got == {("ds1", 0, "AUC", 42, 0.7), ("ds1", 0, "AUC", 43, None), ("ds2", 1, "AUC", None, 0.9)}


def test_scan_quotes_and_broken_files(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "q_f3.csv").write_text('"dataset",fold,space,method,n_selected,seed,evaluator,metric,value,note\r\n'
                                '"a, ""b""",,Orig,R,4,,K,AUC,0.5,"x,y"\r\n\r\nc,2,Orig,R,4,42,K,F1,NaN,\r\n')
    got = {(r.dataset, r.fold, r.seed, r.metric, r.value, r.source_file) for r in scan_result_files(spark, str(d / "*.csv")).collect()}
    assert got == {('a, "b"', None, None, "AUC", 0.5, "q_f3.csv"), ("c", 2, 42, "F1", None, "q_f3.csv")}
    assert {r.dataset for r in scan_result_files(spark, str(d / "*.csv"), folds=[2]).collect()} == {"c"}
    (d / "bad_f1.csv").write_text("dataset,space,n_selected,value\nd,Orig,3,0.5\n")
    with pytest.raises(Exception, match="lacks column method"):
        scan_result_files(spark, str(d / "*.csv")).collect()
    with pytest.raises(Exception, match="lacks a header"):
        (d / "bad_f1.csv").write_text("d,Orig,3,0.5\n")
        scan_result_files(spark, str(d / "*.csv")).collect()


def test_merge_results_null_safe(spark):
    schema = "dataset string, fold int, space string, method string, n_selected int, seed int, " \
             "evaluator string, metric string, value double"
    old = spark.createDataFrame([("d", 0, "O", "All", 1, None, "K", "AUC", 0.5)], schema)
    new = spark.createDataFrame([("d", 0, "O", "All", 1, None, "K", "AUC", 0.9),
                                 ("d", 0, "O", "R", 1, 42, "K", "AUC", 0.1)], schema)
    keep = {r.value for r in merge_results(old, new).collect()}
    assert keep == {0.5, 0.1}
    rep = {r.value for r in merge_results(old, new, recompute=True).collect()}
    assert rep == {0.9, 0.1}


def test_store_read_through(spark, tmp_path):
    st = RunStore(spark, str(tmp_path / "store"), ["dataset", "fold"])
    wanted = spark.createDataFrame([("a", 0), ("b", None), ("c", 2)], "dataset string, fold int")
    calls = []

    def compute(todo):
        calls.append(todo.count())
        return todo.filter("dataset <> 'c'").withColumn("score", F.lit(1.0))
    assert st.get_or_compute(wanted.filter("dataset = 'a'"), compute).count() == 1
    assert st.get_or_compute(wanted, compute).count() == 2
    assert st.get_or_compute(wanted, compute).count() == 2  # a run without rows is stored as such
    assert calls == [1, 2]


RUN = "dataset string, fold int, space string, method string, n_selected int, seed int"


def test_selection_store_replaces_stale_and_partial_runs(spark, tmp_path):
    path, calls = str(tmp_path / "sel"), []
    wanted = spark.createDataFrame([("d", 0, "Orig", "Random", 3, 42), ("d", 0, "Orig", "All", 99, None)], RUN)

    def compute(size, short=0):
        def run(todo):
            calls.append(sorted(r.method for r in todo.collect()))
            n = F.least("n_selected", F.lit(size)) - short
            return todo.select(*SelectionStore.KEY, "pool_size", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))).alias("row_id"))
        return run

    def rows(size, **options):
        return SelectionStore(spark, path, size).get_or_compute(wanted, compute(size, **options))
    on_disk = lambda: CommitLog(spark, path).read("rows").count()
    assert rows(5).count() == 3 + 5 and rows(5).count() == 8 and on_disk() == 8
    # a pool of another size: both runs are computed again once, and only the new ones are read
    assert rows(10).count() == 3 + 10 and on_disk() == 8 + 13
    assert {r.pool_size for r in rows(10).collect()} == {10} and on_disk() == 8 + 13
    # a run stored in part never fits, and is replaced as a whole by the next one
    assert rows(20, short=1).count() == 2 + 19
    assert rows(20).count() == 3 + 20 and rows(20).count() == 23
    assert calls == [["All", "Random"]] * 4
    # back to the first size: the newest generation counts, not any older one that would fit
    assert rows(5).count() == 8 and len(calls) == 5


def test_a_part_without_commit_is_not_read(spark, tmp_path):
    st = RunStore(spark, str(tmp_path / "store"), ["run"])
    rows = spark.createDataFrame([(1, 0.5)], "run int, value double")
    st.log.stage("rows", "p-dead", rows)
    st.log.stage("runs", "p-dead", rows.select("run", F.lit(1).cast("long").alias("n_rows")))
    assert st.read().count() == 0 and st.missing(rows.select("run")).count() == 1
    st.replace(rows.select("run"), rows)
    assert st.read().count() == 1 and st.missing(rows.select("run")).isEmpty()


def test_commits_are_ordered_by_time(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert [log.commit(p) for p in ("p-b", "p-a", "p-c")] == [1, 2, 3]
    (tmp_path / "log" / "commits" / "000000000004.json").touch()  # a writer that died between taking a number and writing
    assert log.commit("p-d") == 5
    assert [r.part for r in log.commits().orderBy("seq").collect()] == ["p-b", "p-a", "p-c", "p-d"]
    assert log.committed("p-a") and not log.committed("p-x")


def test_stores_of_predictions_embeddings_and_scores(spark, tmp_path):
    for make, key in ((prediction_store, dict(dataset="d", fold=0, space="Emb", method="Random", n_selected=4, seed=42, evaluator="KNN")),
                      (embedding_store, dict(dataset="d", fold=0, split="train", encoder="toy")), (score_store, dict(dataset="d", fold=0, space="Emb"))):
        st = make(spark, str(tmp_path / make.__name__))
        wanted = spark.createDataFrame([tuple(key.values())], list(key)).withColumn("n_rows", F.lit(3).cast("long"))
        made = []
        rows = lambda n: lambda todo: (made.append(n), todo.withColumn("row_id", F.explode(F.sequence(F.lit(1), F.lit(n)))))[1]
        assert st.get_or_compute(wanted, rows(2)).count() == 2  # short of a row: computed again
        assert st.get_or_compute(wanted, rows(3)).count() == 3 and st.get_or_compute(wanted, rows(9)).count() == 3
        assert made == [2, 3]


def test_streaming_sink_is_idempotent(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "dataset string, fold int, space string, method string, n_selected int, seed int, " \
             "evaluator string, metric string, value double"
    rows = [("d", 0, "O", "R", 4, 42, "K", "AUC", 0.5), ("d", 1, "O", "All", 100, None, "K", "AUC", 0.9)]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(src + "/b0")
    q = start_result_sink(result_stream(spark, src + "/*"), out, ck)
    q.awaitTermination()
    # the same rows arrive again in a new file: nothing is added
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(src + "/b1")
    q = start_result_sink(result_stream(spark, src + "/*"), out, ck)
    q.awaitTermination()
    assert read_results(spark, out).count() == 2
    assert spark.read.parquet(out + "/rows").count() == 2


SINK = "dataset string, fold int, space string, method string, n_selected int, seed int, evaluator string, metric string, value double"


def _row(value, fold=0, seed=42):
    return ("d", fold, "O", "R", 4, seed, "K", "AUC", value)


def test_recompute_sink_keeps_what_was_committed_last(spark, tmp_path):
    """Many batches under one checkpoint, then a new checkpoint whose batch ids start again: the new row wins."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def drop(name, rows):
        spark.createDataFrame(rows, SINK).coalesce(1).write.mode("overwrite").parquet(f"{src}/{name}")

    def run(checkpoint):
        start_result_sink(result_stream(spark, src + "/*"), out, str(tmp_path / checkpoint), recompute=True).awaitTermination()
        return {(r.fold, r.seed): r.value for r in read_results(spark, out).collect()}
    for k in range(3):
        drop(f"b{k}", [_row(k / 10)])
        assert run("first") == {(0, 42): k / 10}
    drop("b2", [_row(0.9), _row(0.8, fold=1, seed=None)])  # the last file is dropped anew, the older ones are read again before it
    assert run("second") == {(0, 42): 0.9, (1, None): 0.8}
    assert run("second") == {(0, 42): 0.9, (1, None): 0.8}  # a restart without new files


def test_replayed_batch_adds_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([_row(0.1), _row(0.2), _row(0.3, seed=None)], SINK).coalesce(1)
    for recompute in (True, False):
        for _ in range(2):
            upsert_batch(batch, 0, out, recompute, source="s")
        assert CommitLog(spark, out).read("rows").count() == 2
    assert {(r.seed, r.value) for r in read_results(spark, out).collect()} == {(42, 0.2), (None, 0.3)}  # the last row of a key
    upsert_batch(batch, 1, out, False, source="s")  # nothing new: an empty part
    assert CommitLog(spark, out).read("rows").count() == 2
    upsert_batch(spark.createDataFrame([_row(0.7)], SINK), 0, out, True, source="t")
    assert {(r.seed, r.value) for r in read_results(spark, out).collect()} == {(42, 0.7), (None, 0.3)}


def test_rdss_matches_numpy_greedy(spark):
    pool = FX.embeddings_pool(spark, SF_SMALL).select("row_id", "features").orderBy("row_id").limit(120)
    pdf = pool.toPandas()
    x = np.vstack(pdf.features.to_numpy()).astype(float)
    ids = pdf.row_id.to_numpy()
    gamma, n = 1.0 / x.shape[1], 8
    alpha = 1 - 1 / np.sqrt(len(x))
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    mu = k.mean(1)
    pen = np.zeros(len(x))
    picked = []
    for t in range(n):
        score = pen / (t + 1) - alpha * mu
        score[picked] = np.inf
        i = min(np.where(np.isclose(score, score.min(), atol=1e-12))[0], key=lambda j: ids[j])
        picked.append(i)
        pen += k[:, i]
    assert rdss(pool, n, block=50) == [int(ids[i]) for i in picked]
