"""Line deduplication by winnowing over line hashes (DataFrame functions only).

A document is the list of its lines (text cut at ``\\n``; null or empty text has none).  The run length
``min_lines`` is also the winnowing window: the smallest line hash of every window (the last one, if several
tie) is selected, so two equal windows always select the same line and no repeated run of ``min_lines``
lines or more can be missed.

1. Selected lines are counted by hash; windows whose selected line is unique in the corpus are done.
2. The windows around the remaining anchors are joined by their whole content with the earliest window of
   that content.  Every occurrence is held against the first one alone, so a line shared by a third of the
   corpus yields as many rows as it has occurrences, never pairs; the first is found by partial aggregation.
3. Windows with an earlier equal are later repeats.  Adjoining and overlapping ones chain to the maximal run
   in both directions, and the union of the runs is cut out of the text.

Result, defined: a line goes if it lies in a window of ``min_lines`` consecutive lines whose lines also start
at an earlier place (smaller id, or the same document further up).  A document of fewer lines is one window.
Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns_of, stored, text_key, text_or_empty, whole_rows


def _windows(docs: DataFrame, id_col: str, text_col: str, min_lines: int) -> DataFrame:
    """(id, key, first, line, anchor, opens): one row per window, its content hash ``line``, the selected line's
    hash ``anchor``, and whether it is the first window that selects this line."""
    t = min_lines
    lines = docs.select(
        F.col(id_col).alias("id"), text_key(text_col).alias("key"),
        F.transform(F.split(text_or_empty(text_col), "\n"), lambda x: F.xxhash64(x)).alias("h"),
    ).where(text_or_empty(text_col) != "")
    runs = lines.select("id", "key", F.expr(
        f"transform(sequence(0, greatest(size(h) - {t}, 0)), i -> slice(h, i + 1, {t}))").alias("w"))
    # 1-based place of the last minimum inside each window, as a place in the document
    picked = runs.select("id", "key", "w", F.expr(
        "transform(w, (x, i) -> i + size(x) - array_position(reverse(x), array_min(x)))").alias("p"))
    return picked.select("id", "key", F.posexplode(F.expr(
        "transform(w, (x, i) -> struct(xxhash64(x) as line, array_min(x) as anchor, "
        "i = 0 or p[i] <> p[i - 1] as opens))")).alias("first", "x")).select("id", "key", "first", "x.*")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3) -> DataFrame:
    """(id, key, first): windows (by first line, from 0) that have an equal window at an earlier place."""
    windows = stored(_windows(docs, id_col, text_col, min_lines), "line-windows")
    # the small sides are stored, so that a join has its own exchange on both sides and Spark can split a hot line
    anchors = stored(windows.where("opens").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "line-anchors")
    near = windows.join(anchors, "anchor", "left_semi").select("id", "key", "first", "line")
    earliest = near.groupBy("line").agg(F.min(F.struct("id", "key", "first")).alias("origin"), F.count("*").alias("n"))
    met = near.join(stored(earliest.where("n > 1").select("line", "origin"), "line-origins"), "line")
    return met.where(~F.struct("id", "key", "first").eqNullSafe(F.col("origin"))).select("id", "key", "first")


def _cut(docs: DataFrame, id_col: str, text_col: str, min_lines: int) -> DataFrame:
    """(row, kept_text, n_lines, n_removed, removed_runs), ``row`` the struct of all columns; the text travels once."""
    t = min_lines
    later = repeated_windows(docs, id_col, text_col, t)
    cuts = later.groupBy("id", "key").agg(F.sort_array(F.collect_set("first")).alias("cuts"))
    rows = docs.select(whole_rows(docs, "row"), text_key(text_col).alias("text_key"))
    joined = rows.join(cuts, F.col("row").getField(id_col).eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    joined = joined.withColumn("lines", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")))
    # kept stretches lie between the end of one cut window and the start of the next
    edges = joined.withColumn("edges", F.expr(f"concat(array(-{t}), coalesce(cuts, array()), array(size(lines)))"))
    stretch = edges.withColumn("gaps", F.expr(
        f"filter(transform(sequence(0, size(edges) - 2), k -> struct(edges[k] + {t} as a, edges[k + 1] as b)), g -> g.b > g.a)"))
    kept = stretch.withColumn("kept", F.expr("flatten(transform(gaps, g -> slice(lines, g.a + 1, g.b - g.a)))"))
    out = kept.withColumn("ends", F.expr("concat(array(struct(0 as a, 0 as b)), gaps, array(struct(size(lines) as a, size(lines) as b)))"))
    runs = F.expr("filter(transform(sequence(0, size(ends) - 2), k -> struct(ends[k].b as first_line, "
                  "ends[k + 1].a - ends[k].b as n_lines)), r -> r.n_lines > 0)")
    return out.select("row", F.array_join("kept", "\n").alias("kept_text"), F.size("lines").cast("bigint").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed"), runs.alias("removed_runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3) -> DataFrame:
    """``docs`` with every row kept and four columns added: ``kept_text`` (the lines left, joined by a line feed),
    ``n_lines``, ``n_removed`` and ``removed_runs`` (array of (first_line, n_lines), maximal runs in order).  Columns of the
    input with these four names are replaced, all others are kept."""
    added = ("kept_text", "n_lines", "n_removed", "removed_runs")
    own = [c for c, name in zip(columns_of(docs, "row"), docs.columns) if name not in added]
    return _cut(docs, id_col, text_col, min_lines).select(*own, *added)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3) -> DataFrame:
    """``docs`` with its columns, the text cut to the lines left and ``n_chars`` (if there) brought in line.  A document
    all of whose lines are later repeats goes; documents that lose nothing, empty ones included, stay as they are."""
    found = _cut(docs, id_col, text_col, min_lines).where("n_removed = 0 or n_removed < n_lines")
    cols = []
    for f in docs.schema.fields:
        old, value = F.col("row").getField(f.name), F.col("kept_text")
        if f.name == "n_chars":
            value = F.length("kept_text").cast(f.dataType)
        cols.append((F.when(F.col("n_removed") > 0, value).otherwise(old) if f.name in (text_col, "n_chars") else old).alias(f.name))
    return found.select(*cols)
