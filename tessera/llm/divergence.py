"""Source divergence audit over count-level bitmaps.

Every language has its kept terms (in at least ``min_docs`` of its documents); every source of the language gives each
kept term a smoothed share p in billionths, and p against q of another source costs f = (p - q)^2 / q, all in integers.

1. One pass over the texts counts terms by (language, source), merged inside each task before the only shuffle of
   counts; rare terms are dropped in the same stage.
2. Kept terms get ids by a range-partitioned sort (place in its partition, no global numbering), frequent ones first,
   and every (group, count) stores its terms as bitmap words of 64 ids.  All terms of one count share one p, so a level
   is all that f needs to know.
3. For each bitmap word the levels of all sources meet: AND and popcount give the joint cells, each times f.  Only
   levels above zero are stored.  A term that a source lacks is at level zero, the complement of its other levels, and
   enters by inclusion and exclusion: the word adds n * (f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)) and each level's own
   size adds the rest.  A word holds at most 64 terms a source, whatever the input.

Result, defined: null text, language and source count as ''.  Every row is a document, repeated ones included.
Groups without terms take part; an empty table gives no rows.  Ties rank by the item's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import small_batches, stored, token_codes

BILLION = 1_000_000_000
# Letters, A-Z lower-cased, and non-ASCII bytes; everything else becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
HELD_BYTES, ROWS_OUT = 6 << 20, 1 << 15  # text whose counts a task merges before it sends them on, and rows sent at once
SAFE_COUNT = 9_000_000_000  # counts below it times BILLION fit into 64 bits
CELLS = 1 << 22  # joint cells looked at together
HELD_PAIRS = 1 << 20
SALTS = 32


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, df, total, sources, counts), merged over some megabytes of text: the documents and occurrences of a term in
    a language and its occurrences in each source.  A null term lists the sources."""
    names = ["lang", "term", "df", "total", "sources", "counts"]

    def rows(batches):
        langs, sources = (pa.chunked_array([b.column(k) for b in batches]).combine_chunks() for k in (0, 1))
        code, sizes, words = token_codes(pa.concat_arrays([b.column(2).cast(pa.binary()) for b in batches]), LETTERS)
        pairs = list(zip(langs.to_pylist(), sources.to_pylist()))
        groups = sorted(set(pairs))  # by language, so that a term's groups of one language are neighbours
        place = {g: k for k, g in enumerate(groups)}
        lang_names = sorted({g[0] for g in groups})
        lang_of = np.array([lang_names.index(g[0]) for g in groups])
        group = np.array([place[p] for p in pairs])
        # (word, document) cells, then (word, group) and (word, language)
        cell, n = np.unique(code * len(group) + np.repeat(np.arange(len(group)), sizes), return_counts=True)
        of = (cell // len(group)) * len(groups) + group[cell % len(group)]
        order = np.argsort(of, kind="stable")
        of, n = of[order], n[order]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        docs_in = np.diff(np.r_[at, len(of)])
        count = np.add.reduceat(n, at) if len(at) else n
        word, which = of[at] // len(groups), of[at] % len(groups)
        key = word * len(lang_names) + lang_of[which]
        top = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        source_names, ends = pa.array([g[1] for g in groups], pa.string()), np.r_[top, len(key)].astype(np.int32)
        add = lambda x: pa.array(np.add.reduceat(x, top) if len(top) else np.zeros(0, np.int64), pa.int64())
        terms = pa.RecordBatch.from_arrays([
            pa.array(lang_names, pa.string()).take(pa.array(key[top] % len(lang_names))), words.take(pa.array(word[top])).cast(pa.string()),
            add(docs_in), add(count), pa.ListArray.from_arrays(ends, source_names.take(pa.array(which))),
            pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int64)))], names=names)
        every = [[g[1] for g in groups if g[0] == lang] for lang in lang_names]
        yield pa.RecordBatch.from_arrays([pa.array(lang_names, pa.string()), pa.nulls(len(lang_names), pa.string()), *[pa.array([0] * len(lang_names), pa.int64())] * 2,
                                          pa.array(every, pa.list_(pa.string())), pa.array([[0] * len(x) for x in every], pa.list_(pa.int64()))], names=names)
        for lo in range(0, len(terms), ROWS_OUT):
            yield terms.slice(lo, ROWS_OUT)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > HELD_BYTES:
                yield from rows(held)
                held, size = [], 0
        if sum(map(len, held)):
            yield from rows(held)

    small_batches(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, "lang string, term string, df bigint, total bigint, sources array<string>, counts array<bigint>")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact for every count."""
    whole, more = F.greatest(total + terms, F.lit(1)), n + F.lit(1)
    wide = F.call_function("div", more.cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))
    return F.lit(1).cast("bigint") + F.when(n < SAFE_COUNT, F.call_function("div", more.cast("bigint") * F.lit(BILLION), whole)).otherwise(wide)


def cost(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _cost(p, q):
    return (p - q) * (p - q) // q


def _merged(a, b, v):
    """Sums of v for each distinct (a, b)."""
    order = np.lexsort((b, a))
    a, b, v = a[order], b[order], v[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return (a[start], b[start], np.add.reduceat(v, start)) if len(a) else (a, b, v)


def joint_cells(bits, source, p, zero):
    """(source, other, value) of one bitmap word: AND and popcount of all its levels, those of one source aside."""
    found, step = [], max(1, CELLS // max(len(bits), 1))
    for lo in range(0, len(bits), step):
        n = np.bitwise_count(bits[lo:lo + step, None] & bits[None, :])
        n[source[lo:lo + step, None] == source[None, :]] = 0
        i, j = n.nonzero()
        size, i = n[i, j].astype(np.int64), i + lo
        value = _cost(p[i], p[j]) - _cost(p[i], zero[j]) - _cost(zero[i], p[j]) + _cost(zero[i], zero[j])
        found.append(_merged(source[i], source[j], size * value))
    return _merged(*(np.concatenate(x) for x in zip(*found)))


def _met(bitmaps: DataFrame) -> DataFrame:
    """(lang, source, item, value), partial sums, from (lang, word, source, bits, p, zero)."""
    names = ["lang", "source", "item", "value"]

    def run(batches):
        codes, labels, held, size = {}, [], [], 0
        lang_of, rest = {}, None

        def rows(a, b, v):
            return pa.RecordBatch.from_arrays([pa.array([lang_of[x] for x in a], pa.string()), pa.array([labels[x] for x in a], pa.string()),
                                               pa.array([labels[x] for x in b], pa.string()), pa.array(v, pa.int64())], names=names)

        def met(table):
            """Cells of whole words: ``table`` is sorted by (lang, word)."""
            nonlocal held, size
            lang, word, source = table["lang"].to_pylist(), table["word"].to_numpy(), table["source"].to_pylist()
            code = np.empty(len(lang), np.int64)
            for k, key in enumerate(zip(lang, source)):
                if key not in codes:
                    codes[key] = len(labels)
                    lang_of[len(labels)] = key[0]
                    labels.append(key[1])
                code[k] = codes[key]
            bits, p, zero = table["bits"].to_numpy().view(np.uint64), table["p"].to_numpy(), table["zero"].to_numpy()
            cuts = [0, *(k for k in range(1, len(lang)) if word[k] != word[k - 1] or lang[k] != lang[k - 1]), len(lang)]
            for lo, hi in zip(cuts, cuts[1:]):
                held.append(joint_cells(bits[lo:hi], code[lo:hi], p[lo:hi], zero[lo:hi]))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held = [_merged(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])

        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            word, lang = table["word"].to_numpy(), table["lang"]
            last = len(word)  # the last word may go on in the next batch
            while last and word[last - 1] == word[-1] and lang[last - 1].as_py() == lang[len(word) - 1].as_py():
                last -= 1
            rest = table.slice(last)
            if last:
                met(table.slice(0, last).combine_chunks())
            if size > HELD_PAIRS // 2:  # pairs that do not merge go on
                yield rows(*_merged(*(np.concatenate(x) for x in zip(*held))))
                held, size = [], 0
        if rest is not None and len(rest):
            met(rest.combine_chunks())
        if held:
            yield rows(*_merged(*(np.concatenate(x) for x in zip(*held))))

    small_batches(bitmaps.sparkSession)
    dealt = bitmaps.repartition("lang", "word").sortWithinPartitions("lang", "word", "source", "bits")
    return dealt.mapInArrow(run, "lang string, source string, item string, value bigint")


def divergence(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds each source's divergence from every other source of its
    language, part ``term`` the ``top_terms`` terms by which it exceeds the whole language."""
    by_term = Window.partitionBy("lang", "term")
    parts = term_counts(docs).repartition("lang", "term").withColumns({"df": F.sum("df").over(by_term), "lang_n": F.sum("total").over(by_term)})
    parts = parts.where((F.col("df") >= min_docs) | F.col("term").isNull())
    counts = parts.select("lang", "term", "lang_n", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    counts = counts.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"), F.max("lang_n").alias("lang_n"))
    counts = stored(counts, "audit-counts")
    cells = counts.where("term is not null")

    # ids: the partition of a sort in its high bits, the place in it in the low ones
    terms = cells.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    terms = terms.repartitionByRange("lang", F.desc("lang_n"), "term").sortWithinPartitions("lang", F.desc("lang_n"), "term")
    terms = stored(terms.withColumn("id", F.monotonically_increasing_id()), "audit-terms")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang", "left").na.fill(0, ["terms", "lang_total"])
    groups = stored(groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms"))), "audit-groups")

    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    levels = cells.drop("lang_n").join(terms.drop("lang_n"), ["lang", "term"])
    levels = levels.groupBy("lang", "source", "n", F.expr("shiftright(id, 6)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    bitmaps = levels.join(groups, ["lang", "source"]).select(
        "lang", "source", "n", "word", "bits", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "zero")
    bitmaps = stored(bitmaps, "audit-bitmaps")

    # what the levels above zero give against level zero of every other source, salted: a language is a hot key
    sizes = bitmaps.groupBy("lang", "source", "n", "p", "zero").agg(F.sum(F.bit_count("bits").cast("bigint")).alias("size"))
    sizes = sizes.withColumn("salt", F.pmod(F.xxhash64("source", "n"), F.lit(SALTS)).cast("int"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"), F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("salt"))
    exact = lambda c: F.sum((F.col("size") * c).cast("decimal(38,0)"))
    p, zero, zero_b = F.col("p"), F.col("zero"), F.col("zero_b")
    edges = sizes.join(other, ["lang", "salt"]).where("source <> item").groupBy("lang", "source", "item").agg(
        exact(cost(p, zero_b) - cost(zero, zero_b)).alias("to"), exact(cost(zero_b, p) - cost(zero_b, zero)).alias("back"))
    a, b = groups.select("lang", "source", "zero", "terms"), groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"))
    empty = a.join(b, "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("terms") * cost(zero, zero_b)).cast("decimal(38,0)").alias("value"))
    big = F.col("value").cast("decimal(38,0)").alias("value")
    pairs = empty.unionByName(edges.select("lang", "source", "item", F.col("to").alias("value"))).unionByName(
        edges.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))).unionByName(
        _met(bitmaps.drop("n")).select("lang", "source", "item", big))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))

    own = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    own = own.where("p > q").select("lang", "source", "item", cost(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = own.withColumn("rank", place).where(F.col("rank") <= top_terms)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumns({"rank": place, "part": F.lit("pair")}).select(*out).unionByName(
        top.withColumn("part", F.lit("term")).select(*out))
