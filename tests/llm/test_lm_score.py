import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tessera.llm import lm_score as L
from tessera.llm.common import read
from tessera.llm.queries import QUERIES

DOC = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row, and the training counts."""
    words = [WORD.findall((t or "").translate(LOWER)) + ["\n"] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, words) if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, words)], c, words


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))


def same(rows, got):
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(rows)[0])), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(close(g[5], w[5]) for g, w in zip(got, want))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF_MID, "documents").collect()]
    got = QUERIES["op12_lm_score"](spark, SF_MID).collect()
    same(rows, got)
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    # held-out text is likelier under the model than under the unigrams
    assert sum(r.score - r.base_score for r in held) / n > 0.05
    assert all(r.score < 0 for r in got)


def plain_scores(vocabulary, model, c, words):
    """The definition, token by token: softmax over all classes, then the share of the token in the rare class."""
    m, d, s = model.m.astype(np.float64), model.dims, model.size
    klass = {t.decode(): k for t, k in zip(vocabulary.index, vocabulary.klass[:-1]) if k}
    total = 0.0
    before = [s, s]
    for w in words:
        vector = sum(m[b, :d] * m[2 * s + 1 + k, :d] for k, b in enumerate(before))
        scores = m[s + 1:2 * s + 1, :d] @ vector + m[s + 1:2 * s + 1, d]
        p = np.exp(scores - scores.max())
        p /= p.sum()
        k = klass.get(w, 0)
        total += math.log10(p[k]) + (0 if k else math.log10((c[w] + 1) / vocabulary.rare))
        before = [k, *before[:-1]]
    return total


def test_scores_are_normalised_and_cover_tails(spark):
    """Few classes and a small head, so that most tokens meet their counts by the join."""
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)] + ["É", "Zz"]
    rows = [(i, " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(62)], k=rng.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    got = L.lm_score(docs, classes=8, head=30, dims=6).collect()
    same(rows, got)
    _, c, words = brute(rows)
    plain = docs.select(F.col("doc_id").alias("doc"), "text", (~L.held_out("doc_id")).alias("trains"))
    vocabulary = L.vocabulary_of(L.token_counts(plain), 8, 30)
    model = L.train(plain, spark.sparkContext.broadcast(vocabulary), dims=6)
    score = {r.doc_id: r.score for r in got}
    for (i, _), ws in list(zip(rows, words))[:60]:
        assert abs(score[i] - plain_scores(vocabulary, model, c, ws)) < 1e-4
    rare = [w for w in c if vocabulary.klass[vocabulary.index.get(w.encode(), -1)] == L.RARE]
    assert vocabulary.rare == sum(c[w] + 1 for w in rare) + 1  # the rare class adds up to one, an unknown token included
    before = np.random.default_rng(0).integers(0, model.size + 1, (50, 2))
    tables = model.tables()
    p = sum(np.exp(model.log_probabilities(tables, before, np.full(50, k))) for k in range(model.size))
    assert np.allclose(p, 1.0, atol=1e-9)


def test_training_finds_an_order(spark):
    """Texts whose every word is told by the one before: far likelier under the model."""
    rows = [(i, " ".join(f"w{(i + k) % 12}" for k in range(200))) for i in range(300)]
    got = L.lm_score(spark.createDataFrame(rows, DOC), classes=20, dims=16).collect()
    n = sum(r.n_tokens for r in got if r.held_out)
    assert sum(r.score for r in got if r.held_out) / n > 0.5 * sum(r.base_score for r in got if r.held_out) / n


def test_gradient_of_the_step():
    """The step moves along the gradient of the noise-contrastive objective, found by differences."""
    rng = np.random.default_rng(1)
    unigram = rng.random(7)
    unigram /= unigram.sum()
    before, target = rng.integers(0, 8, (5, 2)), rng.integers(0, 7, 5)

    def objective(model, noise):
        m, s, d = model.m.astype(np.float64), model.size, model.dims
        v = sum(m[before[:, k], :d] * m[2 * s + 1 + k, :d] for k in range(2))
        gap = lambda at: m[s + 1 + at, :d] @ v.T + m[s + 1 + at, d][:, None] - np.log(len(noise) * unigram[at])[:, None]
        log_s = lambda x: -np.log1p(np.exp(-x))
        return log_s(np.diag(gap(target))).sum() + log_s(-gap(noise)).sum()

    model = L.LogBilinear(unigram, 3)
    trainer, slopes = L.Trainer(model, unigram, 5, noise=4), np.zeros(model.m.shape)
    trainer._move = lambda rows, slope: np.add.at(slopes, rows, slope)
    noise = np.minimum(np.searchsorted(trainer.reach, np.random.default_rng(5).random(4)), 6)
    trainer.step(before, target)
    for at in np.ndindex(*model.m.shape):
        ends = []
        for e in (1e-2, -1e-2):
            moved = L.LogBilinear(unigram, 3)
            moved.m = model.m.astype(np.float64)
            moved.m[at] += e
            ends.append(objective(moved, noise))
        if at[0] < 2 * model.size + 1 or at[1] < 3:
            assert abs((ends[0] - ends[1]) / 2e-2 - slopes[at]) < 2e-3 or (at[0] <= model.size and at[1] == 3), at


def test_edge_cases(spark):
    rows = [(1, None), (None, "A b"), (None, "a B"), (2, ""), (3, "x " * 90000), (3, "x " * 90000), (5, "\x0b\x0c\x1fa b")]
    docs = spark.createDataFrame(rows, DOC)
    for c in ("token", "doc", "trains", "row", "c", "n", "score"):
        docs = docs.withColumn(c, F.lit("clash"))
    same(rows, L.lm_score(docs).collect())
    assert L.lm_score(docs.where("false")).count() == 0
    held = [(i, "only held out") for i in range(200) if out(i)]
    got = L.lm_score(spark.createDataFrame(held, DOC)).collect()
    assert len(got) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and abs(r.score) < 1e-6 for r in got)
