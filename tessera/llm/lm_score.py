"""Language-model scores of documents: a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words of the A-Z lower-cased text, cut at ASCII blanks, then one end token.

1. Every token of every document is counted (merged by Arrow batch before the shuffle); counts of the training
   documents are the vocabulary and the noise distribution.
2. The ``CLASSES`` most frequent training tokens and the end token are classes of their own, all others share the class of
   rare tokens.  A class is predicted from the ``CONTEXT`` classes before it: their vectors, each times its place's
   weights, add up to a vector whose product with the class's own vector, plus a bias, is the score.
3. Training goes in ``ROUNDS``.  Each document trains in one round; each task trains its own copy of the parameters with
   noise samples shared by a batch, and the copies are averaged, every row weighted by how often the copy met it.
   Averages are taken on the executors; the driver gets one copy of the parameters, a fixed size.
4. A document's score adds normalised log-probabilities: matrix products give the scores of all classes after every class
   and, as the scores of the two places add up, the sum over all classes for every pair.  A rare token adds (c + 1) / (tokens + distinct + 1) over the training tokens of its
   class, so that known tokens and one unknown share the class's probability.

Tokens that make more than 1 / ``HEAD`` of all, so fewer than ``HEAD``, go to all tasks with their counts; any other token
meets its count by a join on the token, which therefore has no hot key (but for tokens of over ``LONGEST`` bytes).

Result, defined: null text is empty, one end token.  A null id trains.  Rows that repeat an id or a text are documents of
their own.  Without training documents all probabilities are 1.  Empty tables give no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blanked, small_batches, stored, token_codes

CLASSES, HEAD, LONGEST = 1023, 1 << 20, 64
DIMS, CONTEXT = 16, 2
ROUNDS, STEP, NOISE, RATE = 3, 1024, 32, 0.05
ROWS_OUT = 1 << 15  # rows sent on at once
BLOCK = 256  # parameter rows sent together
END = b"\n"
LOWER = blanked(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
RARE = 0


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c, n): occurrences in training documents and in all, from (text, trains)."""
    def run(batches):
        for b in batches:
            code, sizes, words = token_codes(b.column(0).cast(pa.binary()), LOWER)
            trains = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            n, c = np.bincount(code, minlength=len(words)), np.bincount(code[np.repeat(trains, sizes)], minlength=len(words))
            token = pa.concat_arrays([words, pa.array([END], pa.binary())]).cast(pa.string())
            found = pa.RecordBatch.from_arrays([token, pa.array(np.append(c, trains.sum()), pa.int64()), pa.array(np.append(n, len(trains)), pa.int64())],
                                               names=["token", "c", "n"])
            for lo in range(0, len(found), ROWS_OUT):
                yield found.slice(lo, ROWS_OUT)

    parts = docs.select("text", "trains").mapInArrow(run, "token string, c bigint, n bigint")
    return parts.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


class Vocabulary:
    """Frequent tokens with their counts and classes; class 0 is rare, ``size`` the class that pads the start of a text."""

    def __init__(self, head: list[tuple[bytes, int]], classes: list[bytes], total: int, distinct: int):
        own = {t: k for k, t in enumerate(classes, 1)}
        self.index = {t: k for k, (t, _) in enumerate(head)}
        self.c = np.array([c for _, c in head] + [0], np.int64)  # the last entry stands for tokens outside the head
        self.klass = np.array([own.get(t, RARE) for t, _ in head] + [RARE], np.int64)
        self.size, self.total, self.distinct = len(classes) + 1, total, distinct
        count = np.zeros(self.size, np.int64)
        np.add.at(count, self.klass[:-1][self.klass[:-1] != RARE], self.c[:-1][self.klass[:-1] != RARE])
        self.rare = int(total - count.sum()) + distinct - len(classes) + 1  # tokens of the rare class, each seen once more, and one unknown
        count[RARE] = self.rare
        self.unigram = count / count.sum()

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def sequence(self, texts: pa.Array):
        """The tokens of a batch of texts as places in the head (-1: outside), the start and number of tokens of each text;
        and of the words outside the head their codes, texts and the distinct words of the batch."""
        code, sizes, words = token_codes(texts, LOWER)
        place = np.append(self.places(words.to_pylist()), 0)[code] if len(code) else np.zeros(0, np.int64)
        text, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes + 1) - sizes - 1
        out = np.full(len(code) + len(sizes), self.index.get(END, -1), np.int64)
        out[np.arange(len(code)) + text] = place  # every text before has one end token
        away = np.flatnonzero(place < 0)
        return out, starts, sizes + 1, (code[away], text[away], words)


class LogBilinear:
    """One matrix: ``size + 1`` context rows, ``size`` class rows, two rows of place weights; the last column holds the
    biases of the class rows.  Class t after the classes u (nearest) and v has the score r_u P_1 q_t + r_v P_2 q_t + b_t."""

    def __init__(self, unigram: np.ndarray, dims: int = DIMS, seed: int = 1):
        self.size, self.dims = len(unigram), dims
        rows = 2 * self.size + 1 + CONTEXT
        self.m = (np.random.default_rng(seed).standard_normal((rows, dims + 1)) * 0.1).astype(np.float32)
        self.m[:, dims] = 0
        self.m[self.size + 1:2 * self.size + 1, dims] = np.log(unigram)
        self.m[2 * self.size + 1:, :dims] = 1.0 / CONTEXT
        self.squares = np.full(self.m.shape, 1e-2, np.float32)  # Adagrad's sums, which go on from round to round

    def contexts(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The classes before each place of concatenated texts, nearest first; padding before each start."""
        before = np.full((len(classes), CONTEXT), self.size, np.int64)
        for k in range(CONTEXT):
            before[k + 1:, k] = classes[:len(classes) - k - 1]
            for back in range(k + 1):
                inside = starts[starts + back < len(classes)] + back
                before[inside, k] = self.size
        return before

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of every class after each nearest and each second class, and the logarithm of the sum over all classes for
        every pair of them: as the scores add up, the sums are one more matrix product."""
        m, d, s = self.m.astype(np.float64), self.dims, self.size
        own = m[s + 1:2 * s + 1]
        near = (m[:s + 1, :d] * m[2 * s + 1, :d]) @ own[:, :d].T + own[:, d]
        far = (m[:s + 1, :d] * m[2 * s + 2, :d]) @ own[:, :d].T
        top_near, top_far = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
        norm = np.log(np.exp(near - top_near) @ np.exp(far - top_far).T) + top_near + top_far.T
        return near, far, norm

    @staticmethod
    def log_probabilities(tables, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each target class after its context."""
        near, far, norm = tables
        return near[before[:, 0], target] + far[before[:, 1], target] - norm[before[:, 0], before[:, 1]]


class Trainer:
    """Noise-contrastive estimation with Adagrad on a task's own copy of the model."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int, rate: float = RATE, noise: int = NOISE):
        self.model, self.rate, self.noise, self.rng = model, rate, noise, np.random.default_rng(seed)
        self.log_noise = (np.log(unigram) + np.log(noise)).astype(np.float32)
        self.reach = np.cumsum(unigram)
        self.seen = np.zeros(len(model.m), np.int64)

    def train(self, before: np.ndarray, target: np.ndarray) -> None:
        for lo in range(0, len(target), STEP):
            self.step(before[lo:lo + STEP], target[lo:lo + STEP])

    def step(self, before: np.ndarray, target: np.ndarray) -> None:
        model, d, n = self.model, self.model.dims, len(target)
        m, place = model.m, 2 * model.size + 1
        noise = np.minimum(np.searchsorted(self.reach, self.rng.random(self.noise)), model.size - 1)
        rows = [before[:, 0], before[:, 1], target + model.size + 1, noise + model.size + 1]
        weights, context = m[place:, :d].copy(), [m[r, :d] for r in rows[:CONTEXT]]
        vector = context[0] * weights[0] + context[1] * weights[1]
        own, other = m[rows[2]], m[rows[3]]
        score = np.einsum("ij,ij->i", vector, own[:, :d]) + own[:, d] - self.log_noise[target]
        pull = 1.0 / (1.0 + np.exp(np.clip(score, -30, 30)))
        false = vector @ other[:, :d].T
        false += other[:, d] - self.log_noise[noise]
        push = np.exp(np.negative(np.clip(false, -30, 30, out=false), out=false), out=false)
        push += 1.0
        push = np.divide(-1.0, push, out=push)
        back = pull[:, None] * own[:, :d]  # the gradient at the predicted vector
        back += push @ other[:, :d]
        slopes = np.zeros((3 * n + len(noise), d + 1), np.float32)
        np.multiply(back, weights[0], out=slopes[:n, :d])
        np.multiply(back, weights[1], out=slopes[n:2 * n, :d])
        np.multiply(pull[:, None], vector, out=slopes[2 * n:3 * n, :d])
        slopes[2 * n:3 * n, d] = pull
        slopes[3 * n:, :d] = push.T @ vector
        slopes[3 * n:, d] = push.sum(axis=0)
        row = np.concatenate(rows)
        order = np.argsort(row.astype(np.uint16) if len(m) <= 1 << 16 else row, kind="stable")  # short integers: radix sort
        sorted_rows = row[order]
        start = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
        self._move(sorted_rows[start], np.add.reduceat(slopes[order], start, axis=0))
        for k, c in enumerate(context):
            self._move(np.array([place + k]), np.append((back * c).sum(axis=0), np.float32(0))[None, :])
        self.seen += np.bincount(row[:3 * n], minlength=len(self.seen))
        self.seen[place:] += n

    def _move(self, rows: np.ndarray, slope: np.ndarray) -> None:
        slope = slope.astype(np.float32)
        self.model.squares[rows] += slope * slope
        self.model.m[rows] += self.rate * slope / np.sqrt(self.model.squares[rows])


def _train_round(docs: DataFrame, shared, model: LogBilinear, turn: int) -> LogBilinear:
    """The average of the copies that the tasks over ``docs`` (text) train; the model itself if there are no documents."""
    start = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        task, vocabulary, copy, trainer = TaskContext.get().partitionId(), shared.value, None, None
        for b in batches:
            if not len(b):
                continue
            if copy is None:
                copy = LogBilinear(vocabulary.unigram, start.value.dims)
                copy.m, copy.squares = start.value.m.copy(), start.value.squares.copy()
                trainer = Trainer(copy, vocabulary.unigram, 1000 * turn + task)
            place, starts, _, _ = vocabulary.sequence(b.column(0).cast(pa.binary()))
            target = vocabulary.klass[place]
            trainer.train(copy.contexts(target, starts), target)
        if copy is not None:
            weight = 1.0 + trainer.seen
            value = np.concatenate((copy.m, copy.squares), axis=1).astype(np.float64) * weight[:, None]
            for k, lo in enumerate(range(0, len(weight), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([
                    np.concatenate((value[lo:lo + BLOCK], weight[lo:lo + BLOCK, None]), axis=1).tobytes()], pa.binary())], names=["block", "task", "sums"])

    def merge(batches):
        sums = {}
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.frombuffer(s, np.float64)
                sums[k] = sums[k] + s if k in sums else s
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["block", "sums"])

    copies = stored(docs.mapInArrow(run, "block int, task int, sums binary"), "lm-copies")
    added = copies.repartition("block").sortWithinPartitions("block", "task").select("block", "sums").mapInArrow(merge, "block int, sums binary")
    found = {r["block"]: np.frombuffer(r["sums"], np.float64).reshape(-1, 2 * model.dims + 3) for r in added.collect()}
    if found:
        sums = np.concatenate([found[k] for k in sorted(found)])
        model.m, model.squares = np.split((sums[:, :-1] / sums[:, -1:]).astype(np.float32), 2, axis=1)
    start.unpersist()
    return model


def vocabulary_of(counts: DataFrame, classes: int = CLASSES, head: int = HEAD) -> Vocabulary:
    """The head are the tokens that make more than 1 / ``head`` of all tokens, so fewer than ``head``, the end token and no
    token of over ``LONGEST`` bytes; only they reach the driver.  The classes are the most frequent of them in training."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    often = (F.col("n") > total["n"] / head) & (F.octet_length("token") <= LONGEST)
    most = sorted(((r["token"].encode(), r["c"]) for r in counts.where(often | (F.col("token") == F.lit(END.decode()))).select("token", "c").collect()),
                  key=lambda x: (x[0] != END, -x[1], x[0]))
    return Vocabulary(most, [t for t, c in most[:classes + 1] if c > 0], total["c"], total["v"])


def train(docs: DataFrame, shared, rounds: int = ROUNDS, dims: int = DIMS) -> LogBilinear:
    """``docs`` (doc, text, trains); ``shared`` is the broadcast vocabulary."""
    model = LogBilinear(shared.value.unigram, dims)
    turn = F.pmod(F.xxhash64("doc"), F.lit(rounds))
    for k in range(rounds):
        model = _train_round(docs.where(F.col("trains") & (turn == k)).select("text"), shared, model, k)
    return model


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, head: int = HEAD,
             rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; logarithms to base 10.
    ``base_score`` is the unigram model with one added to every count."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (~held_out(id_col)).alias("trains"))
    counts = stored(token_counts(rows), "lm-counts")
    vocabulary = vocabulary_of(counts, classes, head)
    shared = sc.broadcast(vocabulary)
    model = sc.broadcast(train(rows, shared, rounds, dims))

    def score(batches):
        v, lm = shared.value, model.value
        tables, log_c = lm.tables(), np.log10(v.c + 1.0)
        rare_log = np.where(v.klass == RARE, log_c, 0.0)

        for b in batches:
            if not len(b):
                continue
            at, starts, sizes, (code, text, words) = v.sequence(b.column(1).cast(pa.binary()))
            target = v.klass[at]
            log_p = lm.log_probabilities(tables, lm.contexts(target, starts), target) / np.log(10.0)
            add = lambda x: pa.array(np.add.reduceat(x, starts))
            cell, n = np.unique(text * max(len(words), 1) + code, return_counts=True)  # words of the tail, by text
            ends = np.searchsorted(cell, np.arange(len(sizes) + 1) * max(len(words), 1)).astype(np.int32)
            tail = pa.StructArray.from_arrays([words.take(pa.array(cell % max(len(words), 1))).cast(pa.string()), pa.array(n.astype(np.int64))], ["token", "n"])
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array(sizes.astype(np.int64)), add((v.c[at] > 0).astype(np.int64)), add((target == RARE).astype(np.int64)),
                add(log_c[at]), add(log_p + rare_log[at]), pa.ListArray.from_arrays(ends, tail)], names=names)

    names = ["doc", "trains", "n_tokens", "known", "n_rare", "base", "score", "tail"]
    kind_sql = rows.schema["doc"].dataType.simpleString()
    found = rows.mapInArrow(score, f"doc {kind_sql}, trains boolean, n_tokens bigint, known bigint, n_rare bigint, base double, score double, "
                                   "tail array<struct<token: string, n: bigint>>")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = found.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.n").join(counts.select("token", "c"), "token")
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
                                   F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log"))
    n = vocabulary.total
    log = F.coalesce("log", F.lit(0.0))
    return found.drop("tail").join(tail, "row", "left").select(
        F.col("doc").alias(id_col), (~F.col("trains")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(float(np.log10(n + vocabulary.distinct + 1)))).alias("base_score"),
        (F.col("score") + log - F.col("n_rare") * F.lit(float(np.log10(vocabulary.rare)))).alias("score"))
