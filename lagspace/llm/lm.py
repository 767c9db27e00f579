"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation.

The model predicts a word from the two before it: the prediction is the sum of
the context words' vectors, each scaled by a position's weights, and a word's
score is its output vector's product with that plus a bias. Its vocabulary are
the most frequent training tokens (``VOCABULARY`` of them, one of which is the
end of a text) and one class for all others. A word of that class has the class's
probability times its own smoothed share of the class.

* Counting: each task counts the tokens of its training rows; the counts are
  summed over the corpus. Nothing is sampled or cut off.
* Training: by noise-contrastive estimation in mini-batches, in numpy. A short
  pass over ``WARM`` texts gives all tasks a common start; then every task makes
  one pass over all its training tokens, and the parameters are averaged,
  weighted by tokens (iterative parameter mixing), for ``ROUNDS`` rounds. A task
  sends a row per word, so what is gathered grows with the corpus, while the
  model doesn't.
* Scoring: normalisers of contexts come from batched matrix products over the
  whole vocabulary, and are remembered. Counts of frequent tokens are
  broadcast (``BROADCAST`` at most); the others are joined by a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = 1024
DIMENSIONS = 32
CONTEXT = 2
NOISE = 64
BATCH = 2048
#: First sum of squared gradients: the larger, the gentler the first steps.
START = 1.0
RATE = 0.05
ROUNDS = 1
#: Texts of the first, short pass that one task makes to give all others a common start.
WARM = 1500
BROADCAST = 200_000
FOLDS, HELD_OUT = 5, 1
#: The token that ends a text. A word is never empty.
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words (A-Z only) and the end."""
    out = text.lower().split()
    out.append(END)
    return out


class LogBilinear:
    """Parameters: input vectors r, output vectors q, position weights c, biases b. Word 0 is the end (and what stands before a text), the last is the class of all others."""

    NAMES = ("r", "q", "c", "b")
    squares: dict | None = None
    z: np.ndarray | None = None

    def __init__(self, words: int, dimensions: int = DIMENSIONS, unigram: np.ndarray | None = None, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.noise = np.full(words, 1 / words) if unigram is None else unigram / unigram.sum()
        self.r = rng.normal(0, 0.1, (words, dimensions)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (words, dimensions)).astype(np.float32)
        self.c = np.full((CONTEXT, dimensions), 1.0, dtype=np.float32)
        self.b = np.log(np.maximum(self.noise, 1e-12)).astype(np.float32)

    def predicted(self, context: np.ndarray) -> np.ndarray:
        return sum(self.r[context[:, i]] * self.c[i] for i in range(CONTEXT))

    def train(self, context: np.ndarray, word: np.ndarray, rate: float, seed: int) -> None:
        """One pass by noise-contrastive estimation with the unigram distribution as noise; a batch shares its noise words.

        Steps are scaled by what the gradients have been (since the object was made or copied).
        """
        rng = np.random.default_rng(seed)
        log_noise = np.log(NOISE * np.maximum(self.noise, 1e-12)).astype(np.float32)
        cumulative = np.cumsum(self.noise)
        order = rng.permutation(len(word))
        words = len(self.noise)
        if self.squares is None:
            self.squares = {n: np.full(getattr(self, n).shape, START, dtype=np.float32) for n in self.NAMES}
        squares = self.squares
        for begin in range(0, len(word), BATCH):
            at = order[begin : begin + BATCH]
            ctx, w = context[at], word[at]
            k = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), words - 1)
            h = self.predicted(ctx)
            pos = 1 / (1 + np.exp(np.clip((h * self.q[w]).sum(1) + self.b[w] - log_noise[w], -30, 30)))
            neg = -1 / (1 + np.exp(-np.clip(h @ self.q[k].T + self.b[k] - log_noise[k], -30, 30)))
            # Gradients of the log-likelihood; each array's rows are summed by word.
            dh = pos[:, None] * self.q[w] + neg @ self.q[k]
            dq = _summed(w, pos[:, None] * h, words)
            np.add.at(dq, k, neg.T @ h)
            db = np.bincount(w, pos, words) + np.bincount(k, neg.sum(0), words)
            dr = sum(_summed(ctx[:, i], dh * self.c[i], words) for i in range(CONTEXT))
            dc = np.stack([(dh * self.r[ctx[:, i]]).sum(0) for i in range(CONTEXT)]) / 8
            for n, g in zip(self.NAMES, (dr, dq, dc, db)):
                g = g.astype(np.float32)
                squares[n] += g * g
                getattr(self, n)[...] += rate * g / np.sqrt(squares[n])

    def normalisers(self, key: np.ndarray) -> np.ndarray:
        """Log normalisers of contexts, by key. Those of new contexts come from products with the whole vocabulary, and are remembered: there are words ** CONTEXT at most."""
        words = len(self.b)
        if self.z is None:
            self.z = np.full(words**CONTEXT, np.nan, dtype=np.float32)
        new = np.unique(key[np.isnan(self.z[key])])
        for begin in range(0, len(new), 2048):
            rest = part = new[begin : begin + 2048]
            context = np.empty((len(part), CONTEXT), dtype=np.int64)
            for i in reversed(range(CONTEXT)):
                rest, context[:, i] = np.divmod(rest, words)
            s = self.predicted(context) @ self.q.T + self.b
            top = s.max(1)
            s -= top[:, None]
            self.z[part] = np.log(np.exp(s, out=s).sum(1)) + top
        return self.z[key]

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of words after contexts."""
        out = np.empty(len(word))
        for begin in range(0, len(word), 1 << 16):
            c, w = context[begin : begin + (1 << 16)], word[begin : begin + (1 << 16)]
            key = np.zeros(len(w), dtype=np.int64)
            for i in range(CONTEXT):
                key = key * len(self.b) + c[:, i]
            out[begin : begin + (1 << 16)] = np.einsum("ij,ij->i", self.predicted(c), self.q[w]) + self.b[w] - self.normalisers(key)
        return out / math.log(10)


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    d = rows.shape[1]
    flat = (index[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, rows.ravel(), n * d).reshape(n, d)


def contexts(ids: np.ndarray) -> np.ndarray:
    """The CONTEXT words before each word of a text, nearest first; before the text stands its end."""
    out = np.zeros((len(ids), CONTEXT), dtype=np.int64)
    for i in range(CONTEXT):
        out[i + 1 :, i] = ids[: len(ids) - i - 1]
    return out


def _corpus(batches, ids: dict, unknown: int, pieces: int):
    """Context and word arrays of the texts of batches, some texts at a time: about ``pieces`` words each."""
    ctx, word, size = [], [], 0
    for b in batches:
        for t in common.as_bytes(b.column(0)):
            w = tokens(t)
            x = np.fromiter(map(ids.get, w, repeat(unknown)), dtype=np.int64, count=len(w))
            ctx.append(contexts(x).astype(np.int16))
            word.append(x.astype(np.int16))
            size += len(w)
            if size >= pieces:
                yield np.concatenate(ctx), np.concatenate(word)
                ctx, word, size = [], [], 0
    if size:
        yield np.concatenate(ctx), np.concatenate(word)


def _counted(batches):
    kept: Counter = Counter()

    def out():
        keys = list(kept.keys())
        n = list(kept.values())
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n, pa.int64())], names=["token", "c"])

    for b in batches:
        for t in common.as_bytes(b.column(0)):
            kept.update(tokens(t))
            if len(kept) > 250_000:
                yield out()
    yield out()


def token_counts(texts: DataFrame) -> DataFrame:
    """token binary, c of every token of a text column; a null text is one end."""
    return texts.select("text").mapInArrow(_counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _trained(shared, rate, round_):
    def run(batches):
        model, ids = shared.value
        own = LogBilinear.__new__(LogBilinear)
        own.noise = model.noise
        for n in LogBilinear.NAMES:
            setattr(own, n, getattr(model, n).copy())
        seen = 0
        own.squares = None
        for ctx, word in _corpus(batches, ids, len(model.b) - 1, 400_000):
            own.train(ctx.astype(np.int64), word.astype(np.int64), rate, seed=round_ * 1_000_003 + seen)
            seen += len(word)
        if seen:
            rows = np.concatenate([own.r, own.q, own.b[:, None]], axis=1)
            rows = np.vstack([rows, np.concatenate([own.c.ravel(), np.zeros(rows.shape[1])])[: rows.shape[1]][None, :]]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([seen] * len(rows), pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], names=["row", "n", "v"])

    return run


def _mixed(batches):
    """Sums of the vectors of each row of parameters within a task."""
    total: dict[int, list] = {}
    for b in batches:
        for row, n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            v = v.values.to_numpy()
            if row in total:
                total[row][0] += n
                total[row][1] = total[row][1] + v
            else:
                total[row] = [n, v]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1] for x in total.values()], pa.list_(pa.float64()))], names=["row", "n", "v"])


def fit(train: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> tuple[LogBilinear, dict]:
    """The model of the training texts, and the ids of its words. counts: of all training tokens."""
    spark = train.sparkSession
    top = counts.where(F.col("token") != F.lit(END)).orderBy(F.desc("c"), "token").limit(vocabulary - 1).collect()
    sums = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("token") == F.lit(END), F.col("c"))).alias("ends")).first()
    ends, total = sums.ends or 0, sums.n or 0
    ids = {END: 0} | {bytes(r.token): i + 1 for i, r in enumerate(top)}
    unigram = np.array([ends, *[r.c for r in top], total - ends - sum(r.c for r in top)], dtype=np.float64) + 0.5
    model = LogBilinear(len(unigram), unigram=unigram)
    ddl = "row int, n long, v array<double>"
    first = train.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM)
    warm = train.join(F.broadcast(first.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "text").coalesce(1)
    for k in range(rounds + 1):
        shared = spark.sparkContext.broadcast((model, ids))
        sent = (train if k else warm).select("text").mapInArrow(_trained(shared, RATE, k), ddl)
        rows = sent.repartition("row").mapInArrow(_mixed, ddl).collect()
        shared.unpersist()
        if not rows:
            break
        mean = np.zeros((len(unigram) + 1, 2 * DIMENSIONS + 1))
        for r in rows:
            mean[r.row] += np.array(r.v) / r.n
        d = DIMENSIONS
        model.r, model.q, model.b = (mean[:-1, :d].astype(np.float32), mean[:-1, d : 2 * d].astype(np.float32), mean[:-1, -1].astype(np.float32))
        model.c = mean[-1, : CONTEXT * d].reshape(CONTEXT, d).astype(np.float32)
    return model, ids


def _scored(shared, n_all, v_all, rare_n, rare_v):
    base_of = lambda c: math.log10((c + 0.5) / (n_all + 0.5 * (v_all + 1)))
    own_of = lambda c: math.log10((c + 0.5) / (rare_n + 0.5 * (rare_v + 1)))

    def run(batches):
        from pyspark import TaskContext

        model, ids, frequent = shared.value
        # Of each frequent token: id in the model, base score, what the model adds for a word of the class of all others.
        unknown = len(model.b) - 1
        number = {w: i for i, w in enumerate(frequent)}
        none = len(frequent)
        word_id = np.array([ids.get(w, unknown) for w in frequent] + [unknown], dtype=np.int64)
        base = np.array([base_of(c) for c in frequent.values()] + [0.0])
        own = np.array([0.0 if w in ids else own_of(c) for w, c in frequent.items()] + [0.0])
        known = np.array([c > 0 for c in frequent.values()] + [False])
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            docs, texts = b.column(0).to_pylist(), common.as_bytes(b.column(1))
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and size < 4_000_000:
                    size += len(texts[end])
                    end += 1
                words = [tokens(t) for t in texts[begin:end]]
                lens = np.array([len(w) for w in words])
                nums = np.concatenate([np.fromiter(map(number.get, w, repeat(none)), dtype=np.int64, count=len(w)) for w in words])
                x = word_id[nums]
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                ctx = np.zeros((len(x), CONTEXT), dtype=np.int64)
                place = np.arange(len(x)) - np.repeat(starts, lens)
                for i in range(CONTEXT):
                    ok = place > i
                    ctx[ok, i] = x[np.flatnonzero(ok) - i - 1]
                logs = model.log10(ctx, x) + own[nums]
                sums = [np.add.reduceat(a, starts) for a in (base[nums], logs, known[nums].astype(np.int64))]
                out = [[], [], [], [], [], [], [], []]
                for i, w in enumerate(words):
                    key = (part << 40) + row
                    row += 1
                    # The row of the text itself has a key that no token has: a token holds no space.
                    one = (key, docs[begin + i], b" %d" % key, 0, len(w), float(sums[0][i]), float(sums[1][i]), int(sums[2][i]))
                    for o, v in zip(out, one):
                        o.append(v)
                    mine = nums[starts[i] : starts[i] + lens[i]]
                    for t, n in Counter([w[j] for j in np.flatnonzero(mine == none).tolist()]).items():
                        for o, v in zip(out, (key, None, t, n, 0, 0.0, 0.0, 0)):
                            o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["row", "doc_id", "token", "tf", "n_tokens", "base", "score", "known"])
                begin = end

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learning from the rows outside the held-out fold.

    A null or empty text is one end token. Repeated rows are scored each by
    itself; a null doc_id stays null and isn't learned from or held out. Where no
    row may be learned from, N and V are 0 and the model is near uniform.
    """
    texts = common.pick(docs, "doc_id", "text")
    fold = F.pmod(common.crc_of_id("doc_id"), F.lit(FOLDS))
    train = texts.where(fold != HELD_OUT)
    counts = common.cut(token_counts(train))
    model, ids = fit(train, counts)
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent = {bytes(r.token): r.c for r in counts.orderBy(F.desc("c"), "token").limit(BROADCAST).toLocalIterator()}
    frequent.setdefault(END, 0)
    listed = sum(frequent.get(w, 0) for w in ids)
    rare_n, rare_v = sums.n - listed, max(0, sums.v - sum(frequent.get(w, 0) > 0 for w in ids))
    shared = docs.sparkSession.sparkContext.broadcast((model, ids, frequent))
    ddl = "row long, doc_id long, token binary, tf long, n_tokens long, base double, score double, known long"
    parts = texts.mapInArrow(_scored(shared, sums.n, sums.v, rare_n, rare_v), ddl)
    c = F.coalesce("c", F.lit(0))
    share = lambda n, v: F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))
    joined = parts.join(counts, "token", "left")
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("tf") * share(sums.n, sums.v)).alias("base_score"),
        F.sum(F.col("score") + F.col("tf") * share(rare_n, rare_v)).alias("score"),
    )
    held = F.coalesce(F.pmod(common.crc_of_id("doc_id"), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(sums.n).cast("long").alias("train_tokens"), "base_score", "score")
