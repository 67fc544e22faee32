"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import held_out, labelled, logistic

#: Bytes of a chunk and from one chunk's start to the next one's; bytes of a filter and its stride.
CHUNK, STEP, WIDTH, STRIDE = 384, 320, 8, 2
EMBED, FILTERS, HIDDEN = 6, 32, 16
PAD = 256
#: Largest whole numbers of rounded byte vectors and filters: sums of WIDTH * EMBED products stay below 2 ** 24.
EMBED_STEPS, FILTER_STEPS = 256, 1024


def chunks(raw: bytes) -> np.ndarray:
    """All of a text in overlapping chunks, the last one padded; the empty text is one chunk of padding."""
    n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
    data = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::STEP]


def grouped(texts: list[str], bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, their text's index) of runs of at most `bound` chunks; a longer text is cut between chunks and goes on in
    the next run."""
    held, owner, n = [], [], 0
    for k, t in enumerate(texts):
        c = chunks(t.encode("utf-8", "replace"))
        for i in range(0, len(c), bound):
            part = c[i : i + bound]
            if n and n + len(part) > bound:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, n = [], [], 0
            held.append(part)
            owner.append(np.full(len(part), k))
            n += len(part)
    if n:
        yield np.concatenate(held), np.concatenate(owner)


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    moments: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        f32 = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        embed = f32(PAD + 1, EMBED, scale=0.5)
        embed[PAD] = 0
        return cls(embed, f32(WIDTH * EMBED, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), f32(2 * FILTERS, HIDDEN, scale=0.15), np.zeros(HIDDEN, np.float32), f32(HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def answers(self, c: np.ndarray, embed: np.ndarray, filters: np.ndarray, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
        """(first chunk, answer of each filter at each place of each chunk), for some chunks at a time."""
        n = (CHUNK - WIDTH) // STRIDE + 1
        for i in range(0, len(c), step):
            part = embed[c[i : i + step]].reshape(-1, CHUNK * EMBED)
            view = np.lib.stride_tricks.as_strided(part, (len(part), n, WIDTH * EMBED), (part.strides[0], STRIDE * EMBED * 4, 4))
            yield i, (view.reshape(-1, WIDTH * EMBED) @ filters).reshape(len(part), n, FILTERS)

    def pooled(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each chunk, and where."""
        best, at = np.empty((len(c), FILTERS), np.float32), np.empty((len(c), FILTERS), np.int32)
        for i, answer in self.answers(c, self.embed, self.filters):
            best[i : i + len(answer)] = answer.max(axis=1)
            at[i : i + len(answer)] = answer.argmax(axis=1)
        return np.maximum(best + self.bias, 0), at

    def head(self, pooled: np.ndarray, owner: np.ndarray, k: int) -> tuple:
        start = np.searchsorted(owner, np.arange(k))
        count = np.bincount(owner, minlength=k)[:, None].astype(np.float32)
        mean, top = np.add.reduceat(pooled, start) / count, np.maximum.reduceat(pooled, start)
        x = np.concatenate([mean, top], axis=1)
        h = np.tanh(x @ self.dense + self.dense_bias)
        return logistic((h @ self.out + self.out_bias).astype(np.float64)), h, x, start, count

    def predict(self, texts: list[str], bound: int = 4096) -> np.ndarray:
        """Scores that depend on each text alone, to the last bit, however texts are batched: bytes' vectors and filters
        are rounded to whole numbers of 8 and 10 bits, whose sums of products are exact in any order, pooled values are
        summed as integers, and what follows is done element by element."""
        scale_e, scale_f = (max(float(np.abs(x).max()), 1e-9) / n for x, n in ((self.embed, EMBED_STEPS), (self.filters, FILTER_STEPS)))
        embed, filters = np.rint(self.embed / scale_e).astype(np.float32), np.rint(self.filters / scale_f).astype(np.float32)
        bias = np.rint(self.bias.astype(np.float64) / (scale_e * scale_f)).astype(np.int64)
        total, top = np.zeros((2, len(texts), FILTERS), np.int64)
        count = np.zeros((len(texts), 1))
        for c, owner in grouped(texts, bound):
            best = np.empty((len(c), FILTERS), np.int64)
            for i, answer in self.answers(c, embed, filters):
                best[i : i + len(answer)] = answer.max(axis=1)
            best = np.maximum(best + bias, 0)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            who = owner[first]
            total[who] += np.add.reduceat(best, first)
            top[who] = np.maximum(top[who], np.maximum.reduceat(best, first))
            count[who, 0] += np.diff(np.append(first, len(owner)))
        x = np.concatenate([total / np.maximum(count, 1), top], axis=1) * (scale_e * scale_f)
        hidden = np.zeros((len(texts), HIDDEN)) + self.dense_bias
        for i in range(x.shape[1]):
            hidden += x[:, i : i + 1] * self.dense[i].astype(np.float64)
        hidden, out = np.tanh(hidden), np.zeros(len(texts)) + self.out_bias[0]
        for i in range(HIDDEN):
            out += hidden[:, i] * float(self.out[i])
        return logistic(out)

    def learn(self, c: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        k = len(y)
        pooled, at = self.pooled(c)
        p, h, x, start, count = self.head(pooled, owner, k)
        g = ((p - y) * weight / k).astype(np.float32)
        grads = {"out": h.T @ g, "out_bias": g.sum(keepdims=True)}
        gh = np.outer(g, self.out) * (1 - h * h)
        grads |= {"dense": x.T @ gh, "dense_bias": gh.sum(axis=0)}
        gx = gh @ self.dense.T
        gp = (gx[:, :FILTERS] / count)[owner]
        is_top = pooled == x[owner, FILTERS:]
        gp = (gp + gx[owner, FILTERS:] * is_top) * (pooled > 0)
        # Only the place of each largest answer has a gradient.
        rows = np.arange(len(c))[:, None, None]
        window = c[rows, (at * STRIDE)[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        vectors = self.embed[window].reshape(len(c), FILTERS, -1)
        grads |= {"filters": np.einsum("cfv,cf->vf", vectors, gp), "bias": gp.sum(axis=0)}
        back = gp[:, :, None] * self.filters.T[None]
        embed = np.stack([np.bincount(window.ravel(), weights=back.reshape(len(c), FILTERS, WIDTH, EMBED)[..., e].ravel(), minlength=PAD + 1) for e in range(EMBED)], axis=1)
        embed[PAD] = 0
        grads["embed"] = embed.astype(np.float32)
        self.moments["t"] = t = self.moments.get("t", 0) + 1
        for name, grad in grads.items():
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            self.moments[name] = (m, v)
            setattr(self, name, (getattr(self, name) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
        return float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean())


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 4e-3, budget: int = 1500, seed: int = 7) -> Net:
    """The network after `epochs` rounds over all texts, or as many more as make `budget` batches; without both labels, untrained."""
    net, y = Net.fresh(seed), np.asarray(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        net.out_bias += np.float32(4 * (y.mean() - 0.5) if len(y) else 0)
        return net
    parts = [chunks(t.encode("utf-8", "replace")) for t in texts]
    r, done = np.random.default_rng(seed), 0
    total = max(epochs * -(-len(y) // batch), min(budget, 40 * -(-len(y) // batch)))
    share = np.clip(0.5 / np.array([1 - y.mean(), y.mean()]), 0.5, 2.0)
    while done < total:
        for i in np.array_split(r.permutation(len(y)), -(-len(y) // batch)):
            done += 1
            owner = np.repeat(np.arange(len(i)), [len(parts[j]) for j in i])
            step = rate * min(1.0, done / 50) * max(0.05, 1 - done / total)
            net.learn(np.concatenate([parts[j] for j in i]), owner, y[i], share[y[i].astype(int)], step)
    net.moments = {}
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6000, chars: int = 8000) -> Net:
    """Learn from at most `rows` labelled documents; of a text of over `chars` characters, from slices spread over all of it."""
    sample = labelled(docs, labels, "quality", rows, chars)
    return train(sample["text"].tolist(), sample["label"].to_numpy())


def score(spark: SparkSession, docs: DataFrame, net: Net) -> DataFrame:
    """docs(doc_id, text, ...) as `row` struct, with its score; texts of any length are read whole.

    Null and empty texts get the score of padding alone; equal texts get equal scores; an empty table gives an empty
    result; extra columns come back in `row`.
    """
    held = spark.sparkContext.broadcast(net)  # some thousand numbers

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        out = [held.value.predict([t or "" for t in text.iloc[i : i + 500]]) for i in range(0, len(text), 500)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), scored(docs["text"]).alias("score"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(row, score, held_out, predicted): learnt from at most 6,000 labelled rows outside the held-out fold."""
    out = score(spark, docs, fit(docs, labels, **options))
    return out.select("row", "score", held_out(F.col("row.doc_id")).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))
