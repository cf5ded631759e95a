"""Quality classifier: a small byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over every window of WIDTH bytes, their responses are
rectified and max-pooled over the document, and a dense layer with a sigmoid gives one probability.
A document is read in chunks that overlap by WIDTH - 1 bytes, so every window of the whole text is
seen once and the maximum over the chunks is the maximum over the document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_sample

WIDTH, EMBED, FILTERS = 8, 8, 24
CHUNK = 4096  # windows convolved at a time
PER_LABEL = 1500  # sampled training texts of either label
LONGEST = 16_384  # characters; longer texts are not sampled for training


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    base: np.ndarray  # one element

    @classmethod
    def fresh(cls, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        return cls(draw(256, EMBED, by=0.5), draw(WIDTH * EMBED, FILTERS, by=(2 / (WIDTH * EMBED)) ** 0.5), np.zeros(FILTERS, np.float32), draw(FILTERS, by=0.3), np.zeros(1, np.float32))

    def pooled(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the text, and the window where it is."""
        if len(raw) < WIDTH:
            raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])
        most, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for start in range(0, len(raw) - WIDTH + 1, CHUNK):
            x = self.embed[raw[start : start + CHUNK + WIDTH - 1]]
            n = len(x) - WIDTH + 1
            windows = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (x.strides[0], x.strides[1]))
            out = windows @ self.filters
            at = out.argmax(axis=0)
            peak = out[at, np.arange(FILTERS)]
            better = peak > most
            most[better], where[better] = peak[better], start + at[better]
        return most + self.bias, where

    def probability(self, text: bytes) -> float:
        peaks, _ = self.pooled(np.frombuffer(text, np.uint8))
        z = float(np.maximum(peaks, 0) @ self.weights + self.base[0])
        return 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))


def fit(texts: list[bytes], labels: list[int], epochs: int | None = None, rate: float = 4e-3, batch: int = 24, seed: int = 7) -> Net:
    """Adam on the mean log loss, good texts weighing twice as much as bad ones, as a wrongly dropped text is the greater loss; without both labels the prior alone is learnt."""
    net = Net.fresh(seed)
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.weights[:] = 0
        net.base[:] = 0 if len(y) == 0 else (4 if y[0] else -4)
        return net
    epochs = epochs or max(20, 1500 * batch // len(y))  # few texts are seen more often
    balance = np.where(y > 0, 2 / 3 / y.mean(), 1 / 3 / (1 - y.mean())).astype(np.float32)
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    names = ["embed", "filters", "bias", "weights", "base"]
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + rate * 0.05
        order = rng.permutation(len(arrays))
        for lo in range(0, len(order), batch):
            grads = {n: np.zeros_like(getattr(net, n)) for n in names}
            part = order[lo : lo + batch]
            for i in part:
                raw = arrays[i]
                peaks, where = net.pooled(raw)
                hidden = np.maximum(peaks, 0)
                z = float(hidden @ net.weights + net.base[0])
                slope = (1 / (1 + np.exp(-max(-60.0, min(60.0, z)))) - y[i]) * balance[i] / len(part)
                grads["weights"] += slope * hidden
                grads["base"] += slope
                back = slope * net.weights * (peaks > 0)
                grads["bias"] += back
                if len(raw) < WIDTH:
                    raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])
                seen = raw[where[:, None] + np.arange(WIDTH)]  # filters x WIDTH
                grads["filters"] += (net.embed[seen].reshape(FILTERS, -1) * back[:, None]).T
                np.add.at(grads["embed"], seen, (net.filters.T * back[:, None]).reshape(FILTERS, WIDTH, EMBED))
            step += 1
            for n in names:
                g = grads[n] + 1e-4 * getattr(net, n)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                getattr(net, n)[...] -= pace * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, longest: int = LONGEST) -> Net:
    """A network learnt from a bounded sample: at most `per_label` labelled ids of either quality, with texts of at most `longest` characters.

    A document with several label rows counts by its largest label; null labels and texts are skipped.
    """
    told = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    chosen = bounded_sample(told, "_quality", "doc_id", per_label)  # of ids first, so that no text is shuffled
    texts = docs.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "_quality").orderBy(F.xxhash64("text")).toLocalIterator()
    pairs = [(r[0].encode(), r[1]) for r in rows]
    return fit([t for t, _ in pairs], [q for _, q in pairs])


def score(docs: DataFrame, net: Net, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with score, the probability of good quality of the whole text.

    Null and empty texts are scored as a text of zero bytes. One row for each input row; other
    columns are not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.probability(t.encode() if isinstance(t, str) else b"") for t in texts], dtype="float64")

    return docs.select(*keep, probability(F.col("text")).alias("score"))
