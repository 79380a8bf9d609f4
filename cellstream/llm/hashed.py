"""Linear models over hashed n-grams, trained on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellstream.llm.common import fit_temperature

#: Longest text that a training sample takes, in code points, so that the driver holds a bounded sample. Scoring has no such bound.
TRAIN_CHARS = 20_000
#: Labels that a model tells apart at most.
MOST_LABELS = 256
#: A small sample is learnt in more epochs, until it has given about so many updates.
LEAST_UPDATES = 6_000


def sampling_threshold(per_label: int, n: int) -> int:
    """The signed 64-bit hash below which a row is chosen, so that about `per_label` of n rows are."""
    return min((1 << 63) - 1, -(1 << 63) + (per_label << 64) // max(1, n))


def labelled_sample(rows: DataFrame, per_label: int, key: str = "doc_id", text: str = "text", label: str = "label", labels: DataFrame | None = None) -> list[tuple]:
    """About `per_label` rows of each label, as (key, text, label) in key order: a bounded sample, chosen by key hash.

    With `labels` (key, label), they are sampled first and the few chosen keys are sent to the rows' side. Rows with a null
    text or one above TRAIN_CHARS, or with a null label, aren't taken. The sample hangs on keys, texts and labels alone;
    where repeated rows would make it more than twice as large, those of the smallest hashes are taken. More than
    MOST_LABELS labels are an error.
    """
    told = (rows if labels is None else labels).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[label]: r["n"] for r in told.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"there are more than {MOST_LABELS} labels")
    if not counts:
        return []
    below = F.lit(None).cast("bigint")
    for value, n in sorted(counts.items()):
        below = F.when(F.col(label) == F.lit(value), F.lit(sampling_threshold(per_label, n))).otherwise(below)
    bound = 2 * per_label * len(counts)
    chosen = told.where(F.xxhash64(F.col(key)) <= below)
    if labels is not None:
        chosen = chosen.groupBy(key).agg(F.max(label).alias(label)).orderBy(F.xxhash64(F.col(key)), key).limit(bound)
        chosen = rows.select(key, text).join(F.broadcast(chosen), key)
    chosen = chosen.where(F.length(text) <= TRAIN_CHARS).select(key, text, label)
    chosen = chosen.orderBy(F.xxhash64(F.col(key)), key, F.xxhash64(text), label).limit(bound)
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: (r[0], r[1], r[2]))


def char_grams(texts: list[str], bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes below 2^bits of the 1-, 2- and 3-grams of code points that begin at each character.

    Returns (3 x characters) hashes, the first character of each text and its length. Every text gets two blanks at its
    end, so that no n-gram reaches into the next.
    """
    joined = "".join([f"{t}  " for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    shift = np.uint32(32 - bits)
    one = codes * np.uint32(2654435761) + np.uint32(seed * 40503 + 1)
    next_one, next_two = np.append(codes[1:], np.uint32(32)), np.append(codes[2:], np.array([32, 32], np.uint32))[: len(codes)]
    two = (one ^ (one >> np.uint32(15))) * np.uint32(2246822519) + next_one * np.uint32(3266489917)
    three = (two ^ (two >> np.uint32(13))) * np.uint32(668265263) + next_two * np.uint32(374761393)
    out = np.empty((3, len(codes)), np.int32)
    for k, x in enumerate((one, two, three)):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(2246822507)
        out[k] = (x ^ (x >> np.uint32(15))) >> shift
    return out, starts, lengths


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader with elastic-net penalties.

    An example is (feature indices, values). Weights are zero unless their gradient sum passes `l1`, so the model is sparse.
    """

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes), np.float64)
        self.n = np.zeros((features, classes), np.float64)
        self.bias = np.zeros(classes)
        self.bias_n = np.zeros(classes)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, truth: int) -> None:
        w = self.weights(at)
        logits = x @ w + self.bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[truth] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown
        self.bias_n += p * p
        self.bias -= self.alpha * p / (self.beta + np.sqrt(self.bias_n))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], truth: list[int], epochs: int, seed: int = 7) -> None:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                self.learn(*examples[k], truth[k])

    def logits(self, examples: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        w = self.weights(slice(None))
        return np.array([x @ w[at] + self.bias for at, x in examples]).reshape(len(examples), len(self.bias))


def fit_calibrated(examples: list, truth: list[int], features: int, classes: int, epochs: int, **settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature: a model without a fifth of the examples gives the temperature, one of all the rest."""
    back = [k for k in range(len(examples)) if k % 5 == 4]
    used = [k for k in range(len(examples)) if k % 5 != 4]
    epochs = max(epochs, min(8 * epochs, LEAST_UPDATES // max(1, len(examples))))
    part = Ftrl(features, classes, **settings)
    part.fit([examples[k] for k in used], [truth[k] for k in used], epochs)
    temperature = fit_temperature(part.logits([examples[k] for k in back]), np.array([truth[k] for k in back], np.int64))
    every = Ftrl(features, classes, **settings)
    every.fit(examples, truth, epochs)
    return every.weights(slice(None)), every.bias, temperature
