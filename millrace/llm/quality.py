"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are split into runs of letters or digits and runs of signs. Features are single tokens, pairs of neighbours
and a pair of its own for a token that repeats the one before; values are counts scaled to unit length, so that a
score is a sparse dot product. FTRL-proximal (McMahan et al., "Ad Click Prediction", 2013) visits the
labelled rows one by one, in a fixed order, for a few passes.

Defined results: null and empty texts score by the bias; repeated rows score alike; without labels every document scores
0.5; labels of one class only give that class's side; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.samples import BITS, drawn, featured, one_label, remainder, scored
from millrace.llm.textbatch import LOWER, SPACE, U, mix, power_tables

#: Most labelled rows that a fit takes.
ROWS = 8000
CLASS = np.where(SPACE, 0, 2).astype(np.uint8)
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
SAME = int(0x5A17) & ((1 << BITS) - 1)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each text's first token (one more entry than texts)."""
    low = LOWER[data]
    n = len(low)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    kind = CLASS[low]
    new = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    up, down = power_tables(n)
    prefix = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + U(3)), np.searchsorted(starts, off)


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's (distinct buckets, values of unit length)."""
    hashes, first = tokens(data, off)
    shift = U(64 - BITS)
    single = (hashes >> shift).astype(np.int32)
    pairs = (mix(hashes[:-1] * U(0xA0761D6478BD642F) + hashes[1:]) >> shift).astype(np.int32)
    repeat = hashes[1:] == hashes[:-1]
    pairs[repeat] = SAME
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        at, n = np.unique(np.concatenate([single[a:b], pairs[a : max(a, b - 1)]]), return_counts=True)
        value = n.astype(np.float32)
        out.append((at, value / max(1e-9, float(np.sqrt((value * value).sum()))) if len(at) else value))
    return out


class Ftrl:
    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def visit(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -40, 40)))
        g = (p - label) * value
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def fit(labels: np.ndarray, at: list[np.ndarray], values: list[np.ndarray], passes: int = 4, seed: int = 3) -> np.ndarray:
    """Weights over all buckets, the bias last."""
    model, bias = Ftrl(), 1 << BITS
    rows = [(np.append(a, bias), np.append(v, np.float32(1))) for a, v in zip(at, values)]
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)).tolist():
            model.visit(*rows[i], int(labels[i]))
    return model.weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, seed: int = 7) -> np.ndarray:
    """Weights from at most ROWS labelled rows whose fold isn't the held-out one."""
    known = one_label(labels, id_col, label_col).filter(remainder("id", folds) != held)
    return fit(*featured(docs, drawn(known, ROWS, seed), features, id_col, text_col))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out, score in [0, 1], predicted (score >= threshold) of every document, by its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def score(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        w = sent.value
        total = np.array([w[at] @ value for at, value in features(data, off)], np.float64) + float(w[-1])
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    return scored(docs, score, id_col, text_col).select(
        id_col, (remainder(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
