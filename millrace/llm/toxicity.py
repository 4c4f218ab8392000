"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed features is trained in numpy from confirmed toxic examples (P) and unlabelled text (U)
with the risk of Kiryo et al. ("Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017):

    R = pi * E_P[l(g, +)] + max(0, E_U[l(g, -)] - pi * E_P[l(g, -)])

where pi is the share of toxic rows among the labelled rows that may be learned from. When the second part turns
negative, only its gradient is followed, upwards. Features are the distinct words and their
beginnings of 5 to 8 bytes, so that families of derived words share evidence.

Every row that may be learned from is: features are chosen by counts over all of them, rows are dealt to parts by a hash of their ids, and in each
round every part takes some steps over its rows, its sums standing for all rows by the number of parts; then weights and moments are averaged.

Defined results: null and empty texts score by the bias alone; ties and repeated rows score alike; without any toxic
label (or without labels) every document scores 0; labels of unknown ids are ignored; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.samples import BITS, one_label, remainder, scored, scored_rows, unused
from millrace.llm.shared import Scratch
from millrace.llm.textbatch import LOWER, U, mix, power_tables, slices, tidy, word_bounds

#: Rows of a part of the fit, about; steps of the fit, and rounds that they are dealt to where there are several parts.
PART, STEPS, ROUNDS = 12000, 400, 10
#: A feature needs so many toxic documents that have it.
SUPPORT = 4
BEGINNINGS = (5, 6, 7, 8)
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct buckets."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, off, APART)
    up, down = power_tables(len(low))
    prefix = np.zeros(len(low) + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[: len(low)], out=prefix[1:])
    inverse = down[starts]
    shift = U(64 - BITS)
    kinds = [(mix((prefix[ends] - prefix[starts]) * inverse + U(1)) >> shift).astype(np.int32)]
    size = ends - starts
    for n in BEGINNINGS:
        cut = np.minimum(starts + n, ends)
        h = (mix((prefix[cut] - prefix[starts]) * inverse + U(1000 + n)) >> shift).astype(np.int32)
        kinds.append(np.where(size >= n, h, -1))
    table = np.stack(kinds, axis=1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        s = np.unique(table[a:b])
        out.append(s[1:] if len(s) and s[0] < 0 else s)
    return out


def chosen(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Which features are learnt, by how many toxic and unlabelled rows have them."""
    share_p, share_u = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
    spread = np.sqrt(share_u * (1 - np.minimum(share_u, 0.999)) * (1 / n_p + 1 / n_u))
    return (in_p >= min(SUPPORT, n_p)) & (share_p > 1.5 * share_u) & (share_p - share_u > 3 * spread)


def descend(state: np.ndarray, begin: int, steps: int, toxic: list[np.ndarray], unlabelled: list[np.ndarray], n_p: float, n_u: float, prior: float, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights with the bias last and Adam's two moments, after steps ``begin`` + 1 to ``begin`` + ``steps`` on the risk of these rows (lists of columns).

    ``n_p``, ``n_u``: what means divide by, the rows' own number or, in a part, that of all rows over that of parts."""
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64))
    (row_p, col_p), (row_u, col_u) = flat(toxic), flat(unlabelled)
    w, m, v = (x.copy() for x in state)
    size = len(w) - 1
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(begin + 1, begin + steps + 1):
        g_p = np.bincount(row_p, w[col_p], len(toxic)) + w[-1]
        g_u = np.bincount(row_u, w[col_u], len(unlabelled)) + w[-1]
        s_p, s_u = sigmoid(g_p), sigmoid(g_u)
        rest = np.logaddexp(0, g_u).sum() / n_u - prior * np.logaddexp(0, g_p).sum() / n_p
        d_rest_p, d_rest_u = -prior * s_p / n_p, s_u / n_u
        if rest < 0:
            d_p, d_u = -d_rest_p, -d_rest_u
        else:
            d_p, d_u = prior * (s_p - 1) / n_p + d_rest_p, d_rest_u
        grad = np.zeros_like(w)
        grad[:-1] = np.bincount(col_p, d_p[row_p], size) + np.bincount(col_u, d_u[row_u], size) + decay * w[:-1]
        grad[-1] = d_p.sum() + d_u.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return np.stack([w, m, v])


def spread_out(kept: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = w[:-1]
    return weights, float(w[-1])


def columns_of(kept: np.ndarray) -> np.ndarray:
    column = np.full(1 << BITS, -1, np.int64)
    column[kept] = np.arange(len(kept))
    return column


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights over all buckets and a bias. Full-batch Adam on the non-negative risk with the logistic loss."""
    if not positive:
        return spread_out(np.zeros(0, np.int64), np.array([-40.0]))
    n_p, n_u = len(positive), max(1, len(unlabelled))
    count = lambda sets: np.bincount(np.concatenate([*sets, np.zeros(0, np.int32)]), minlength=1 << BITS)
    kept = np.flatnonzero(chosen(count(positive), count(unlabelled), n_p, n_u))
    column = columns_of(kept)
    toxic, other = ([c[c >= 0] for c in (column[s] for s in sets)] for sets in (positive, unlabelled))
    return spread_out(kept, descend(np.zeros((3, len(kept) + 1)), 0, steps, toxic, other, n_p, n_u, prior)[0])


def _counted(some: np.ndarray | None):
    """(at, n): how many of a task's rows have each feature, of those in ``some``; at -1, how many rows there are. Column 1 is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                n += hi - lo
                for at in features(data, off):
                    total[at] += 1
        if some is not None:
            total[np.setdiff1d(np.arange(1 << BITS), some)] = 0
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], n), pa.int64())], ["at", "n"])

    return run


def _sets(kept: np.ndarray):
    """(part, toxic, at): each row's learnt features, as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        column = columns_of(kept)
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                at = [c[c >= 0].astype(np.int32).tobytes() for c in (column[s] for s in features(data, off))]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(at, pa.binary())], ["part", "toxic", "at"])

    return run


def _round(state: np.ndarray, begin: int, steps: int, n_p: float, n_u: float, prior: float):
    def run(got: pa.Table) -> pa.Table:
        rows = sorted(zip(got["toxic"].to_pylist(), got["at"].to_pylist(), strict=True))
        every = [np.frombuffer(x, np.int32) for _, x in rows]
        new = descend(state, begin, steps, [x for x, (t, _) in zip(every, rows) if t], every, n_p, n_u, prior)
        return pa.table([got["part"].slice(0, 1), pa.array([new.tobytes()], pa.binary())], ["part", "state"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, seed: int = 5) -> tuple[np.ndarray, float]:
    """The classifier from all rows whose fold isn't the held-out one. Ids of toxic rows are broadcast; texts are never shuffled."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(remainder("id", folds) != held)
    known = one_label(labels, id_col, label_col).join(own.select("id"), "id", "left_semi")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not counts["n"] or not counts["toxic"]:
        return fit([], [], 0.0)
    toxic = F.broadcast(known.filter("label = 1").select("id"))
    summed = lambda rows, some: rows.mapInArrow(_counted(some), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    # unlabelled are all rows, toxic ones too; only what enough toxic rows have can be chosen
    p = summed(own.join(toxic, "id", "left_semi"), None).toPandas().sort_values("at")
    n_p, p = int(p["n"].iloc[0]), p.iloc[1:]
    p = p[p["n"] >= min(SUPPORT, n_p)]
    some = p["at"].to_numpy()
    u = summed(own, some).toPandas().set_index("at")["n"]
    n_u = int(u.loc[-1])
    kept = some[chosen(p["n"].to_numpy(), u.reindex(some, fill_value=0).to_numpy(), n_p, n_u)]

    parts, scratch = max(1, round(n_u / PART)), Scratch(docs.sparkSession, "toxicity")
    marked = own.join(toxic.withColumn("t", F.lit(1)), "id", "left").select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).alias("part"), "text", F.coalesce("t", F.lit(0)).alias("toxic"))
    sets = scratch.cut(marked.mapInArrow(_sets(kept), "part long, toxic int, at binary"))
    rounds = 1 if parts == 1 else ROUNDS
    steps, state = STEPS // rounds, np.zeros((3, len(kept) + 1))
    for begin in range(0, STEPS, steps):
        moved = _round(state, begin, steps, n_p / parts, n_u / parts, counts["toxic"] / counts["n"])
        got = sorted(sets.repartition(parts, "part").groupBy("part").applyInArrow(moved, "part long, state binary").collect())
        state = sum(np.frombuffer(r["state"]).reshape(state.shape) for r in got) / len(got)
    scratch.keep()
    return spread_out(kept, state[0])


def scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    weights, bias = train(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def score(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        w = sent.value
        total = np.array([w[x].sum(dtype=np.float64) for x in features(data, off)]) + bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    return score


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that ``toxicity`` would not call toxic; rows without an id are judged by their text too."""
    name = unused("toxicity", docs)
    return scored_rows(docs, scorer(docs, labels, id_col, text_col, label_col), text_col, name).filter(F.col(name) < threshold).drop(name)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """id_col, held_out, score in [0, 1], predicted (score >= threshold) of every document, by its whole text."""
    return scored(docs, scorer(docs, labels, id_col, text_col, label_col), id_col, text_col).select(
        id_col, (remainder(id_col, 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
