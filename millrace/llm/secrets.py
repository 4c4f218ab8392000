"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

Candidates are all runs of 16 or more of A-Z a-z 0-9 + / _ . = -. The network (numpy only) sees a candidate in
windows of ``BODY`` characters with ``BEFORE`` and ``AFTER`` characters of context: an embedding of character classes, one convolution,
a maximum over positions, a logistic output; a candidate has the maximum over its windows. It is trained on labelled
findings: the patterns' own findings in all documents, their contexts swapped at random so that the
candidate itself has to tell, further secrets made by rule, and as the other class all candidates that no pattern
finds; each different window counts once. Windows are dealt to parts by hash; each pass goes over the windows of every part and the parts'
networks are averaged. Logits are calibrated on a holdout (Platt), and the threshold is the highest one whose recall on the holdout's secrets has an
exact lower confidence bound of at least ``RECALL``, for the findings and for the made secrets alike; of the holdout's logits the driver gets counts by
steps of 1 / ``STEP``. The holdout is made of whole documents, and what stands in a document of the other part too isn't in it. What patterns leave uncovered of a candidate is scored as
one, if it still is 16 long; what is above the threshold is added.

Defined results: null and empty texts have no spans; a finding that the text repeats is listed each time; repeated rows
get equal results; positions are code points; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from millrace.llm.rules import binomial_tail
from millrace.llm.shared import Scratch
from millrace.llm.textbatch import LOWER, slices, tidy, word_bounds

#: Fixed values of the patterns.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "cnn")
#: Different windows of a part of the fit, about; secrets and others made for each part; passes; steps of a logit that calibration tells apart.
PART, MADE, PASSES, STEP = 3000, (1500, 3000), 6, 256
BEFORE, BODY, AFTER, FILTERS, WIDE, DEPTH = 16, 40, 8, 24, 5, 10
RECALL, CONFIDENCE = 0.95, 0.95

NOT_HEX = np.ones(256, bool)
NOT_HEX[list(b"0123456789abcdef")] = False
NOT_CANDIDATE = np.ones(256, bool)
NOT_CANDIDATE[list((string.ascii_letters + string.digits + "+/_.=-").encode())] = False


def character_classes() -> np.ndarray:
    """Bytes to the network's alphabet: digits, vowels and other letters by case and hex range, signs, space, other."""
    table = np.full(256, 1, np.int64)
    groups = ["0123456789", "abcdef", "aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEF", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ"]
    for n, group in enumerate(groups, 2):
        for c in group:
            if table[ord(c)] == 1:
                table[ord(c)] = n
    for n, c in enumerate("+/_.=-:\"'|@#", 10):
        table[ord(c)] = n
    table[[0x20, *range(0x09, 0x0E)]] = 9
    table[128:] = 22
    return table


CLASSES = character_classes()
ALPHABET = int(CLASSES.max()) + 2  # 0 pads


def find(data: np.ndarray, off: np.ndarray) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int]]]]:
    """Each text's pattern findings (start, end, kind) and candidates (start, end), in bytes of the text."""
    n = len(off) - 1
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
    candidates: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    raw, low = data.tobytes(), LOWER[data].tobytes()

    def texts_with(needle: bytes, hay: bytes) -> set[int]:
        at, places = hay.find(needle), []
        while at >= 0:
            places.append(at)
            at = hay.find(needle, at + len(needle))
        return set((np.searchsorted(off, places, "right") - 1).tolist()) if places else set()

    for i in sorted(set().union(*(texts_with(w, low) for w in WORDS))):
        for m in ASSIGN.finditer(raw[off[i] : off[i + 1]]):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found[i].append((m.start(), m.end(), "assign"))
    for i in sorted(texts_with(b"AKIA", raw)):
        for m in ACCESS.finditer(raw[off[i] : off[i + 1]]):
            if m.end() - m.start() >= LEAST["access"]:
                found[i].append((m.start(), m.end(), "access"))
    starts, ends, _ = word_bounds(data, off, NOT_HEX)
    long = ends - starts >= LEAST["hex"]
    doc = np.searchsorted(off, starts[long], "right") - 1
    for i, a, b in zip(doc.tolist(), (starts[long] - off[doc]).tolist(), (ends[long] - off[doc]).tolist()):
        found[i].append((a, b, "hex"))
    starts, ends, _ = word_bounds(data, off, NOT_CANDIDATE)
    long = ends - starts >= 16
    starts, ends = starts[long], ends[long]
    doc = np.searchsorted(off, starts, "right") - 1
    for i, a, b in zip(doc.tolist(), (starts - off[doc]).tolist(), (ends - off[doc]).tolist()):
        candidates[i].append((a, b))
    for x in found:
        x.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found, candidates


def windows(text: bytes, a: int, b: int) -> list[bytes]:
    """The candidate's windows: fixed length, zero bytes beyond the text and beyond the candidate's part."""
    out = []
    for at in range(a, b, BODY):
        stop = min(b, at + BODY)
        before = text[max(0, a - BEFORE) : a].rjust(BEFORE, b"\0")
        out.append(before + text[at:stop].ljust(BODY, b"\0") + text[b : b + AFTER].ljust(AFTER, b"\0"))
    return out


def encoded(rows: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.where(data == 0, 0, CLASSES[data] + 1)


@dataclass
class Network:
    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.0

    def forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]
        views = np.lib.stride_tricks.sliding_window_view(e, WIDE, axis=1).reshape(len(x), -1, DEPTH * WIDE)
        h = np.maximum(views @ self.kernel + self.shift, 0)
        top = h.argmax(axis=1)
        best = np.take_along_axis(h, top[:, None, :], 1)[:, 0]
        return views, top, best, best @ self.out + self.bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -40, 40)))


NAMES = ["embed", "kernel", "shift", "out", "bias"]


def weights_of(net: Network) -> np.ndarray:
    return np.concatenate([np.ravel(getattr(net, name)) for name in NAMES])


def with_weights(flat: np.ndarray) -> Network:
    sizes = [(ALPHABET, DEPTH), (DEPTH * WIDE, FILTERS), (FILTERS,), (FILTERS,)]
    parts = np.split(flat, np.cumsum([np.prod(n) for n in sizes]))
    return Network(*(x.reshape(n) for x, n in zip(parts, sizes)), float(parts[-1][0]))


def learn(x: np.ndarray, y: np.ndarray, passes: int = PASSES, seed: int = 23, start: np.ndarray | None = None) -> Network:
    """The network after so many passes, from a random one or from the weights ``start``."""
    rng = np.random.default_rng(seed)
    net = with_weights(start) if start is not None else Network(rng.normal(0, 0.3, (ALPHABET, DEPTH)), rng.normal(0, 0.2, (DEPTH * WIDE, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), 0.0)
    m, v, step = dict.fromkeys(NAMES, 0.0), dict.fromkeys(NAMES, 0.0), 0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(passes):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            at = order[a : a + 128]
            views, top, best, logit = net.forward(x[at])
            d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[at]) * weight[at] / len(at)
            d_best = np.outer(d, net.out) * (best > 0)
            g = {"out": best.T @ d, "bias": d.sum(), "shift": d_best.sum(axis=0)}
            rows = np.arange(len(at))[:, None]
            chosen = views[rows, top]  # (rows, filters, inputs)
            g["kernel"] = np.einsum("bfi,bf->if", chosen, d_best)
            d_views = np.einsum("bf,if->bfi", d_best, net.kernel).reshape(len(at), FILTERS, DEPTH, WIDE)
            d_embed = np.zeros((ALPHABET, DEPTH))
            for j in range(WIDE):
                np.add.at(d_embed, x[at][rows, top + j].ravel(), d_views[..., j].reshape(-1, DEPTH))
            g["embed"] = d_embed
            step += 1
            for name in NAMES:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                move = 0.004 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - move)
    return net


def platt(logits: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by damped Newton steps on smoothed targets. ``n``: how often each logit counts, once if not given."""
    n = np.ones(len(logits)) if n is None else n
    ones, all_ = (n * y).sum(), n.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (all_ - ones + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([logits, np.ones_like(logits)], axis=1)
    loss = lambda w: (n * (np.logaddexp(0, a @ w) - target * (a @ w))).sum() + 5e-4 * ((w - [1, 0]) ** 2).sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (n * (p * (1 - p) + 1e-6))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (n * (p - target)) + 1e-3 * (w - [1, 0]))
        while loss(w - move) > loss(w) and abs(move).max() > 1e-9:  # whole steps overshoot where the classes lie apart
            move = move / 2
        w = w - move
    return float(w[0]), float(w[1])


def recall_threshold(scores: np.ndarray, least: float = RECALL, confidence: float = CONFIDENCE, counts: np.ndarray | None = None) -> float:
    """The highest threshold whose recall on these secrets has an exact lower bound of at least ``least``; 2, which no score reaches, if there is none.
    ``counts``: how many secrets have each score, one if not given."""
    order = np.argsort(scores, kind="stable")
    total = np.cumsum(np.ones(len(scores), np.int64) if counts is None else np.asarray(counts)[order])
    n = int(total[-1]) if len(total) else 0
    low, high = -1, n - 1  # the bound holds while P(misses <= missed | miss rate 1 - least) is small, which grows with missed
    while low < high:
        missed = (low + high + 1) // 2
        low, high = (missed, high) if binomial_tail(missed, n, 1 - least) <= 1 - confidence else (low, missed - 1)
    return 2.0 if low < 0 else float(scores[order][np.searchsorted(total, low, "right")])


def made_secrets(rng: np.random.Generator, contexts: list[tuple[bytes, bytes]], n: int) -> list[bytes]:
    """Windows with secrets of known shapes: base64, upper-case ids, prefixed tokens, mixed letters and digits, signed tokens."""
    letters = string.ascii_letters + string.digits
    shapes = [(letters + "+/", ("",)), (string.ascii_uppercase + string.digits, ("AKIA", "ASIA", "")), (letters, ("ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_", "")), ("0123456789abcdef", ("", "0x")), (letters + "-_", ("eyJ", "eyJhbGci"))]
    out = []
    for _ in range(n):
        alphabet, heads = shapes[rng.integers(len(shapes))]
        body = heads[rng.integers(len(heads))] + "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(18, 65)))
        before, after = contexts[rng.integers(len(contexts))]
        text = before + body.encode() + after
        ws = windows(text, len(before), len(before) + len(body))
        out.append(ws[rng.integers(len(ws))] if len(body) % BODY > 20 else ws[0])
    return out


def made_others(rng: np.random.Generator, contexts: list[tuple[bytes, bytes]], n: int) -> list[bytes]:
    """Windows with long runs that are no secrets: dates, versions, hosts, paths, ids of words, long words, lines of one sign, long numbers."""
    word = lambda: "".join(("bcdfghlmnprst"[i] + "aeiou"[j]) for i, j in zip(rng.integers(0, 13, 3), rng.integers(0, 5, 3)))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    shapes = [
        lambda: f"20{num(2)}-{num(2)}-{num(2)}T{num(2)}.{num(2)}.{num(2)}", lambda: f"{word()}.{word()}{num(1)}.example.com", lambda: f"/{word()}/{word()}/{word()}{num(2)}.html",
        lambda: f"{word()}-{word()}-{word()}-{num(2)}", lambda: f"{word()}_{word()}_{num(4)}_{word()}", lambda: f"{word()}{word()}{word()}{word()}{num(2)}", lambda: f"v{num(1)}.{num(2)}.{num(1)}-{word()}.{word()}.{num(1)}",
        lambda: f"{num(3)}-{num(4)}-{num(4)}-{num(4)}-{num(2)}", lambda: f"=={word()}=={num(2)}=={word()}==",
        lambda: "".join(word() for _ in range(rng.integers(3, 7))), lambda: "".join(word() for _ in range(rng.integers(3, 7))).upper(), lambda: "".join(word().capitalize() for _ in range(rng.integers(3, 6))), lambda: "-_./"[rng.integers(4)].join(word() for _ in range(rng.integers(3, 6))),
        lambda: "=-_."[rng.integers(4)] * int(rng.integers(16, 60)), lambda: f"/{word()}/{word()}/{word()}_{word()}.{word()[:3]}", lambda: f"www.{word()}{word()}.example.com/{word()}", lambda: f"//www.{word()}{word()}.org/{word()}/{num(5)}.html",
    ]
    out = []
    for _ in range(n):
        body = shapes[rng.integers(len(shapes))]().encode()
        before, after = contexts[rng.integers(len(contexts))]
        out += windows(before + body + after, len(before), len(before) + len(body))[:1]
    return out


def labelled(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(w, y, held): every different window of all documents' candidates, whether a pattern finds it, and whether it stands in the holdout only, by
    a hash of its documents' ids (of texts, for rows without an id). Windows of the holdout whose candidate the other part has too are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                rows, labels, ids = [], [], []
                found, candidates = find(data, off)
                for i in range(hi - lo):
                    text = data[off[i] : off[i + 1]].tobytes() if candidates[i] else b""
                    for a, b in candidates[i]:
                        near = [(s, e) for s, e, _ in found[i] if s < b and a < e]
                        for at, w in zip(range(a, b, BODY), windows(text, a, b), strict=True):
                            part = text[at : min(b, at + BODY)]
                            label = int(any(s < at + len(part) and at < e for s, e in near))
                            if not (label and part.isdigit()):  # a long number is a finding, but tells nothing about secrets
                                rows.append(w)
                                labels.append(label)
                                ids.append(lo + i)
                yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(rows, pa.binary()), pa.array(labels, pa.int32())], ["held", "w", "y"])

    text = F.col(text_col).cast("string")
    held = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))), F.lit(4)) == 0
    own = docs.select(held.alias("held"), text.alias("text")).mapInArrow(run, "held boolean, w binary, y int")
    return own.groupBy("w", "y").agg(F.bool_and("held").alias("held")).withColumn("body", F.expr(f"substring(w, {BEFORE + 1}, {BODY})"))


def _dealt(seed: int):
    """A part's windows with contexts of findings swapped, and secrets and others made for it: (part, w, y, held, made)."""

    def run(got: pa.Table) -> pa.Table:
        part = got["part"][0].as_py()
        rows = sorted((w, y, held) for w, y, held in zip(*(got[c].to_pylist() for c in ("w", "y", "held")), strict=True) if w is not None)
        w, y, held = zip(*rows) if rows else ((), (), ())
        rng = np.random.default_rng([seed, part])
        contexts = [(x[:BEFORE].replace(b"\0", b""), x[BEFORE + BODY :].replace(b"\0", b"")) for x in w] + [(b" ", b" "), (b"", b""), (b"key=\"", b"\"")]
        swapped = []
        for x, label in zip(w, y):
            if label and rng.random() < 0.6:
                before, after = contexts[rng.integers(len(contexts))]
                x = before[-BEFORE:].rjust(BEFORE, b"\0") + x[BEFORE : BEFORE + BODY] + after[:AFTER].ljust(AFTER, b"\0")
            swapped.append(x)
        secrets, others = made_secrets(rng, contexts, MADE[0]), made_others(rng, contexts, MADE[1])
        mine = (rng.random(len(secrets) + len(others)) < 0.25).tolist()
        x, y, held = swapped + secrets + others, [*y, *[1] * len(secrets), *[0] * len(others)], [*held, *mine]
        made = [False] * len(w) + [True] * len(mine)
        return pa.table([pa.array([part] * len(x), pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.int32()), pa.array(held), pa.array(made)], ["part", "w", "y", "held", "made"])

    return run


def _of_part(got: pa.Table, held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and whether made, in an order that doesn't depend on how rows came."""
    rows = sorted((m, w, y) for m, w, y, h in zip(*(got[c].to_pylist() for c in ("made", "w", "y", "held")), strict=True) if h == held)
    return encoded([w for _, w, _ in rows]) if rows else np.zeros((0, BEFORE + BODY + AFTER), np.int64), np.array([y for _, _, y in rows], np.int64), np.array([m for m, _, _ in rows], bool)


def _moved(flat: np.ndarray | None, passes: int, seed: int):
    """(part, n, weights): a part's network after so many passes from ``flat``, and how many windows it learnt from."""

    def run(got: pa.Table) -> pa.Table:
        x, y, _ = _of_part(got, False)
        new = weights_of(learn(x, y, passes, seed, flat))
        return pa.table([got["part"].slice(0, 1), pa.array([len(x)], pa.int64()), pa.array([new.tobytes()], pa.binary())], ["part", "n", "weights"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> Network:
    """A calibrated network from all windows of all documents. The driver holds one network for each part of about ``PART`` windows, and counts of logits."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "secrets")
    every = scratch.cut(labelled(docs, id_col, text_col, seed))
    learnt = every.filter("not held").select("body").distinct()
    rows = every.filter("not held").select("w", "y", "held").unionByName(every.filter("held").join(learnt, "body", "left_anti").select("w", "y", "held"))
    parts = max(1, round(every.count() / PART))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(parts)))
    blank = spark.range(parts).select(F.lit(None).cast("binary").alias("w"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("boolean").alias("held"), F.col("id").alias("part"))
    by_part = lambda d: d.repartition(parts, "part").groupBy("part")
    dealt = scratch.cut(by_part(placed.unionByName(blank)).applyInArrow(_dealt(seed), "part long, w binary, y int, held boolean, made boolean"))
    rounds, passes = (1, PASSES) if parts == 1 else (PASSES, 1)
    flat = None
    for turn in range(rounds):
        got = sorted(by_part(dealt).applyInArrow(_moved(flat, passes, 23 + turn), "part long, n long, weights binary").collect())
        flat = sum(r["n"] * np.frombuffer(r["weights"]) for r in got) / sum(r["n"] for r in got)

    def told(got: pa.Table) -> pa.Table:
        x, y, made = _of_part(got, True)
        at = np.floor(np.clip(with_weights(flat).logits(x), -40, 40) * STEP).astype(np.int64)
        return pa.table([pa.array(y * (1 + made), pa.int64()), pa.array(at, pa.int64())], ["kind", "at"])

    counts = by_part(dealt).applyInArrow(told, "kind long, at long").groupBy("kind", "at").count().toPandas().sort_values(["kind", "at"])
    scratch.keep()
    kind, low, n = counts["kind"].to_numpy(), counts["at"].to_numpy() / STEP, counts["count"].to_numpy()
    net = with_weights(flat)
    net.scale = platt(low + 0.5 / STEP, (kind > 0).astype(np.int64), n)
    p = net.probability(low)  # the least of each step: a threshold is never above a logit that it counts as found
    net.threshold = min(recall_threshold(p[kind == k], counts=n[kind == k]) for k in (1, 2))
    return net


def uncovered(text: bytes, found: list[tuple[int, int, str]], candidates: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of candidates that no finding covers, of those that are candidates themselves. ``found``: by start; ``candidates``: in order."""
    out, k = [], 0
    for a, b in candidates:
        while k < len(found) and found[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(found) and found[j][0] < b:
            out.append((at, found[j][0]))
            at = max(at, found[j][1])
            j += 1
        out.append((at, b))
    return [(a, b) for a, b in out if b - a >= 16]


def added(net: Network, text: bytes, found: list[tuple[int, int, str]], candidates: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    free = uncovered(text, found, candidates)
    if not free:
        return []
    rows = [windows(text, a, b) for a, b in free]
    p = net.probability(net.logits(encoded([x for ws in rows for x in ws])))
    best = np.maximum.reduceat(p, np.concatenate([[0], np.cumsum([len(ws) for ws in rows])[:-1]]))
    return [(a, b, "cnn") for (a, b), s in zip(free, best.tolist()) if s >= net.threshold]


def covered(text: bytes, spans: list[tuple[int, int, str]], word: bytes) -> bytes:
    """The text with ``word`` for each run of spans that touch each other's inside."""
    out, begin = [], 0
    for a, b, _ in spans:
        if b > begin:
            if a >= begin:
                out += [text[begin:a], word]
            begin = b
    return b"".join([*out, text[begin:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", word: str = "[SECRET]", changed: str | None = None) -> DataFrame:
    """Every row with all its columns, ``word`` in its text for every span of ``scan``; with ``changed`` a boolean column of that name."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(at)):
                found, candidates = find(data, off)
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                new: dict[int, str] = {}
                for i in range(hi - lo):
                    if found[i] or candidates[i]:
                        text = data[off[i] : off[i + 1]].tobytes()
                        spans = sorted([*found[i], *added(net.value, text, found[i], candidates[i])], key=lambda s: (s[0], KINDS.index(s[2])))
                        if spans:
                            new[i] = covered(text, spans, word.encode()).decode()
                if new:
                    columns[at] = pa.array([new.get(i, x) for i, x in enumerate(columns[at].to_pylist())], pa.string())
                if changed:
                    columns.append(pa.array([i in new for i in range(hi - lo)]))
                yield pa.record_batch(columns, [*batch.schema.names, *([changed] if changed else [])])

    own = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return own.mapInArrow(run, StructType([*own.schema.fields, *([StructField(changed, BooleanType())] if changed else [])]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: str | None = None) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end,..."), and with ``redacted`` the text in
    which that word stands for every span, as column redacted."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["redacted"] * (redacted is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                found, candidates = find(data, off)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                counts, digests, spans, texts = [], [], [], []
                for i in range(hi - lo):
                    text = data[off[i] : off[i + 1]].tobytes() if found[i] or candidates[i] or redacted is not None else b""
                    more = added(net.value, text, found[i], candidates[i])
                    at = points[off[i] : off[i + 1] + 1] - points[off[i]] if found[i] or more else None
                    show = lambda s: ",".join(f"{k}:{at[a]}:{at[b]}" for a, b, k in s)  # noqa: E731, B023
                    kinds = [k for _, _, k in found[i]]
                    counts.append([kinds.count(k) for k in KINDS[:3]])
                    digests.append(hashlib.sha256(show(found[i]).encode()).hexdigest())
                    both = sorted([*found[i], *more], key=lambda s: (s[0], KINDS.index(s[2])))
                    spans.append(show(both))
                    if redacted is not None:
                        texts.append(covered(text, both, redacted.encode()).decode())
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(digests), pa.array(spans)]
                yield pa.record_batch(columns + ([pa.array(texts, pa.string())] if redacted is not None else []), names)

    schema = f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * (redacted is not None)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
