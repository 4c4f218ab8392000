"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to unit length; each of several tables hashes a vector to floor((a.x + b) / w) of k Gaussian projections
(Datar et al., "Locality-Sensitive Hashing Scheme Based on p-Stable Distributions", 2004). k grows with the logarithm
of the number of vectors, so that a bucket holds about ``FAR`` unrelated ones at any size, and the number of tables follows
from the chance ``MISS`` that a pair just at the threshold shares no bucket. In a bucket all cosines are computed in double
precision by blocks; a pair counts in the first table that it shares, which is seen from the vectors themselves, so
pairs are never shuffled: a bucket gives each member's number of links and a spanning set of edges. Buckets beyond
``BLOCK`` members are split into blocks that meet two at a time in tasks of their own, so nothing is dropped.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; equal vectors are one class with a weight; an empty table gives an empty table; only the
two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components
from millrace.llm.shared import Scratch
from millrace.llm.textbatch import U, mix, tidy

WIDTH, FAR, MISS, BLOCK = 2.5, 50, 1e-4, 2048


def agreement(distance: float, width: float) -> float:
    """The chance that one projection puts two points at this distance in one cell."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections for each table, and tables, for n vectors."""
    near, far = agreement(math.sqrt(2 - 2 * threshold), WIDTH), agreement(math.sqrt(2), WIDTH)
    k = max(4, math.ceil(math.log(max(2, n / FAR)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


@lru_cache(maxsize=4)
def projections(dims: int, k: int, tables: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dims, k * tables) directions and their shifts, projection by projection, and each table's first hash."""
    rng = np.random.default_rng([seed, dims, k])
    per = [(rng.standard_normal((dims, k)), rng.random(k) * WIDTH) for _ in range(tables)]
    a = np.stack([x for x, _ in per], axis=2).reshape(dims, -1)
    b = np.stack([x for _, x in per], axis=1).ravel()
    return a / WIDTH, b / WIDTH, mix(np.arange(tables, dtype=U) * U(1_000_003) + U(dims))


def bucket_keys(x: np.ndarray, k: int, tables: int, all_tables: int) -> np.ndarray:
    """(vectors, tables) 64-bit keys of unit vectors in the first of all tables; a key depends on the table and the vectors' length.

    Sums run over the components in their order, whatever the batch, so that a vector has the same keys anywhere.
    """
    dims = x.shape[1]
    a, b, first = projections(dims, k, all_tables)
    a = np.ascontiguousarray(a.reshape(dims, k, all_tables)[:, :, :tables].reshape(dims, -1))
    b = b.reshape(k, all_tables)[:, :tables].ravel()
    out = np.empty((len(x), tables), np.int64)
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        total = np.repeat(b[None, :], len(part), axis=0)
        for d in range(dims):
            total += part[:, d, None] * a[d]
        cells = np.floor(total).astype(np.int64).view(U).reshape(len(part), k, tables)
        h = np.repeat(first[None, :tables], len(part), axis=0)
        for j in range(k):
            h = mix(h * U(0xA0761D6478BD642F) + cells[:, j])
        out[at : at + 256] = h.view(np.int64)
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _place(kind: np.dtype, k: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            ids, raws = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raws])
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                x = unit(np.frombuffer(b"".join(raws[i] for i in at.tolist()), kind).reshape(len(at), -1))
                yield pa.record_batch([pa.array(ids[at]), pa.array(list(bucket_keys(x, k, tables, tables)), pa.list_(pa.int64()))], ["id", "keys"])

    return run


def _checked(kind: np.dtype, k: int, tables: int, threshold: float):
    """Rows (bucket, pair, t, side, id, weight, vector) sorted by (bucket, pair) -> (id, links) and (id, other) edges."""

    def links_of(ids: np.ndarray, weights: np.ndarray, sides: np.ndarray, t: int, x: np.ndarray, one: bool) -> tuple:
        n = len(ids)
        left = np.arange(n) if one else np.flatnonzero(sides == 0)
        right = np.arange(n) if one else np.flatnonzero(sides == 1)
        keys, known = np.empty((n, t), np.int64), np.zeros(n, bool)
        count, label = np.zeros(n, np.int64), np.arange(n)
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            near = x[rows] @ x[right].T >= threshold
            if one:
                near &= right[None, :] > rows[:, None]
            i, j = np.nonzero(near)
            if not len(i):
                continue
            i, j = rows[i], right[j]
            new = np.unique(np.concatenate([i, j]))
            new = new[~known[new]]
            if len(new) and t:
                keys[new] = bucket_keys(x[new], k, t, tables)
                known[new] = True
            fresh = np.ones(len(i), bool)
            for s in range(0, len(i), 1 << 16):
                fresh[s : s + (1 << 16)] = ~(keys[i[s : s + (1 << 16)]] == keys[j[s : s + (1 << 16)]]).any(axis=1)
            i, j = i[fresh], j[fresh]
            count += np.bincount(i, weights[j], n).astype(np.int64) + np.bincount(j, weights[i], n).astype(np.int64)
            while True:  # the least row reached, over this block's links and all before
                low = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                np.minimum.at(label, before, label)
                label = label[label]
                if (label == before).all():
                    break
        some = np.flatnonzero(count > 0)
        return ids[some], count[some], ids[label[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            bucket, pair = table["bucket"].to_numpy(), table["pair"].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])]))
            ids, weights, sides, ts = (table[c].to_numpy() for c in ("id", "weight", "side", "t"))
            vectors = table["vector"].to_pylist()
            found = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)]):
                if b - a > 1:
                    x = unit(np.frombuffer(b"".join(vectors[a:b]), kind).reshape(b - a, -1))
                    found.append(links_of(ids[a:b], weights[a:b], sides[a:b], int(ts[a]), x, sides[a] < 0))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["id", "links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, pair = batch["bucket"].to_numpy(), batch["pair"].to_numpy()
            open_ = np.flatnonzero((bucket != bucket[-1]) | (pair != pair[-1]))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            last = held[-1] if held else None
            if cut or last is not None and (last["bucket"][-1].as_py(), last["pair"][-1].as_py()) != (int(bucket[0]), int(pair[0])):
                parts = [*held, batch.slice(0, cut)] if cut else held
                yield from flush(parts)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """id_col, n_links, component_id, kept of every vector; links have a cosine of at least ``threshold``."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    double = isinstance(vectors.schema[vector_col].dataType.elementType, T.DoubleType)
    kind = np.dtype("<f8" if double else "<f4")
    cast = "array<double>" if double else "array<float>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([math.nan if e is None else e for e in v or ()], kind)
                fine = len(x) and np.isfinite(x).all() and x.any()
                out.append((x + kind.type(0)).tobytes() if fine else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["id", "vector"])

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(cast)).mapInArrow(pack, "id long, vector binary")
    own = scratch.cut(own)
    classes = scratch.cut(own.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    k, tables = plan(classes.count(), threshold)
    keyed = classes.select("id", "vector").mapInArrow(_place(kind, k, tables), "id long, keys array<long>")
    placed = scratch.cut(keyed.select("id", F.posexplode("keys").alias("t", "bucket")))
    crowds = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = (
        placed.join(crowds, "bucket").withColumn("blocks", blocks).withColumn("mine", mine)
        .select("id", "t", "bucket", "blocks", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            "id", "t", "bucket", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long").alias("pair"),
            F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"),
        )
    )
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = met.join(classes, "id").select("bucket", "pair", "t", "side", "id", "weight", "vector")
    rows = rows.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair")
    found = scratch.cut(rows.mapInArrow(_checked(kind, k, tables, threshold), "id long, links long, other long"))
    degrees = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch).withColumnRenamed("node", "id")
    scratch.keep(own, classes, found, label)
    of_class = classes.join(degrees, "id", "left").join(label, "id", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component")
    )
    return own.join(of_class, "vector", "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), (F.coalesce("component", "id") == F.col("id")).alias("kept"),
    )
