"""Bounded samples of labelled rows with hashed features, gathered for a fit on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm.textbatch import slices, tidy

#: Buckets of hashed features.
BITS = 20


def remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label): the greatest label of each id; rows without an id or a label are left out."""
    return (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .dropna().groupBy("id").agg(F.max("label").alias("label"))
    )


def drawn(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows of (id, ...), the first by a keyed hash of the id: a sample that doesn't depend on partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(limit)


def featured(
    docs: DataFrame, chosen: DataFrame, features: Callable[[np.ndarray, np.ndarray], list], id_col: str, text_col: str
) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Labels, feature buckets and values of the chosen (id, label) rows, on the driver, in the order of ids.

    ``chosen`` has a bounded number of rows (its limit is a parameter of the caller), so it is broadcast, and
    what comes back is bounded by it. ``features``: bytes, offsets -> for each text (buckets int32, values float32).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, data, off in slices(batch.column(2)):
                both = features(data, off)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x, _ in both], pa.binary()), pa.array([y.tobytes() for _, y in both], pa.binary())],
                    ["id", "label", "at", "value"],
                )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), "id").select("id", "label", "text")
    got = rows.mapInArrow(run, "id long, label int, at binary, value binary").toArrow().sort_by("id")
    return (
        got["label"].to_numpy(),
        [np.frombuffer(x, np.int32) for x in got["at"].to_pylist()],
        [np.frombuffer(x, np.float32) for x in got["value"].to_pylist()],
    )


def unused(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores before it as make it differ from all columns (upper and lower case are the same to Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scored_rows(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], text_col: str, name: str) -> DataFrame:
    """Every row with all its columns and ``name``, its score; nothing is joined, so ids may repeat or be missing."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, data, off in slices(batch.column(at)):
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns), pa.array(score(data, off), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(id_col, score) of every document. ``score``: bytes, offsets -> one number for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, data, off in slices(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(score(data, off), pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, score double")
