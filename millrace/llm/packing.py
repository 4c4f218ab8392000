"""Packing of tokenised documents into sequences by first-fit decreasing.

A document's ids (with the end id) are cut at multiples of the sequence length. Each piece goes, by a hash of
its document's id, its place and its content, to one of many groups of at most about ``group_size`` pieces, so that a huge
document is spread over all of them; each group is packed by itself: pieces in descending length, each into the first bin that has room
(a full piece is thus a sequence of its own). The bins' free space is kept in a tournament tree, whose node
holds the largest free space below it, so that the first bin with room is found in log(bins) steps. The number of groups follows from
the bytes of all texts, which bound their pieces.

Defined results: a null or empty text has the end id only; rows without an id are packed like others; repeated rows are packed as
rows of their own (ties in length are broken by id and start); an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import BLOCK, tokenizer_spec, words_of
from millrace.llm.textbatch import slices

GROUP_SIZE = 4096
#: Sequence ids are group << SHIFT | number in the group.
SHIFT = 32


class Tournament:
    """Bins in order, under a complete binary tree of the largest free space."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1
        self.tree = [0, capacity]
        self.bins = 1

    def _grow(self) -> None:
        free = self.tree[self.leaves : self.leaves + self.bins]
        self.leaves *= 2
        self.tree = [0] * self.leaves + free + [self.capacity] * (self.leaves - len(free))
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of the first bin with room for ``size``; unused leaves are empty bins."""
        if self.tree[1] < size:
            self._grow()
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        offset = self.capacity - tree[i]
        tree[i] -= size
        self.bins = max(self.bins, i - self.leaves + 1)
        found = i - self.leaves
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return found, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bins and offsets of pieces that come in descending size, and how many bins there are."""
    bins = Tournament(capacity)
    placed = [bins.place(s) for s in sizes.tolist()]
    if not placed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    where = np.array(placed, np.int64)
    return where[:, 0], where[:, 1], int(where[:, 0].max()) + 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of every piece."""
    spec = tokenizer_spec(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(spec, "rounds")
        for batch in batches:
            for a, b, _, _ in slices(batch.column(1), BLOCK):
                part = batch.slice(a, b - a)
                ids, first = words.ids_of(*words.numbers(part.column(1).to_pylist()))
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                first = first + np.arange(len(first))
                tokens = np.diff(first)
                many = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(many)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                begin, length = first[doc] + start, np.minimum(tokens[doc] - start, capacity)
                raw = memoryview(ids).cast("B")
                sums = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist())]
                columns = [part.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, sums, tokens[doc]))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(np.split(ids.astype(np.int64), begin[1:]), pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    own_ = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return own_.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def _pack(capacity: int, columns: list[str]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending")])
        sizes = table["length"].to_numpy()
        bins, offsets, _ = first_fit_decreasing(sizes, capacity)
        out = table.select(columns)
        out = out.append_column("sequence_id", pa.array((group << SHIFT) + bins, pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    group_size: int = GROUP_SIZE, seed: int = 11, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    most = docs.agg(F.sum(F.lit(1) + F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) / capacity)).first()[0] or 0
    groups = max(1, math.ceil(most / group_size))
    cut = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "id", "start", "ids_crc32"), F.lit(groups)))
    columns = cut.columns
    schema = ", ".join(f"{c} {'array<long>' if c == 'ids' else 'long'}" for c in columns) + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(_pack(capacity, columns), schema).withColumnRenamed("id", id_col)
