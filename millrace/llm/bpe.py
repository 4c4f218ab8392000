"""BPE encoding and decoding of a text column by a pair occurrence index (see ``wordbpe``).

Defined results: null and empty texts have no ids and decode to the empty text; special tokens that stand in a
text become their ids, as in the library; repeated rows give equal results; other columns aren't read.
Texts are never cut: a batch's memory follows its bytes, and a worker forgets its words beyond a fixed count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textbatch import KEPT, slices, tidy
from millrace.llm.wordbpe import Words

#: Bytes of a partition's text that are split, merged and looked up together; a longer text stands alone.
BLOCK = 1 << 23


def words_of(spec: Broadcast, merged: str = "index") -> Words:
    """The worker's own instance, kept from task to task."""
    key = (hash(spec.value), merged)
    if key not in KEPT:
        tidy()
        KEPT[key] = Words(spec.value, merged)
    return KEPT[key]


def tokenizer_spec(docs: DataFrame, path: str) -> Broadcast:
    """The tokenizer file's text, read on the driver: executors need no copy of it. Its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id_col and, as asked for, ids array<long>, decoded string, and their digests.

    ``outputs`` may hold ids, decoded, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids) and decoded_sha256.
    """
    kinds = {"ids": ("array<long>", pa.list_(pa.int64())), "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()),
             "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    spec = tokenizer_spec(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(spec)
        make = {
            "ids": lambda ids, numbers: ids.astype(np.int64),
            "decoded": lambda ids, numbers: words.text_from(numbers),
            "n_tokens": lambda ids, numbers: len(ids),
            "ids_sha256": lambda ids, numbers: hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": lambda ids, numbers: hashlib.sha256(words.text_from(numbers).encode()).hexdigest(),
        }
        for batch in batches:
            for a, b, _, _ in slices(batch.column(1), BLOCK):
                part = batch.slice(a, b - a)
                numbers, first = words.numbers(part.column(1).to_pylist())
                ids, cut = words.ids_of(numbers, first)
                each = [(x, y) for x, y in zip(np.split(ids.astype("<u4"), cut[1:-1]), np.split(numbers, first[1:-1]))]
                yield pa.record_batch([part.column(0), *(pa.array([make[o](*x) for x in each], kinds[o][1]) for o in outputs)], [id_col, *outputs])

    own = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return own.mapInArrow(run, ", ".join([f"`{id_col}` long", *(f"{o} {kinds[o][0]}" for o in outputs)]))


def decode(ids: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text: tokens joined as the library joins them; a null list gives a null text, ids out of the vocabulary are skipped."""
    spec = tokenizer_spec(ids, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = words_of(spec).text_of
        for batch in batches:
            texts = [None if x is None else " ".join(names[i] for i in x if i in names) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return ids.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<long>")).mapInArrow(run, f"`{id_col}` long, text string")
