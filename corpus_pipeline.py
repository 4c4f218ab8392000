"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

1. toxicity: documents that the classifier calls toxic go;
2. near_dedup: of each component of near-duplicates (5-word shingles, similarity 0.8 or more) the document with the least id stays;
   of repeated rows (one doc_id) one stays;
3. suffix_dedup: bytes that an earlier document holds too (windows of 50) go from the text; a document that loses everything goes;
4. secrets: every span that the scan finds is replaced by ``[SECRET]``;
5. packing: sequences of at most 4096 tokens (the last stage; it returns pieces, not documents).

Defined results: extra columns of the input, whatever their names, pass through stages 1 to 4. Null texts stay null unless a stage rejects the row.
Rows without a doc_id are judged by their texts in stages 1 and 4; in 2 and 3, which go by the order of ids, they stay as they are. Repeated rows
become one in stage 2 and never multiply; rows with one id and different texts are documents of their own. Ties go to the
least id. Texts of any length are whole. An empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.catalog import table, tokenizer_path
from millrace.llm.minhash import near_duplicates
from millrace.llm.packing import pack
from millrace.llm.samples import unused
from millrace.llm.secrets import redact
from millrace.llm.shared import Scratch
from millrace.llm.substrings import remove_shared, text_without
from millrace.llm.toxicity import without_toxic


#: The stage's threshold is op5's no more: 36 bands of 5 all miss a pair of similarity 0.8 with probability 6e-7.
PART, BANDS = 80, 36


def with_length(docs: DataFrame, changed: Column) -> DataFrame:
    """n_chars follows a text that has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs, part=PART, bands=BANDS).filter("kept").select("doc_id")
    own, key = docs.filter("doc_id is not null"), unused("text_hash", docs)
    once = own.join(kept, "doc_id", "left_semi").withColumn(key, text_hash()).dropDuplicates(["doc_id", key]).drop(key)
    return once.unionByName(docs.filter("doc_id is null"))


def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else text_without(x) for x in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "was", "new"])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = remove_shared(docs, want_kept=True).filter("doc_id is not null and n_removed > 0").select("doc_id", "text_hash", "kept")
    was, new = unused("was", docs), unused("new", docs)
    texts = found.mapInArrow(_as_text, "doc_id long, was long, new string").repartition("doc_id", "was").dropDuplicates(["doc_id", "was"])
    texts = texts.withColumnsRenamed({"was": was, "new": new})
    # rows that share an id are told apart by their texts, and equal rows get one text each: none multiplies
    joined = docs.withColumn(was, text_hash()).join(texts, ["doc_id", was], "left").filter(f"`{new}` is null or `{new}` <> ''")
    joined = joined.withColumn("text", F.coalesce(new, "text"))
    return with_length(joined, F.col(new).isNotNull()).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = unused("changed", docs)
    return with_length(redact(docs, changed=changed), F.col(changed)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("secrets", secrets), ("packing", packing)]

#: Trained classifiers and a network decide in stages 1 and 4: not for SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
