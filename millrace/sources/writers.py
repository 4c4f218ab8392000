"""Writers. Distributed forms are folders of part files; single files are exports of small results by the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an export to one file takes at most.
EXPORT = 1_000_000


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _bounded(df: DataFrame) -> list[dict]:
    rows = df.limit(EXPORT + 1).collect()
    if len(rows) > EXPORT:
        raise ValueError(f"more than {EXPORT} rows: write a folder of part files instead")
    return [r.asDict(recursive=True) for r in rows]


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, path: str) -> None:
    """One UTF-8 file with an indented array; null fields are left out."""
    rows = [{k: v for k, v in r.items() if v is not None} for r in _bounded(df)]
    _write_text(df.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=2, default=str))


def csv_with_mark(df: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, for spreadsheets."""
    import csv
    import io

    buffer = io.StringIO()
    out = csv.writer(buffer, lineterminator="\n")
    out.writerow(df.columns)
    for r in _bounded(df):
        out.writerow(["" if r[c] is None else r[c] for c in df.columns])
    _write_text(df.sparkSession, path, "﻿" + buffer.getvalue())


def csv_parts(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def per_task(df: DataFrame, path: str, task: str = "task") -> None:
    """Canonical conversations in a folder for each task."""
    df.write.mode("overwrite").partitionBy(task).json(path)


def with_meta(df: DataFrame, path: str, expected: int | None = None, source: str = "") -> None:
    """Parquet and JSON copies, and meta.json with the counts."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    back = df.sparkSession.read.parquet(f"{path}/parquet")
    back.write.mode("overwrite").json(f"{path}/json")
    now = df.sparkSession.sql("select cast(current_timestamp() as string) t").first()["t"]
    meta = {"count": back.count(), "expected_count": expected, "source": source, "time": now}
    _write_text(df.sparkSession, f"{path}/meta.json", json.dumps(meta, ensure_ascii=False, indent=2))


def results(df: DataFrame, path: str) -> str:
    """By suffix .json or .csv; any other becomes .json. Gives the path written."""
    if path.endswith(".csv"):
        csv_with_mark(df, path)
        return path
    if not path.endswith(".json"):
        path = f"{path.rsplit('.', 1)[0] if '.' in path.rsplit('/', 1)[-1] else path}.json"
    json_array(df, path)
    return path


def append_new(new: DataFrame, path: str, key: str, seq: str) -> None:
    """Appends the rows whose key the table at ``path`` lacks."""
    from millrace.operators.news import unseen

    spark = new.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        new = unseen(new, spark.read.schema(new.schema).parquet(path), key, seq)
    else:
        new = unseen(new, new.filter(F.lit(False)), key, seq)
    new.write.mode("append").parquet(path)


def missing_from(manifest: DataFrame, wanted: DataFrame, key: str, least: int = 100) -> DataFrame:
    """What is wanted and not in the manifest (key, size) with more than ``least`` bytes."""
    return wanted.join(manifest.filter(F.col("size") > least).select(key), key, "left_anti")
