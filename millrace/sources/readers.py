"""Readers of the layouts that raw data comes in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as missing in a CSV cell besides the empty one.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def json_rows(spark: SparkSession, path: str, skip: tuple[str, ...] = ("meta.json",)) -> DataFrame:
    """(file, seq, line): the objects of all JSON files below a folder, as text, in the order of file names and places.

    A file may hold an array, one object, or an object in each line; files that are none of these give no rows. Names with a
    leading underscore and those in ``skip`` are left out. A file is one row until it is split, so single files should fit in memory.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    last = F.element_at(F.split(name, "/"), -1)
    files = files.select(name.alias("file"), F.regexp_replace("value", r"^[﻿\s]+", "").alias("value")).filter(~last.startswith("_") & ~last.isin(*skip))
    parsed = F.try_parse_json("value")
    kind = lambda v: F.schema_of_variant(F.try_parse_json(v))  # noqa: E731  (it reads the first value and ignores what follows)
    array = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: F.to_json(v)))
    rows = F.split("value", r"\r?\n")
    lines = F.when(kind(rows[0]).startswith("OBJECT"), F.filter(rows, lambda x: kind(x).startswith("OBJECT")))
    one = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.array("value"))
    return files.select("file", F.posexplode(F.coalesce(array, lines, one)).alias("place", "line")).select(
        "file", F.struct("file", "place").alias("order"), "place", "line"
    ).withColumn("seq", F.col("place").cast("long")).select("file", "seq", "line")


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): CSV files decoded as UTF-8 (with or without a mark), or as GBK where that fails."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)

    def decoded(frames):
        for frame in frames:
            texts = []
            for content in frame["content"]:
                for encoding in ("utf-8-sig", "gbk"):
                    try:
                        texts.append(bytes(content).decode(encoding))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    texts.append(None)  # neither: the file is skipped
            yield frame.assign(text=texts)[["file", "text"]]

    return raw.select(F.col("path").alias("file"), "content").mapInPandas(decoded, "file string, text string").filter("text is not null")


def csv_table(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, all columns strings; cells that mean missing are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows, then without columns, that are all null. The schema depends on the data: one pass counts the columns."""
    some = F.lit(False)
    for c in df.columns:
        some = some | F.col(f"`{c}`").isNotNull()
    rows = df.filter(some)
    counts = rows.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(rows.columns)]).first()
    return rows.select(*[f"`{c}`" for i, c in enumerate(rows.columns) if counts[i]])


def repaired(df: DataFrame, wanted: tuple[str, ...] = ("explanation",)) -> DataFrame:
    """Without the unnamed columns of spreadsheets, with the wanted ones (empty where missing)."""
    out = df.select(*[f"`{c}`" for c in df.columns if not re.match(r"(Unnamed|_c\d+$)", c)])
    for c in wanted:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in out.columns else F.lit(""))
    return out


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns differ."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question and what else the file has: .json (strings or objects) or .csv with a column question. ValueError otherwise."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        df = csv_table(spark, path)
    elif suffix == "json":
        text = spark.read.text(path, wholetext=True)
        strings = text.select(F.from_json("value", "array<string>", {"mode": "PERMISSIVE"}).alias("a")).select(F.posexplode("a").alias("seq", "v"))
        objects = strings.filter(F.col("v").startswith("{")).limit(1).count()
        if not objects:
            return strings.select("seq", F.col("v").alias("question"))
        df = spark.read.option("multiLine", True).json(path)
    else:
        raise ValueError(f"no reader for .{suffix} files")
    if "question" not in df.columns:
        raise ValueError("no column question")
    return df


def mcq_items(spark: SparkSession, path: str) -> DataFrame:
    """Multiple choice items of JSON files: a list (entries with question or input), or an object of lists (all entries)."""
    fields = "struct<question:string,input:string,A:string,B:string,C:string,D:string,answer:string>"
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    files = files.filter(~F.col("file").startswith("_"))
    lists = files.filter(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<{fields}>")).alias("i")).filter("i.question is not null or i.input is not null")
    maps = files.filter(F.ltrim("value").startswith("{")).select(F.explode(F.map_values(F.from_json("value", f"map<string,array<{fields}>>"))).alias("l")).select(F.explode("l").alias("i"))
    return lists.unionByName(maps).select("i.*")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(task, task_name, task_name_en, system_prompt, keywords) of a prompt dictionary; entries without a prompt are left out."""
    kind = "struct<task_name:string,task_name_en:string,system_prompt:string,keywords:array<string>>"
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("task", "entry"))
    own = pairs.select("task", F.from_json("entry", kind).alias("e")).filter(~F.col("task").startswith("_"))
    return own.select("task", "e.*").filter("system_prompt is not null")


def preferred_files(listing: DataFrame, name: str = "name", mark: str = "_filtered", prefix: str = "", outputs: tuple[str, ...] = ()) -> DataFrame:
    """Task files ({prefix}{task}[_filtered].json) with column task: the filtered one where both are there, never the outputs."""
    own = listing.filter(F.col(name).rlike(rf"^{re.escape(prefix)}.*\.json$") & ~F.col(name).isin(*outputs))
    stem = F.regexp_replace(F.col(name), rf"^{re.escape(prefix)}|\.json$", "")
    own = own.withColumn("task", F.regexp_replace(stem, f"{re.escape(mark)}$", "")).withColumn("_filtered", stem.endswith(mark))
    best = own.groupBy("task").agg(F.max("_filtered").alias("_filtered"))
    return own.join(best, ["task", "_filtered"], "left_semi").drop("_filtered")


BAR_FIELDS = ["date", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "price_change", "turnover"]


def bars_from_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Comma-joined quote lines to typed columns; what isn't a number is null."""
    cell = lambda i: F.get(F.split(line, ","), F.lit(i))
    number = lambda i: F.when(~F.isnan(cell(i).try_cast("double")), cell(i).try_cast("double"))
    return df.select(*[c for c in df.columns if c != line], cell(0).alias("date"), *[number(i).alias(c) for i, c in enumerate(BAR_FIELDS) if i])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their canonical names; of several that mean one, the first one that is there."""
    taken: set[str] = set()
    out = {}
    for old, new in names.items():
        if old in df.columns and new not in taken:
            out[old] = new
            taken.add(new)
    return df.withColumnsRenamed(out)


def prefer(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``primary``, and of ``fallback`` the keys that it lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def constituents(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(code, name) as strings, codes with their leading zeros, whatever the source calls them."""
    from millrace.functions.text import zero_padded

    own = renamed(df, aliases)
    text: Column = F.col("code").cast(T.StringType())
    return own.select(zero_padded(text).alias("code"), F.col("name").cast("string").alias("name"))
