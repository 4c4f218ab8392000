"""News rows: cleaning, identity and incremental intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.text import clean_text, flat_text, news_id, zero_padded


def clean_news(df: DataFrame) -> DataFrame:
    """Cleaned titles of 5 to 200 characters (rows without one go) and contents (empty when rejected)."""
    title = clean_text(F.col("title"), *K.NEWS_TITLE)
    return df.withColumns({"title": title, "content": F.coalesce(clean_text(F.col("content")), F.lit(""))}).filter("title is not null")


def news_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(total, valid, filtered)."""
    n = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    both = n(before).withColumnRenamed("n", "total").join(F.broadcast(n(after).withColumnRenamed("n", "valid")))
    return both.withColumn("filtered", F.col("total") - F.col("valid"))


def normalised(df: DataFrame, title: str = "title", content: str = "content", date: str = "date", source: str = "source", code: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """News records with news_id; titles of fewer than 5 characters go. names (stock_code, stock_name): a dictionary of symbols."""
    rows = df.select(flat_text(F.col(title)).alias("title"), flat_text(F.col(content)).alias("content"), F.coalesce(F.col(date).cast("string"), F.lit("")).alias("date"),
                     F.coalesce(F.col(source), F.lit("")).alias("source"), (zero_padded(F.col(code)) if code else F.lit(None).cast("string")).alias("stock_code"))
    rows = rows.filter(F.length("title") >= 5).withColumn("news_id", news_id(F.col("title"), F.col("date")))
    if names is None:
        named = rows.withColumn("stock_name", F.when(F.col("stock_code").isNotNull(), F.lit("")))
    else:
        named = rows.join(names.select("stock_code", "stock_name"), "stock_code", "left").withColumn("stock_name", F.coalesce("stock_name", F.lit("")))
    return named.select("news_id", "stock_code", "stock_name", "title", "content", "date", "source")


def unseen(new: DataFrame, existing: DataFrame, key: str = "news_id", seq: str = "seq") -> DataFrame:
    """Rows of ``new`` whose key isn't in ``existing``, once for each key: the first by seq."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(seq).alias(seq))
    return fresh.join(first, [key, seq], "left_semi")
