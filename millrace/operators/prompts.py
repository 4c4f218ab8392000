"""Prompts and cached generation. The generator is a function of batches of prompts, given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.text import cache_key, filled, is_present, strip


def questions() -> list[tuple[int, str]]:
    return list(enumerate(K.QUESTIONS))


def sentiment_inputs(news: DataFrame, most: int | None = 500, order: str = "news_id") -> DataFrame:
    """(news_id, title, content): titles of more than 10 characters, 500 characters of content. The cap follows ``order``."""
    rows = news.filter(is_present(F.col("title")) & (F.length("title") > 10)).select(order, "title", F.substring(F.coalesce("content", F.lit("")), 1, 500).alias("content"))
    return rows.orderBy(order).limit(most) if most is not None else rows


def with_prompt(df: DataFrame, task: str, template: str | None = None) -> DataFrame:
    """Column prompt from the task's template; rows that lack a value of it go."""
    return df.withColumn("prompt", filled(template or K.TEMPLATES[task], df.columns)).filter("prompt is not null")


def split_by_cache(requests: DataFrame, cache: DataFrame, task: str = "task", prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """(answered, missing): requests whose key has a non-empty answer in cache (key, answer), and the others."""
    keyed = requests.withColumn("key", cache_key(F.col(task), F.col(prompt)))
    good = cache.filter(F.coalesce(F.col("answer"), F.lit("")) != "").groupBy("key").agg(F.min("answer").alias("answer"))
    return keyed.join(good, "key"), keyed.join(good.select("key"), "key", "left_anti")


def generate(requests: DataFrame, generator: Callable[[list[str]], list[tuple[str, int, int]]], prompt: str = "prompt", attempts: int = 3, batch: int = 16) -> DataFrame:
    """The requests with answer, input_tokens, output_tokens and error. ``generator``: prompts -> (answer, tokens in, tokens out) each.

    A batch that fails is tried again, up to ``attempts`` times in all; then its rows have an empty answer and the error.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for at in range(0, len(frame), batch):
                asked = frame[prompt].iloc[at : at + batch].tolist()
                error = None
                for _ in range(attempts):
                    try:
                        rows += [(*r, None) for r in generator(asked)]
                        break
                    except Exception as e:  # the generator is foreign code: its failure is a result
                        error = f"{type(e).__name__}: {e}"
                else:
                    rows += [("", None, None, error)] * len(asked)
            made = pd.DataFrame(rows, columns=["answer", "input_tokens", "output_tokens", "error"], index=frame.index)
            yield pd.concat([frame, made.astype({"input_tokens": "Int64", "output_tokens": "Int64"})], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{schema}, answer string, input_tokens long, output_tokens long, error string")


def answered(requests: DataFrame, cache: DataFrame, generator: Callable, task: str = "task", prompt: str = "prompt") -> DataFrame:
    """Cached answers where there are, generated ones elsewhere (cached: which)."""
    hits, misses = split_by_cache(requests, cache, task, prompt)
    none = F.lit(None)
    old = hits.withColumns({"input_tokens": none.cast("long"), "output_tokens": none.cast("long"), "error": none.cast("string"), "cached": F.lit(True)})
    return old.unionByName(generate(misses, generator, prompt).withColumn("cached", F.lit(False)))


def generation_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("answer"), F.lit("")) != "").alias("n_answered"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens")
    )


def as_records(results: DataFrame, system: str = "", task: str = "task", prompt: str = "prompt", seq: str = "seq") -> DataFrame:
    """Canonical conversations of the answered prompts."""
    rows = results.filter(is_present(F.col("answer")))
    turns = F.array(F.struct(F.lit("human").alias("from"), strip(F.col(prompt)).alias("value")), F.struct(F.lit("gpt").alias("from"), strip(F.col("answer")).alias("value")))
    return rows.select(seq, turns.alias("conversations"), F.lit(system).alias("system"), F.nullif(F.col(task), F.lit("")).alias("task_type"))
