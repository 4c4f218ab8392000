"""Whole pipelines, as plans over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.operators import bars, dedup, mix, prompts, quality
from millrace.operators.convert import convert
from millrace.sources.scratch import cut


def filtered(rows: DataFrame, near_limit: int | None = None) -> DataFrame:
    """Canonical rows that pass the rules, without exact and near-duplicates."""
    passed = quality.with_reason(rows).filter("reason = 'OK'").drop("reason")
    return dedup.dedup_conversations(passed, most=near_limit)


def mixed(tasks: dict[str, DataFrame], seed: int = K.SEED, caps: dict[str, int] | None = None) -> DataFrame:
    """Task tables to one, each capped, with split (train, eval) and position."""
    parts = [df.select("conversations", "system", F.coalesce("task_type", F.lit(t)).alias("task_type"), F.lit(t).alias("task"), F.concat(F.lit(f"{t}/"), F.col("seq").cast("string")).alias("key")) for t, df in tasks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return mix.split_train_eval(cut(mix.sample_tasks(out, caps=caps, seed=seed)), seed=seed)


def instruction_corpus(datasets: dict[str, DataFrame], systems: dict[str, str] | None = None, task_of: dict[str, str] | None = None, seed: int = K.SEED) -> DataFrame:
    """Raw JSON rows of datasets (seq, line) to train and eval rows: convert, filter, mix. ``task_of``: dataset name -> task; others are general."""
    tasks: dict[str, list[DataFrame]] = {}
    for name, lines in datasets.items():
        task = (task_of or {}).get(name, "general")
        tasks.setdefault(task, []).append(convert(lines, (systems or {}).get(task, ""), task))
    done = {}
    for task, parts in tasks.items():
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        done[task] = filtered(cut(rows))
    return mixed(done, seed)


def market_conversations(daily: DataFrame, cache: DataFrame, generator: Callable, system: str = "") -> DataFrame:
    """Bars to indicator summaries to prompts to answered conversations."""
    summary = bars.market_summary(bars.with_indicators(daily)).select(F.col("symbol").alias("stock_code"), F.col("symbol").alias("stock_name"), "market_data")
    asked = prompts.with_prompt(summary, "stock_analysis").withColumns({"task": F.lit("stock_analysis"), "seq": F.col("stock_code")})
    return prompts.as_records(prompts.answered(asked, cache, generator), system)
