"""Sampling, balancing and splitting of tasks: exact sizes, membership by a keyed hash of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.operators.order import global_rank


def draw(key: str, seed: int = K.SEED) -> Column:
    """A pseudo-random order that other engines can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}_"), F.col(key).cast("string")))


def capped(df: DataFrame, caps: Column, group: str, key: str, seed: int = K.SEED) -> DataFrame:
    """At most ``caps`` rows (a Column of the group) of each group: the first ones in the drawn order.

    The ranks come from one global sort by group and draw, minus where the group begins, so that a large group is spread over tasks.
    """
    ranked = global_rank(df.withColumn("_draw", draw(key, seed)), group, "_draw", key, name="_rank")
    begins = ranked.groupBy(group).agg((F.min("_rank") - 1).alias("_begin"))
    return (
        ranked.join(begins.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
        .filter(F.col("_rank") - F.col("_begin") <= caps).drop("_draw", "_rank", "_begin", "_group")
    )


def task_cap(task: Column, caps: dict[str, int] | None = None, default: int = K.DEFAULT_CAP) -> Column:
    caps = K.TASK_CAP if caps is None else caps
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.coalesce(F.try_element_at(table, task), F.lit(default))


def sample_tasks(df: DataFrame, task: str = "task", key: str = "key", caps: dict[str, int] | None = None, default: int = K.DEFAULT_CAP, seed: int = K.SEED) -> DataFrame:
    return capped(df, task_cap(F.col(task), caps, default), task, key, seed)


def balance_tasks(df: DataFrame, task: str = "task_type", key: str = "key", total: int | None = None, ratios: dict[str, float] | None = None, seed: int = K.SEED) -> DataFrame:
    """At most int(total * ratio) rows of each task with a ratio; unlabelled rows all stay, and so does everything if no row is labelled.

    ``total`` of None or 0: the number of rows. Labelled tasks without a ratio get none.
    """
    ratios = K.TASK_RATIO if ratios is None else ratios
    label = F.nullif(F.col(task), F.lit(""))
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled")).first()
    if not counted["labelled"]:
        return df
    total = total or counted["n"]
    table = F.create_map(*[F.lit(x) for name, r in ratios.items() for x in (name, int(total * r))])
    labelled = capped(df.filter(label.isNotNull()), F.coalesce(F.try_element_at(table, F.col(task)), F.lit(0)), task, key, seed)
    return labelled.unionByName(df.filter(label.isNull()))


def shuffled(df: DataFrame, key: str = "key", seed: int = K.SEED, name: str = "position") -> DataFrame:
    """``name``: the row's place, from 1, in the drawn order."""
    return global_rank(df.withColumn("_draw", draw(key, seed)), "_draw", key, name=name).drop("_draw")


def split_train_eval(df: DataFrame, key: str = "key", share: float = K.TRAIN_SHARE, seed: int = K.SEED) -> DataFrame:
    """split: train for the first int(n * share) rows in the drawn order, eval for the rest."""
    placed = shuffled(df, key, seed, "position")
    cut = int(placed.count() * share)
    return placed.withColumn("split", F.when(F.col("position") <= cut, "train").otherwise("eval"))


def task_distribution(df: DataFrame, task: str, missing: str = "unknown") -> DataFrame:
    """(task, n, percent) with ``missing`` for null and empty tasks."""
    counts = df.groupBy(F.coalesce(F.nullif(F.col(task), F.lit("")), F.lit(missing)).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return counts.join(F.broadcast(whole)).select("task", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("percent"))


def answer_lengths(df: DataFrame, turns: str = "conversations") -> DataFrame:
    """Mean, median, least and greatest length of the model's turns."""
    sizes = df.select(F.explode(turns).alias("t")).filter("t.from = 'gpt'").select(F.length("t.value").alias("n"))
    return sizes.agg(
        F.count("n").alias("n_turns"), F.round(F.avg("n"), 4).alias("mean_length"), F.median("n").alias("median_length"), F.min("n").cast("long").alias("min_length"), F.max("n").cast("long").alias("max_length")
    )
