"""Evaluation reports: classification, sentiment, text generation, code and multiple choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.metrics import code_of, extract_answer, has_function, has_import, keyword_coverage, mcq_prompt, parses, rouge_l, sentiment_label, valid_answer
from millrace.functions.text import is_present, strip
from millrace.operators.prompts import generate


def zipped(left: DataFrame, right: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows by place; the longer side's rest goes."""
    return left.join(right, seq)


def accuracy(pairs: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    same = F.count_if(F.col(truth).eqNullSafe(F.col(guess)))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.try_divide(same, F.count(F.lit(1))), 4), F.lit(0.0)).alias("accuracy"))


def confusion(pairs: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    return pairs.groupBy(F.col(truth).alias("t"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _shares() -> dict[str, Column]:
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return {"precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall)}


def label_counts(pairs: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """(label, tp, fp, fn) of every label on either side, from the confusion counts."""
    counts = confusion(pairs, truth, guess)
    hit = F.col("t") == F.col("p")
    sides = F.explode(F.when(hit, F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).otherwise(
        F.array(
            F.struct(F.col("t").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn")),
        )
    ))
    return counts.select(sides.alias("s")).groupBy("s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))


def per_label(pairs: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """(label, precision, recall, f1), rounded to 4 digits."""
    return label_counts(pairs, truth, guess).select("label", *[F.round(c, 4).alias(n) for n, c in _shares().items()])


def f1_summary(pairs: DataFrame, average: str = "macro", truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """One row of precision, recall and f1. macro: means of the rounded values of labels; anything else: of the summed counts."""
    if average == "macro":
        return per_label(pairs, truth, guess).agg(*[F.coalesce(F.round(F.avg(n), 4), F.lit(0.0)).alias(n) for n in ("precision", "recall", "f1")])
    total = label_counts(pairs, truth, guess).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("tp", "fp", "fn")])
    return total.select(*[F.round(c, 4).alias(n) for n, c in _shares().items()])


def sentiment_report(pairs: DataFrame, truth: str = "label", guess: str = "predicted_label") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, accuracy, total): labels normalised, unknown truths left out, an unknown guess is a
    class that has false positives only; the last two are those of all rows."""
    known = pairs.select(sentiment_label(F.col(truth)).alias("y_true"), sentiment_label(F.col(guess)).alias("y_pred")).filter("y_true <> 'unknown'")
    all_ = accuracy(known).select(F.col("n").alias("total"), "accuracy")
    return label_counts(known).select("label", "tp", "fp", "fn", *[F.round(c, 4).alias(n) for n, c in _shares().items()]).join(F.broadcast(all_))


def generation_report(pairs: DataFrame, task: str, truth: str = "reference", guess: str = "prediction") -> DataFrame:
    """(n, rouge_l, mean_length, coverage): pairs with an empty side are skipped; coverage is null for a task without keywords."""
    words = K.TASK_KEYWORDS.get(task, [])
    full = pairs.filter((F.coalesce(F.col(truth), F.lit("")) != "") & (F.coalesce(F.col(guess), F.lit("")) != ""))
    hits = sum(F.col(guess).contains(w).cast("int") for w in words) / len(words) if words else F.lit(None).cast("double")
    rows = full.select(rouge_l(F.col(truth), F.col(guess))["f1"].alias("r"), F.length(guess).alias("size"), hits.alias("hits"))
    mean = lambda c, digits: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    coverage = F.round(F.avg("hits"), 4) if words else F.lit(None).cast("double")
    return rows.agg(F.count(F.lit(1)).alias("n"), mean("r", 4).alias("rouge_l"), mean("size", 1).alias("mean_length"), coverage.alias("coverage"))


def code_report(df: DataFrame, answer: str = "prediction") -> DataFrame:
    """Shares of answers whose code parses, imports and defines, and its mean length; blank code is skipped."""
    code = df.select(code_of(F.coalesce(F.col(answer), F.lit(""))).alias("code")).filter(is_present(F.col("code")))
    rows = code.select(parses(F.col("code")).alias("fine"), has_import(F.col("code")).alias("imports"), has_function(F.col("code")).alias("defines"), F.length("code").alias("size"))
    share = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 4)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), share("fine").alias("syntax_rate"), share("imports").alias("import_rate"), share("defines").alias("function_rate"),
        F.round(F.coalesce(F.avg("size"), F.lit(0.0)), 1).alias("mean_length"),
    )


def mcq_prompts(items: DataFrame) -> DataFrame:
    """Items with an answer that counts, with prompt and truth; the question may be called input."""
    at = lambda n: F.col(n) if n in items.columns else F.lit(None).cast("string")
    fine = items.filter(valid_answer(F.col("answer")))
    return fine.withColumns({"prompt": mcq_prompt(F.coalesce(at("question"), at("input")), at("A"), at("B"), at("C"), at("D")), "truth": F.upper(strip(F.col("answer")))})


def mcq_report(items: DataFrame, generator: Callable) -> tuple[DataFrame, DataFrame]:
    """(accuracy, details); items whose generation failed count as wrong."""
    asked = mcq_prompts(items).drop("answer")
    details = generate(asked, generator).withColumn("predicted", extract_answer(F.coalesce("answer", F.lit(""))))
    details = details.withColumn("correct", F.col("predicted") == F.col("truth"))
    return details.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg(F.col("correct").cast("int")), 4), F.lit(0.0)).alias("accuracy")), details


def keyword_report(df: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    return df.withColumn("coverage", keyword_coverage(F.col(text), keywords))
