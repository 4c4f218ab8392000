"""The rule filter over canonical conversations: the first rule that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.text import distinct_characters, strip


def _first(turns: Column, role: str) -> Column:
    own = F.filter(turns, lambda t: t["from"] == role)
    return F.when(F.size(own) > 0, F.coalesce(own[0]["value"], F.lit("")))


def reason(turns: Column) -> Column:
    """OK, or why a conversation is rejected; a null conversation has no turns.

    An answer is judged as it stands, as in the original: white space at its ends counts. A question is stripped first.
    """
    user, answer = strip(_first(turns, "human")), _first(turns, "gpt")
    size = F.length(answer)
    head = F.substring(answer, 1, K.REFUSAL_HEAD)
    refusals = F.when(F.lit(False), F.lit(""))
    for marker in K.REFUSALS:
        refusals = refusals.when(head.contains(marker), F.lit(f"refusal: {marker}"))
    return (
        F.when(turns.isNull() | (F.size(turns) < 2), F.lit("fewer than two turns"))
        .when(user.isNull() | answer.isNull(), F.lit("a role is missing"))
        .when(F.length(user) < K.MIN_QUESTION, F.lit("question too short"))
        .when(size < K.MIN_RESPONSE, F.concat(F.lit("answer too short: "), size.cast("string")))
        .when(size > K.MAX_RESPONSE, F.concat(F.lit("answer too long: "), size.cast("string")))
        .when(refusals.isNotNull(), refusals)
        .when(distinct_characters(answer) < K.MIN_DISTINCT, F.lit("too few distinct characters"))
        .otherwise(F.lit("OK"))
    )


def with_reason(df: DataFrame, turns: str = "conversations") -> DataFrame:
    return df.withColumn("reason", reason(F.col(turns)))


def reason_counts(df: DataFrame) -> DataFrame:
    """(reason, n) of rejected rows, most frequent first, ties by name."""
    return df.filter("reason <> 'OK'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def pass_rate(df: DataFrame) -> DataFrame:
    n, fine = F.count(F.lit(1)), F.count_if(F.col("reason") == "OK")
    return df.agg(n.alias("n_in"), fine.alias("n_out"), F.round(1 - fine / F.greatest(n, F.lit(1)), 6).alias("filter_rate"))
