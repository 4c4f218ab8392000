import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.operators import evaluate as E
from millrace.operators import prompts as P


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("value, letter", [("选A吧 B", "A"), ("A or B?", "A"), ("it is C", "C"), ("maybe C or D", ""), ("", ""), ("答案为：D", "D"), ("选择 B 或 C", "B"), (" B", "B")])
def test_extract(spark, value, letter):
    assert one(spark, value, M.extract_answer) == letter


@pytest.mark.parametrize("value, valid", [("a", True), ("AB", True), ("AC", False), ("", False), (None, False), ("E", False)])
def test_validity(spark, value, valid):
    assert one(spark, value, M.valid_answer) is valid


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc中", k=rng.randint(0, 40))) for _ in range(2))
        assert M.common_subsequence(a, b) == lcs(a, b)
    assert M.rouge_l_values(pd.Series(["", "ab", None]), pd.Series(["a", "b", "x"]))["f1"].round(4).tolist() == [0, 0.6667, 0]


def bleu(r, h):
    precisions = []
    for n in range(1, 5):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (r, h))
        total = sum(b.values())
        precisions.append(sum(min(c, a[g]) for g, c in b.items()) / total if total else 0)
    if min(precisions) == 0:
        return 0.0
    short = math.exp(1 - len(r) / len(h)) if len(h) < len(r) else 1
    return round(short * math.exp(sum(map(math.log, precisions)) / 4), 4)


def test_bleu():
    rng = random.Random(3)
    pairs = [("abcabc", "abc"), ("", "x"), ("abcd", "abcd")] + [tuple("".join(rng.choices("ab中", k=rng.randint(1, 30))) for _ in range(2)) for _ in range(200)]
    got = M.bleu_values(*map(pd.Series, zip(*pairs)))
    assert got.tolist() == pytest.approx([bleu(*p) if len(p[1]) >= 4 and p[0] else 0.0 for p in pairs], abs=1.1e-4)


def test_scores_of_classes(spark):
    df = spark.createDataFrame(list(zip("ABAA", "ABCA")), "y_true string, y_pred string")
    assert E.accuracy(df).first().accuracy == 0.75
    got = {r.label: (r.precision, r.recall, r.f1) for r in E.per_label(df).collect()}
    assert got == {"A": (1.0, 0.6667, 0.8), "B": (1.0, 1.0, 1.0), "C": (0.0, 0.0, 0.0)}
    assert E.f1_summary(df).first().f1 == 0.6
    assert E.f1_summary(df, "weighted").first() == E.f1_summary(df, "micro").first()  # anything but macro is micro
    assert E.accuracy(df.filter("false")).first().accuracy == 0


def test_sentiment(spark):
    rows = [("利好", "积极"), ("负面", "?"), ("odd", "positive"), ("中性", "neutral")]
    got = {r.label: (r.tp, r.fp, r.fn, r.total) for r in E.sentiment_report(spark.createDataFrame(rows, "label string, predicted_label string")).collect()}
    assert got == {"positive": (1, 0, 0, 3), "negative": (0, 0, 1, 3), "unknown": (0, 1, 0, 3), "neutral": (1, 0, 0, 3)}


def test_code(spark):
    rows = [("```python\nimport os\ndef f():\n    pass\n```",), ("def (:",), ("  ",), ("x = 1",)]
    got = E.code_report(spark.createDataFrame(rows, "prediction string")).first()
    assert (got.n, got.syntax_rate, got.import_rate, got.function_rate) == (3, 0.6667, 0.3333, 0.6667)


def test_coverage_and_quality(spark):
    assert one(spark, "风险 评级", lambda c: M.keyword_coverage(c, ["风险", "评级", "波动"])) == 0.6667
    assert one(spark, "x", lambda c: M.keyword_coverage(c, [])) == 1.0
    assert one(spark, "", M.response_quality) == 0.0
    assert one(spark, "1. 风险：\n资产 ROE 综上" + "x" * 40, M.response_quality) == 1.0
    assert one(spark, "x" * 25, M.response_quality) == 0.25


def test_generation_report(spark):
    df = spark.createDataFrame([("abc", "abc"), ("", "x"), ("abcd", "趋势支撑")], "reference string, prediction string")
    got = E.generation_report(df, "stock_analysis").first()
    assert (got.n, got.rouge_l, got.mean_length, got.coverage) == (2, 0.5, 3.5, 0.1667)
    assert E.generation_report(df, "financial_qa").first().coverage is None


def failing():
    def flaky(prompts):  # within a function: workers get it by value
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [("A", 1, 2) for _ in prompts]

    return flaky


def test_multiple_choice_counts_failures_as_wrong(spark):
    rows = [("q", "1", "2", "3", "4", "a"), ("bad", "1", "2", "3", "4", "A"), ("q", "1", "2", "3", "4", "AB"), ("q", "1", "2", "3", "4", "AC")]
    items = spark.createDataFrame(rows, "question string, A string, B string, C string, D string, answer string").repartition(4)
    report = E.mcq_report(items, failing())
    assert report[0].first().n == 3
    assert report[0].first().accuracy in (0.3333, 0.0)
    assert "题目：q\nA. 1" in report[1].filter("question = 'q'").first().prompt


def test_cached_generation(spark):
    asked = spark.createDataFrame([(0, "t", "one"), (1, "t", "bad"), (2, "t", "two")], "seq int, task string, prompt string")
    from millrace.functions.text import cache_key

    cache = asked.select(cache_key(F.col("task"), F.col("prompt")).alias("key"), F.when(F.col("seq") == 0, "known").otherwise("").alias("answer"))
    got = {r.seq: r for r in P.answered(asked.repartition(3, "seq"), cache, failing()).collect()}
    assert got[0].cached and got[0].answer == "known"  # an empty cached answer is none
    assert not got[1].cached and got[1].answer == "" and "RuntimeError" in got[1].error


def test_gram_similarity(spark):
    long = "".join(random.Random(3).choices("abcdefgh ", k=40000)).strip()  # minutes when each gram is put together from letters
    rows = [("abcdef", "abcdeg"), ("", ""), ("abc", "abc"), ("aaaaaaa", None), (None, "abcdef"), ("a\U0001f600bcde", "a\U0001f600bcdf"), (long, long[1:])]
    got = spark.createDataFrame(rows, "t string, u string").select(M.gram_similarity(F.col("t"), F.col("u")).alias("s")).select("s.*").collect()
    sizes = [tuple(None if x is None else {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in r) for r in rows]
    for (a, b), r in zip(sizes, got, strict=True):
        assert r.n_grams == (None if a is None else len(a))
        assert r.jaccard == (None if a is None or b is None else len(a & b) / len(a | b))
