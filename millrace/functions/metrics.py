"""Scores of generated texts. All are Column expressions but the longest common subsequence, sets of n-grams and the Python parser."""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.text import strip


def extract_answer(c: Column) -> Column:
    """The option letter of an answer: its first letter, else the patterns in order, else the only letter that stands alone."""
    t = strip(c)
    found = [F.nullif(F.regexp_extract(t, "(?U)" + p, 1), F.lit("")) for p in K.ANSWER_PATTERNS]
    alone = F.regexp_extract_all(t, F.lit(r"(?U)\b([ABCD])\b"), 1)
    first = F.when(F.substring(t, 1, 1).isin("A", "B", "C", "D"), F.substring(t, 1, 1))
    return F.coalesce(first, *found, F.when(F.size(alone) == 1, alone[0]), F.lit(""))


def valid_answer(c: Column) -> Column:
    """Whether the upper-cased, stripped truth is a non-empty piece of "ABCD": AB passes, AC doesn't."""
    return F.coalesce(F.upper(strip(c)).isin(K.ANSWERS), F.lit(False))


def mcq_prompt(question: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    parts, rest = [], K.MCQ_PROMPT
    for name, value in (("{question}", question), ("{A}", a), ("{B}", b), ("{C}", c), ("{D}", d)):
        before, _, rest = rest.partition(name)
        parts += [F.lit(before), F.coalesce(value, F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def keyword_coverage(c: Column, keywords: list[str] | Column) -> Column:
    """The share of keywords in the text, to 4 digits; 1 without keywords."""
    if isinstance(keywords, Column):
        hits = F.size(F.filter(keywords, lambda k: F.contains(c, k)))
        return F.when(F.size(keywords) > 0, F.round(hits / F.size(keywords), 4)).otherwise(1.0)
    if not keywords:
        return F.lit(1.0)
    return F.round(sum(c.contains(k).cast("int") for k in keywords) / len(keywords), 4)


def response_quality(c: Column, least: int = 50, most: int = 5000) -> Column:
    n = F.length(c)
    size = F.when((n >= least) & (n <= most), 0.3).when(n < least, n / least * 0.3).otherwise(F.greatest(F.lit(0.0), 1 - (n - most) / most) * 0.3)
    numbered, broken, headed = c.rlike(r"(?mdU)^\d+[.、]"), c.contains("\n"), c.rlike(r"(?U)[：:]\s*\n")
    form = F.when(numbered, 0.5).otherwise(0.0) + F.when(broken, 0.3).otherwise(0.0) + F.when(headed, 0.2).otherwise(0.0)
    terms = sum(c.contains(t).cast("int") for t in K.FINANCE_TERMS)
    tail = F.right(c, F.lit(200))
    ends = F.lit(False)
    for phrase in K.CONCLUSIONS:
        ends = ends | tail.contains(phrase)
    total = size + F.least(form, F.lit(1.0)) * 0.3 + F.least(terms / 3, F.lit(1.0)) * 0.2 + (F.when(ends, 1.0).otherwise(0.5)) * 0.2
    return F.when(c.isNull() | (c == ""), 0.0).otherwise(F.round(total, 4))


def bleu_values(references: pd.Series, hypotheses: pd.Series, most: int = 4) -> pd.Series:
    """Character BLEU with a brevity penalty; 0 where a precision is 0. Gram counts are numpy runs of hashed windows."""
    out = []
    for r, h in zip(references, hypotheses):
        if not r or not h or len(h) < most:
            out.append(0.0)
            continue
        a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (r, h))
        logs = 0.0
        ca, cb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for n in range(1, most + 1):
            # number the grams of length n by (number of the gram of length n - 1, next letter)
            wa, wb = a[n - 1 :].astype(np.int64), b[n - 1 :].astype(np.int64)
            key = np.concatenate([ca[: len(wa)] * (1 << 21) + wa, cb[: len(wb)] * (1 << 21) + wb])
            _, number = np.unique(key, return_inverse=True)
            ca, cb = number[: len(wa)], number[len(wa) :]
            size = int(number.max()) + 1
            common = np.minimum(np.bincount(ca, minlength=size), np.bincount(cb, minlength=size)).sum()
            if common == 0:
                logs = None
                break
            logs += float(np.log(common / len(wb)))
        if logs is None:
            out.append(0.0)
        else:
            short = np.exp(1 - len(r) / len(h)) if len(h) < len(r) else 1.0
            out.append(round(float(short * np.exp(logs / most)), 4))
    return pd.Series(out, dtype="float64")


def bleu(reference: Column, hypothesis: Column) -> Column:
    return F.pandas_udf(lambda a, b: bleu_values(a, b), "double")(reference, hypothesis)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence by bit-parallel rows: one big integer for the longer text."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        match = row & places.get(x, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def rouge_l_values(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
    rows = []
    for r, h in zip(references, hypotheses):
        n = common_subsequence(r, h) if r and h else 0
        p, q = (n / len(h), n / len(r)) if n else (0.0, 0.0)
        rows.append((p, q, 2 * p * q / (p + q) if n else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"], dtype="float64")


def rouge_l(reference: Column, hypothesis: Column) -> Column:
    """struct(precision, recall, f1) over characters, not rounded; zeros for an empty side."""
    return F.pandas_udf(lambda a, b: rouge_l_values(a, b), "precision double, recall double, f1 double")(reference, hypothesis)


def code_of(c: Column) -> Column:
    """The first fenced Python block, else the whole text."""
    fence = r"(?s)```python\n(.*?)```"
    return F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(c)


def _parses(codes: pd.Series) -> pd.Series:
    def one(code: str | None) -> bool:
        try:
            ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return codes.map(one).astype(bool)


def parses(code: Column) -> Column:
    """Whether the worker's Python parses the code."""
    return F.pandas_udf(lambda c: _parses(c), "boolean")(code)


def _similar(texts: pd.Series, others: pd.Series, n: int) -> pd.DataFrame:
    def grams(text: str) -> set[str]:
        return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}

    sizes, shares = [], []
    for text, other in zip(texts, others):
        a, b = (None if x is None else grams(x) for x in (text, other))
        both = 0 if a is None or b is None else len(a & b)
        sizes.append(None if a is None else len(a))
        shares.append(None if a is None or b is None else both / (len(a) + len(b) - both))
    return pd.DataFrame({"n_grams": pd.array(sizes, "Int64"), "jaccard": pd.array(shares, "Float64")})


def gram_similarity(text: Column, other: Column, n: int = K.NGRAM) -> Column:
    """(n_grams, jaccard): how many distinct character n-grams a stripped text has (a shorter one is its own only gram), and the Jaccard similarity
    to those of another stripped text; null where a text is. Sets of slices: a text's time follows its length."""
    return F.pandas_udf(lambda a, b: _similar(a, b, n), "n_grams long, jaccard double")(text, other)


def has_import(code: Column) -> Column:
    return code.rlike(r"(?mdU)^import\s|^from\s")


def has_function(code: Column) -> Column:
    return code.rlike(r"(?mdU)^def\s")


def sentiment_label(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.SENTIMENT.items() for x in pair])
    return F.coalesce(F.try_element_at(table, strip(c)), F.lit("unknown"))
