"""Quality rules whose cut-offs carry a guarantee on how many good documents they reject together.

Each rule is a number of a document and a direction. A path makes some of the rules stricter together, in ``STEPS`` steps that are fixed
beforehand. For every stratum and path, steps are tried from the most lenient on; a step is certified when the exact binomial test
on the labelled good documents of the stratum rejects "its rules together reject more than alpha of them" at level delta / (strata * paths).
The strata that count are all those with so many labelled good documents that a step can be certified at that level; their number has
no limit. The sequence of one path stops at the first step that fails (fixed-sequence testing), so Bonferroni over paths and strata
bounds by delta the chance that in any stratum a certified step breaks its promise. A stratum uses one certified step of one path: the
one that rejects most labelled bad documents, weighed against good ones; with none that gains, it has no learned cut-offs.

Defined results: null and empty texts have zero counts and fail the base rule; repeated rows get equal results; a stratum without
enough labelled good documents has no learned cut-offs and keeps all that pass the base rules; a null stratum is one
of its own; labels of unknown ids are ignored; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.samples import one_label
from millrace.llm.shared import Scratch
from millrace.llm.textbatch import SPACE, U, mix, slices, span_hashes, tidy, window_hashes, word_bounds

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_doubled_words")
#: Rules: the number, whether high values are bad, and the cut-offs from lenient to strict.
RULES: dict[str, tuple[bool, list[float]]] = {
    "mean_word_high": (True, [20 - 0.25 * i for i in range(57)]),
    "mean_word_low": (False, [1 + 0.1 * i for i in range(41)]),
    "symbols_per_word": (True, [3 * 0.9**i for i in range(60)]),
    "dup_line_share": (True, [1 - 0.02 * i for i in range(49)]),
    "doubled_share": (True, [0.5 - 0.01 * i for i in range(49)]),
    "repeat_share": (True, [0.5 - 0.01 * i for i in range(49)]),
}
#: Paths: the rules that get stricter together. A stratum uses one.
PATHS: list[tuple[str, ...]] = [
    tuple(RULES),
    ("mean_word_high", "mean_word_low", "symbols_per_word"),
    ("symbols_per_word", "dup_line_share", "doubled_share", "repeat_share"),
    ("mean_word_high", "symbols_per_word", "repeat_share"),
    ("mean_word_high", "mean_word_low"),
    ("dup_line_share", "doubled_share", "repeat_share"),
]
STEPS = 60


def text_counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text, as columns."""
    starts, ends, first = word_bounds(data, off)
    docs = len(off) - 1
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    chars = per(~SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per(SYMBOL[data])

    def again(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a hash stands twice or more in its text; and where it isn't the first one there."""
        key = mix(hashes + doc.astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        later[order[1:][same]] = True
        return many, later

    # lines: cut at \n and at the ends of texts; only those with a word
    cut = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([off, cut + 1])) if len(data) else np.zeros(1, np.int64)
    begin, stop = edges[:-1], edges[1:].copy()
    stop[data[stop - 1] == 10] -= 1 if len(stop) else 0
    wordy = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    begin, stop = begin[wordy], stop[wordy]
    line_doc = np.searchsorted(off, begin, "right") - 1
    _, later = again(span_hashes(data, begin, stop), line_doc) if len(begin) else (None, np.zeros(0, bool))
    lines = np.bincount(line_doc, minlength=docs)
    dup = np.bincount(line_doc[later], minlength=docs)

    words = len(starts)
    marked = np.zeros(words, bool)
    word_doc = np.repeat(np.arange(docs), np.diff(first))
    hashes = span_hashes(data, starts, ends)
    doubled = np.zeros(words, bool)
    if words >= 2:
        doubled[1:] = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    if words >= 3:
        runs = window_hashes(hashes, 3)
        inside = word_doc[2:] == word_doc[:-2]
        at = np.flatnonzero(inside)
        many, _ = again(runs[at], word_doc[at])
        at = at[many]
        for j in range(3):
            marked[at + j] = True
    repeat = np.bincount(word_doc[marked], minlength=docs)
    return [np.diff(first), chars, symbols, dup, repeat, lines, np.bincount(word_doc[doubled], minlength=docs)]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, COUNTS..., the columns named in ``also`` as strings) of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, data, off in slices(batch.column(1)):
                found = [pa.array(x.astype(np.int64)) for x in text_counts(data, off)]
                kept = [batch.column(2 + i).slice(a, b - a) for i in range(len(also))]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *found, *kept], ["id", *COUNTS, *[f"also{i}" for i in range(len(also))]])

    own = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *[F.col(c).cast("string") for c in also])
    return own.mapInArrow(run, ", ".join(["id long", *(f"{c} long" for c in COUNTS), *(f"also{i} string" for i in range(len(also)))]))


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "mean_word_high": mean, "mean_word_low": mean, "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words, "doubled_share": F.col("n_doubled_words") / words,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of X ~ Bin(n, p), exactly (sums of terms in logarithms)."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certified(good: np.ndarray, bad: np.ndarray, n_good: int, alpha: float, level: float, weight: float) -> int | None:
    """The step to use, given how many good and bad documents each one rejects (from lenient to strict)."""
    best, gain = None, 0.0
    for i, (g, b) in enumerate(zip(good.tolist(), bad.tolist())):
        if binomial_tail(int(g), n_good, alpha) > level:
            break
        if b - weight * g > gain:
            best, gain = i, b - weight * g
    return best


def tested(sizes: Iterable[tuple[int, int]], alpha: float, delta: float) -> tuple[int, float]:
    """The least number of good documents that a stratum is tested with, and the level of each test.

    ``sizes``: (good documents, strata with so many). The most strata of which each one, the smallest too, can certify a step
    that rejects none of its good documents at the level that their number leaves. Only sizes decide, not what rules find.
    """
    least, level, strata = 0, 0.0, 0
    for good, n in sorted(sizes, reverse=True):
        strata += n
        at = delta / (strata * len(PATHS))
        if good and binomial_tail(0, good, alpha) <= at:
            least, level = good, at
    return least, level


def cutoff_at(rule: str, step: int) -> int:
    """The place of the rule's cut-off at a step: the last step has the last one."""
    return step * (len(RULES[rule][1]) - 1) // (STEPS - 1)


def learn(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, alpha: float, delta: float, weight: float) -> DataFrame | None:
    """(stratum, a cut-off or null for each rule) of the strata with learned cut-offs. Only how many strata have how many good documents reaches the driver."""
    known = measured.filter("not base_failed").join(one_label(labels, id_col, label_col), "id")
    sizes = known.groupBy("stratum").agg(F.count_if(F.col("label") > 0).alias("good")).groupBy("good").agg(F.count(F.lit(1)).alias("n"))
    least, level = tested([(r["good"], r["n"]) for r in sizes.collect()], alpha, delta)
    if not least:
        return None
    measures = _measures()
    # the step from which a rule rejects the document, STEPS if none does: its cut-off at a step is a prefix of the strict end
    first = {}
    for rule, (high, cutoffs) in RULES.items():
        m = measures[rule]
        levels = F.array(*[F.lit(float(cutoffs[cutoff_at(rule, s)])) for s in range(STEPS)])
        first[rule] = F.size(F.filter(levels, (lambda m: lambda c: m <= c)(m) if high else (lambda m: lambda c: m >= c)(m)))
    steps = [F.struct(F.lit(i).alias("path"), F.least(*[first[r] for r in rules]).alias("step")) for i, rules in enumerate(PATHS)]
    table = (
        known.select("stratum", (F.col("label") > 0).alias("good"), F.explode(F.array(*steps)).alias("p"))
        .groupBy("stratum", "good", "p.path", "p.step").agg(F.count(F.lit(1)).alias("n"))
    )
    names = ["stratum", *RULES]

    def cutoffs_of(group: pa.Table) -> pa.Table:
        own: dict[str, float] = {}
        rows, most = group.to_pylist(), 0.0
        for i, rules in enumerate(PATHS):
            by, n_good = {True: np.zeros(STEPS), False: np.zeros(STEPS)}, 0
            for r in rows:
                if r["path"] == i:
                    n_good += r["n"] if r["good"] else 0
                    by[r["good"]][r["step"] :] += r["n"]
            step = certified(by[True], by[False], n_good, alpha, level, weight) if n_good >= least else None
            gain = 0.0 if step is None else by[False][step] - weight * by[True][step]
            if step is not None and gain > most:
                most, own = gain, {r: float(RULES[r][1][cutoff_at(r, step)]) for r in rules}
        kinds = [pa.string(), *[pa.float64()] * len(RULES)]
        return pa.table([pa.array([v], k) for v, k in zip([rows[0]["stratum"], *map(own.get, RULES)], kinds)], names)

    found = table.groupBy("stratum").applyInArrow(cutoffs_of, ", ".join(["stratum string", *(f"{r} double" for r in RULES)]))
    return found.filter(F.coalesce(*RULES).isNotNull())


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", stratum_col: str = "lang",
    alpha: float = 0.02, delta: float = 0.05, weight: float = 5.0, min_words: int = 50, most_repeat: float = 0.5,
) -> DataFrame:
    """id_col, the counts, base_failed, rules (names of the learned rules that reject) and kept, of every document.

    alpha: the false rejection rate that the learned rules together may have in each stratum; delta: the chance that any stratum breaks it.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    measured = scratch.cut(
        counts(docs, id_col, text_col, (stratum_col,)).withColumn("stratum", F.coalesce(F.concat(F.lit("="), "also0"), F.lit(""))).withColumn("base_failed", base)
    )
    cutoffs = learn(measured, labels, id_col, label_col, alpha, delta, weight)
    measures = _measures()
    if cutoffs is None:
        found = F.array().cast("array<string>")
    else:
        # a stratum in it has hundreds of labels, so it is small; by a shuffle, a stratum's documents would meet in one task
        measured = measured.join(F.broadcast(scratch.cut(cutoffs)), "stratum", "left")
        found = F.array_compact(F.array(*[F.when(measures[r] > F.col(r) if high else measures[r] < F.col(r), F.lit(r)) for r, (high, _) in RULES.items()]))
    return measured.withColumn("rules", found).select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", "rules", (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept")
    )
