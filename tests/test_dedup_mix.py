import random
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import dedup as D
from millrace.operators import mix


def grams(text, n=5):
    text = text.strip()
    return {text} if len(text) < n else {text[i : i + n] for i in range(len(text) - n + 1)}


def similar(a, b):
    return len(a & b) / len(a | b)


def greedy(texts):
    kept = []
    for i, t in enumerate(texts):
        g = grams(t)
        if not any(similar(g, k) > 0.8 for _, k in kept):
            kept.append((i, g))
    return {i for i, _ in kept}


def corpus(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("abcdefg ")
            out.append("".join(t))
        else:
            out.append("".join(rng.choices("abcdefghijklmnop  ", k=rng.choice([0, 3, 40, 150, 300]))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_greedy_against_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    pairs = {(r.a, r.b): r.jaccard for r in D.near_pairs(df).collect()}
    g = [grams(t) for t in texts]
    wanted = {(i, j): similar(g[i], g[j]) for j in range(len(texts)) for i in range(j) if similar(g[i], g[j]) > 0.8}
    assert set(pairs) == set(wanted)
    assert all(abs(pairs[k] - wanted[k]) < 1e-9 for k in wanted)
    assert {r.seq for r in D.greedy_near_dedup(df, most=None).collect()} == greedy(texts)
    assert D.greedy_near_dedup(df, most=10).count() == len(texts)


def test_a_chain_keeps_both_ends(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    assert {r.id for r in D.greedy_kept(pairs).collect()} == {1}
    longer = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {r.id for r in D.greedy_kept(longer).collect()} == {1, 3, 5, 7, 9}


def test_exact_dedup_key_is_the_two_texts_together(spark):
    turn = "array<struct<from:string,value:string>>"
    rows = [(0, [("human", "ab"), ("gpt", "c")]), (1, [("gpt", "a"), ("human", "bc")]), (2, [("human", "abc")]), (3, [("human", "abc")])]
    df = spark.createDataFrame(rows, f"seq long, conversations {turn}")
    once = D.first_of_key(df.withColumn("k", D.turns_key(F.col("conversations"))), "k")
    assert {r.seq for r in once.collect()} == {0, 2, 3}  # fewer than two turns: no key, all stay


@pytest.mark.parametrize("n, train", [(0, 0), (1, 0), (19, 18), (20, 19), (21, 19)])
def test_split_sizes(spark, n, train):
    got = mix.split_train_eval(spark.range(n).withColumnRenamed("id", "key"))
    assert got.filter("split = 'train'").count() == train and got.count() == n


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", None]), max_size=30), st.integers(0, 5))
def test_caps(spark, tasks, cap):
    df = spark.createDataFrame(list(enumerate(tasks)), "key long, task string")
    got = mix.sample_tasks(df, caps={"a": cap}, default=4).collect()
    for t, most in (("a", cap), ("b", 4), (None, 4)):
        assert sum(r.task == t for r in got) == min(most, tasks.count(t))
    assert len({r.key for r in got}) == len(got)


def test_balance_without_labels_changes_nothing(spark):
    df = spark.createDataFrame([(i, None) for i in range(5)], "key long, task_type string")
    assert mix.balance_tasks(df).count() == 5
    some = spark.createDataFrame([(i, "financial_qa" if i < 90 else None) for i in range(100)], "key long, task_type string")
    assert mix.balance_tasks(some, total=0).filter("task_type is not null").count() == 20


def test_near_classes_writes_little_for_texts_without_near_ones(spark):
    """Tables written follow the texts: no lists of grams, no pairs of texts that only share a small vocabulary."""
    folder = spark.conf.get("spark.checkpoint.dir")
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(300)]
    texts.append(texts[0][:1500] + "x" + texts[0][1501:])
    size = lambda: sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    df, before = spark.createDataFrame(list(enumerate(texts)), "seq long, text string"), size()
    assert [(r.a, r.b) for r in D.near_classes(df).collect()] == [(0, 300)]
    assert size() - before < 1.5 * sum(map(len, texts))


def test_near_classes_of_a_family_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL", 4)
    base, texts = "".join(random.Random(9).choices("abcdefgh ", k=400)), []
    for i in range(30):
        texts.append(base[: 13 * i] + "xyz" + base[13 * i + 3 :])
    got = {(r.a, r.b) for r in D.near_classes(spark.createDataFrame(list(enumerate(texts)), "seq long, text string")).collect()}
    g = [grams(t) for t in texts]
    assert got == {(i, j) for j in range(30) for i in range(j) if similar(g[i], g[j]) > 0.8} and len(got) > 400


def test_greedy_rounds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "DENSE", 0)
    monkeypatch.setattr(D, "SETTLED", -1)
    for seed in (3, 4):
        texts = corpus(seed)
        kept = D.greedy_near_dedup(spark.createDataFrame(list(enumerate(texts)), "seq long, text string"))
        assert {r.seq for r in kept.collect()} == greedy(texts)


def test_greedy_of_a_large_family_lists_no_square_of_pairs(spark, monkeypatch):
    rng, m = random.Random(11), 500
    base = "".join(rng.choices("abcdefgh ", k=600))
    texts = [base[: (at := rng.randrange(590))] + f"{i:05d}" + base[at + 5 :] for i in range(m)]
    rows, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: (out := cut(df), rows.append(out.count()))[0])
    kept = D.greedy_near_dedup(spark.createDataFrame(list(enumerate(texts)), "seq long, text string"))
    assert {r.seq for r in kept.collect()} == greedy(texts) and max(rows) < 100 * m


def test_conversations_of_a_large_family_list_no_square_of_pairs(spark, monkeypatch):
    rng, m = random.Random(12), 300
    base = "".join(rng.choices("abcdefgh ", k=500)).strip()
    texts = [base[: (at := rng.randrange(1, 490))] + f"{i:05d}" + base[at + 5 :] for i in range(m)]
    turns = "seq long, conversations array<struct<`from`: string, value: string>>"
    df = spark.createDataFrame([(i, [("human", f"question {i}"), ("gpt", t)]) for i, t in enumerate(texts)], turns)
    rows, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: (out := cut(df), rows.append(out.count()))[0])
    assert {r.seq for r in D.dedup_conversations(df).collect()} == greedy(texts) and max(rows) < 100 * m
