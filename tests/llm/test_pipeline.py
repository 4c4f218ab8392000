"""The pipeline's stages against brute force on the small table, and the guard around the optional parts."""

import hashlib
import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import catalog
from test_ops import components_of, shingles
from tests_llm_brute import components, removed_text  # noqa: F401

REPO = Path(__file__).resolve().parents[2]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, sf, tmp_path):
    docs = catalog.table(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (rows(before), docs)
        if name != "packing":
            assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes)

    before, after = seen["near_dedup"]
    kept = components({i: r.text for i, r in before.items()})
    assert set(rows(after)) == {i for i, c in kept.items() if i == c}

    before, after = seen["suffix_dedup"]
    wanted = removed_text({i: r.text for i, r in before.items()})
    got = rows(after)
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in wanted.items() if t != "" or before[i].text == ""}
    assert all(r.n_chars == len(r.text) for i, r in got.items() if r.text != before[i].text)

    before, after = seen["secrets"]
    got = rows(after)
    assert set(got) == set(before)
    changed = [i for i in got if got[i].text != before[i].text]
    assert all("[SECRET]" in got[i].text for i in changed)

    before, after = seen["packing"]
    packed = after.collect()
    assert {r.doc_id for r in packed} == set(before)


def test_stages_at_80(spark, sf, tmp_path):
    """The stages as in test_stages, near_dedup against brute force at similarity 0.8."""
    docs, seen = catalog.table(spark, sf, "documents"), []
    for name, stage in P.STAGES:
        before = rows(docs)
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append((before, docs.collect()))
    before, after = seen[1]
    sets = {i: shingles(r.text) for i, r in before.items()}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    kept = components_of(sets, [(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])])
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in kept.items() if i == c)
    before, after = seen[2]
    wanted = removed_text({i: r.text for i, r in before.items()})
    assert {r.doc_id: r.text for r in after} == {i: t for i, t in wanted.items() if t != "" or before[i].text == ""}
    before, after = seen[3]
    assert {r.doc_id for r in after} == set(before) and all("[SECRET]" in r.text for r in after if r.text != before[r.doc_id].text)
    before, after = seen[4]
    assert {r.doc_id for r in after} == set(before)


def test_near_dedup_links_at_80(spark, sf):
    rng = random.Random(8)
    texts = []
    for n in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(110)]
        near = list(base)
        for at in [[30, 70], [20, 50, 90]][n % 2]:  # 96 of 116 shingles, 0.828; 91 of 121, 0.752
            near[at] = f"new{at}"
        texts += [" ".join(base), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    gone = {j for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(gone) == 20
    assert set(rows(P.near_dedup(spark, docs, sf))) == set(range(len(texts))) - gone


def test_repeated_rows(spark, sf):
    passage = "this very passage of more than fifty bytes stands in two of the documents"
    texts = [f"first {passage} and then an end", f"something else {passage}", "password: 0123456789abcdef0123 in a text", None, "alone"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts) for _ in range(1 + i % 3)], "doc_id long, text string, other int")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, sf).collect()) == [0, 1, 2, 3, 4]
    for stage in (P.suffix_dedup, P.secrets):
        once = {r.doc_id: r.text for r in stage(spark, docs.dropDuplicates(["doc_id"]), sf).collect()}
        assert sorted((r.doc_id, r.other, r.text) for r in stage(spark, docs, sf).filter("text is not null").collect()) == sorted(
            (i, i, once[i]) for i in once for _ in range(1 + i % 3) if once[i] is not None
        )


def test_rows_without_id_rows_with_one_id_and_clashing_names(spark, sf):
    passage = "this very passage of more than fifty bytes stands in two of the documents"
    rows = [(None, "no id at all, password: 0123456789abcdef0123"), (None, None), (1, f"first {passage} and then an end"), (1, f"second text of the same id {passage}"),
            (2, f"later {passage} tail"), (2, f"later {passage} tail"), (3, None), (4, "")]
    names = ["new_text", "was", "new", "changed", "text_hash", "toxicity", "score", "id", "kept", "class", "component"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names}).withColumn("n_chars", F.length("text"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.filter("false"), sf).count() == 0
        texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if name in ("toxicity", "secrets"):
            assert len(texts) == len(rows)
        if name == "near_dedup":
            assert texts == sorted(set(rows), key=str)
        if name == "suffix_dedup":
            assert len([1 for i, _ in texts if i == 2]) == 2
            assert {t for i, t in texts if i == 1} == {t for i, t in rows if i == 1} and (None, rows[0][1]) in texts
            assert all(passage not in t for i, t in texts if i == 2)
        if name == "secrets":
            assert (None, "no id at all, [SECRET]") in texts and all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert P.packing(spark, docs, sf).select(F.sum("length")).first()[0] > 0


def test_run_gives_the_same_rows(spark, sf, tmp_path):
    got = P.run(spark, sf)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_entry_without_the_optional_parts(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('millrace.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q) and len(q) > 60\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    ) % str(REPO)
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_all_ten_and_the_pipeline_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names) and hashlib
