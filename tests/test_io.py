import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import sft
from millrace.sources import readers as R
from millrace.sources import writers as W
from millrace.streaming import news as SN


def test_json_layouts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "sub/b.json").write_text('\n{"x": 3}\n{"x": 4}\n')
    (tmp_path / "c.json").write_text('{"x": 5}')
    (tmp_path / "meta.json").write_text('{"x": 9}')
    (tmp_path / "bad.json").write_text("nothing")
    got = sorted((r.file.rsplit("/", 1)[-1], r.seq, json.loads(r.line)["x"]) for r in R.json_rows(spark, str(tmp_path)).collect())
    assert got == [("a.json", 0, 1), ("a.json", 1, 2), ("b.json", 0, 3), ("b.json", 1, 4), ("c.json", 0, 5)]


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿a,b\n中,1\n".encode())
    (tmp_path / "g.csv").write_bytes("a,b\n文,NA\n".encode("gbk"))
    got = {r.file.rsplit("/", 1)[-1]: r.text for r in R.csv_files(spark, str(tmp_path)).collect()}
    assert got == {"u.csv": "a,b\n中,1\n", "g.csv": "a,b\n文,NA\n"}
    table = R.csv_table(spark, str(tmp_path / "u.csv"))
    assert table.columns == ["a", "b"] and table.first().a == "中"


def test_questions(spark, tmp_path):
    (tmp_path / "s.json").write_text('["a", "b"]')
    (tmp_path / "o.json").write_text('[{"question": "a", "task_type": "t"}]')
    (tmp_path / "q.csv").write_text("question,category\na,x\n")
    (tmp_path / "bad.csv").write_text("other\na\n")
    assert [r.question for r in R.questions(spark, str(tmp_path / "s.json")).orderBy("seq").collect()] == ["a", "b"]
    assert R.questions(spark, str(tmp_path / "o.json")).first().task_type == "t"
    assert R.questions(spark, str(tmp_path / "q.csv")).first().category == "x"
    for name in ("bad.csv", "x.txt"):
        with pytest.raises(ValueError):
            R.questions(spark, str(tmp_path / name))


def test_multiple_choice_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"question": "q", "answer": "A"}, {"answer": "B"}, {"input": "i", "answer": "C"}]')
    (tmp_path / "m.json").write_text('{"x": [{"answer": "D"}], "y": [{"question": "z", "answer": "A"}]}')
    (tmp_path / "_n.json").write_text('[{"question": "no"}]')
    got = sorted((r.question or r.input or "", r.answer) for r in R.mcq_items(spark, str(tmp_path)).collect())
    assert got == [("", "D"), ("i", "C"), ("q", "A"), ("z", "A")]


def test_prompt_dictionary(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"_note": "x", "t": {"task_name": "n", "system_prompt": "s", "keywords": ["k"]}, "u": {"task_name": "m"}}))
    got = R.prompts(spark, str(tmp_path / "p.json")).collect()
    assert [(r.task, r.system_prompt, r.keywords) for r in got] == [("t", "s", ["k"])]


def test_bars_and_sources(spark):
    df = spark.createDataFrame([("2024-01-02,1,2,3,0.5,-,NaN,1,1,1,1",)], "line string")
    got = R.bars_from_lines(df).first()
    assert (got.date, got.open, got.volume, got.amount) == ("2024-01-02", 1.0, None, None)
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    two = spark.createDataFrame([(1, "b", 0), (2, "c", 0)], "k int, v string, w int")
    assert sorted((r.k, r.v) for r in R.prefer(one, two, ["k"]).collect()) == [(1, "a"), (2, "c")]
    codes = R.constituents(spark.createDataFrame([(600, "n")], "`成分券代码` int, `成分券名称` string"), {"成分券代码": "code", "品种代码": "code", "成分券名称": "name"})
    assert codes.first().code == "000600"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("问", None, 1), ("b,c", "x", 2)], "question string, answer string, n int")
    path = W.results(df, str(tmp_path / "deep/er/r.json"))
    assert json.loads(open(path, encoding="utf-8").read())[0] == {"question": "问", "n": 1}
    path = W.results(df, str(tmp_path / "r.csv"))
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and b'"b,c",x,2' in raw
    assert W.results(df, str(tmp_path / "r.txt")).endswith("r.json")
    W.with_meta(df, str(tmp_path / "d"), 5)
    assert json.loads((tmp_path / "d/meta.json").read_text())["count"] == 2
    W.per_task(df.withColumn("task", F.lit("t")), str(tmp_path / "t"))
    assert (tmp_path / "t/task=t").is_dir()


def test_append_and_manifest(spark, tmp_path):
    rows = lambda *k: spark.createDataFrame([(i, x) for i, x in enumerate(k)], "seq int, news_id string")
    for part in (("a", "b", "a"), ("b", "c")):
        W.append_new(rows(*part), str(tmp_path / "n"), "news_id", "seq")
    assert sorted(r.news_id for r in spark.read.parquet(str(tmp_path / "n")).collect()) == ["a", "b", "c"]
    manifest = spark.createDataFrame([("x", 50), ("y", 500)], "code string, size long")
    wanted = spark.createDataFrame([("x",), ("y",), ("z",)], "code string")
    assert sorted(r.code for r in W.missing_from(manifest, wanted, "code").collect()) == ["x", "z"]


def test_stream_gives_each_key_once_across_restarts(spark, tmp_path):
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "news_id string")
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (("a", "b", "a"), ("b", "c")):
        rows(*part).coalesce(1).write.mode("append").parquet(src)
        SN.ingest(SN.arrivals(spark, src, "news_id string"), out, mark).awaitTermination()
    assert sorted(r.news_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_whole_pipeline(spark):
    def row(i):
        return json.dumps({"instruction": f"question number {i}?", "input": "", "output": f"answer {i}: " + "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(60))})

    lines = spark.createDataFrame([(i, row(i % 40)) for i in range(45)], "seq long, line string")
    got = sft.instruction_corpus({"set-b": lines, "other": lines.limit(5)}, task_of={"set-b": "financial_qa"})
    counts = {(r.task, r.split): r["count"] for r in got.groupBy("task", "split").count().collect()}
    assert sum(n for (t, _), n in counts.items() if t == "financial_qa") == 40
    assert sum(n for (_, s), n in counts.items() if s == "eval") == 3
