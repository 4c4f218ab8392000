import json

from pyspark.sql import functions as F

from millrace.operators import convert as C
from millrace.operators import order as O
from millrace.operators import quality as Q


def msgs(spark, *rows):
    schema = "seq long, messages array<struct<role:string,content:string>>"
    return spark.createDataFrame(list(enumerate(rows)), schema)


SYSTEM, ASK, ANSWER = ("system", " be kind "), ("user", "q?"), ("assistant", "a.")


def test_system_text_leaks_into_later_rows(spark):
    df = msgs(spark, [ASK, ANSWER], [SYSTEM, ASK, ANSWER], [ASK, ANSWER], [("system", "lonely")], [("system", "new"), ASK], [ASK, ANSWER])
    got = {r.seq: r.system for r in C.from_messages(df, system="base").collect()}
    # a row of one message sets nothing; one whose turns are too few in the end does
    assert got == {0: "base", 1: "be kind", 2: "be kind", 5: "new"}
    own = {r.seq: r.system for r in C.from_messages(df, system="base", leak=False).collect()}
    assert own == {0: "base", 1: "be kind", 2: "base", 5: "base"}


def test_messages_drop_blank_turns_and_unknown_roles(spark):
    got = C.from_messages(msgs(spark, [ASK, ("assistant", "  "), ("tool", "x"), ANSWER])).first()
    assert [(t["from"], t["value"]) for t in got.conversations] == [("human", "q?"), ("gpt", "a.")]


def test_alpaca_and_pairs(spark):
    df = spark.createDataFrame([(0, "i", "", "o"), (1, "i", "x", "o"), (2, "", "x", "o"), (3, "i", None, " "), (4, None, "", "o")], "seq int, instruction string, input string, output string")
    alpaca = {r.seq: r.conversations[0]["value"] for r in C.from_alpaca(df).collect()}
    assert alpaca == {0: "i", 1: "i\n\nx", 2: "x"}
    assert {r.seq: r.conversations[0]["value"] for r in C.from_pairs(df, task="t").collect()} == alpaca
    assert {r.task_type for r in C.from_alpaca(df).collect()} == {None}


def test_mixed_keeps_blank_turns_and_has_no_task(spark):
    turn = "struct<from:string,role:string,value:string,content:string>"
    rows = [
        (0, [("human", None, "q", None), (None, "assistant", None, "")], None, "s", None, None),
        (1, [("human", None, "q", None)], None, "s", None, None),
        (2, None, "i", None, "", "o"),
    ]
    df = spark.createDataFrame(rows, f"seq int, conversations array<{turn}>, instruction string, system string, input string, output string")
    got = {r.seq: r for r in C.from_mixed(df, task="set-a").collect()}
    assert set(got) == {0, 2}
    assert [t["value"] for t in got[0].conversations] == ["q", ""] and got[0].task_type is None and got[0].system == "s"
    assert got[2].task_type == "set-a"
    assert C.from_mixed(df, "mine").filter("seq = 0").first().system == "mine"


def test_first_row_decides_the_layout(spark):
    first = {"instruction": "do", "output": "done"}
    later = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}
    lines = spark.createDataFrame([(1, json.dumps(later)), (0, json.dumps(first))], "seq int, line string")
    assert C.layout(lines) == "alpaca"
    assert [r.seq for r in C.convert(lines).collect()] == [0]
    assert C.convert(lines.filter("seq = 1")).first().conversations[1]["value"] == "a"
    odd = spark.createDataFrame([(0, '{"x": 1}')], "seq int, line string")
    assert C.layout(odd) == "unknown" and C.convert(odd).count() == 0


def talk(spark, *turns):
    return spark.createDataFrame([(list(turns),)], "conversations array<struct<from:string,value:string>>")


def why(spark, *turns):
    return Q.with_reason(talk(spark, *turns)).first().reason


def test_reasons_in_order(spark):
    fine = ("gpt", "abcdefghij" * 4)
    assert why(spark, ("human", "hello")) == "fewer than two turns"
    assert why(spark, ("human", "hello"), ("human", "hello")) == "a role is missing"
    assert why(spark, ("human", " hey "), fine) == "question too short"
    assert why(spark, ("human", "hello"), ("gpt", "Sorry")) == "answer too short: 5"
    assert why(spark, ("human", "hello"), ("gpt", "ab" * 4001)) == "answer too long: 8002"
    assert why(spark, ("human", "hello"), ("gpt", "我无法。对不起，我无法回答这个问题，请您换一个问题再来问我吧，谢谢您")) == "refusal: 我无法"
    assert why(spark, ("human", "hello"), ("gpt", "x" * 100 + "Sorry")) == "too few distinct characters"
    assert why(spark, ("human", "hello"), fine) == "OK"
    assert Q.with_reason(spark.createDataFrame([(None,)], "conversations array<struct<from:string,value:string>>")).first().reason == "fewer than two turns"


def test_white_space_at_the_ends_of_an_answer_counts(spark):
    assert why(spark, ("human", "hello"), ("gpt", "a" * 9 + " ")) == "answer too short: 10"
    assert why(spark, ("human", "hello"), ("gpt", " " + "abcdefghij" * 2 + "k" * 7 + "\n\t")) == "OK"
    assert why(spark, ("human", "hello"), ("gpt", " " * 30)) == "too few distinct characters"


def test_order_over_many_partitions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    ranked = O.global_rank(df, "k", name="r").orderBy("k").collect()
    assert [r.r for r in ranked] == list(range(1, 1001))
    marks = spark.range(500).select(F.col("id").alias("seq"), F.when(F.col("id") % 97 == 5, F.col("id")).alias("v"), (F.col("id") % 2).alias("g"))
    got = {r.seq: r.o for r in O.carried_forward(marks, "g", "seq", "v", "o").collect()}
    last = {0: None, 1: None}
    for i in range(500):
        if i % 97 == 5:
            last[i % 2] = i
        assert got[i] == last[i % 2]
