"""Named queries over the driver's tables, and the SQL that gives the same rows.

The tables stand in for the raw inputs: conversations for chat data, documents and pages for news and prose, orders (by
priority and day) for market bars, labels for truths of classifications. Queries without SQL are those that SQL can't express or takes too
long for on whole tables; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sql as S
from millrace.functions import constants as K
from millrace.functions import metrics as M
from millrace.functions import text as X
from millrace.operators import bars as B
from millrace.operators import convert as C
from millrace.operators import dedup as D
from millrace.operators import evaluate as E
from millrace.operators import mix
from millrace.operators import news as N
from millrace.operators import prompts as P
from millrace.operators import quality as Q
from millrace.sources import readers as R
from millrace.sources.scratch import cut, discard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins


def messages(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(turns.alias("messages"))


def chats(spark: SparkSession, d: str, leak: bool = True) -> DataFrame:
    return C.from_messages(messages(spark, d), leak=leak)


def daily(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_of(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def instructions(spark: SparkSession, d: str) -> DataFrame:
    """Instruction rows: a user's turn, the turn before it as input (empty at first), the assistant's reply as output."""
    c = table(spark, d, "conversations")
    at = lambda k: c.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"t{k}"))
    rows = c.filter("role = 'user'").join(at(1), ["conv_id", "turn"], "left").join(at(-1), ["conv_id", "turn"], "left")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("instruction"), F.coalesce("t1", F.lit("")).alias("input"), F.coalesce("t-1", F.lit("")).alias("output"))


INSTRUCTIONS = """inst AS (SELECT u.conv_id * 1000 + u.turn AS seq, u.text AS instruction, coalesce(p.text, '') AS input, coalesce(n.text, '') AS output FROM conversations u
  LEFT JOIN conversations p ON p.conv_id = u.conv_id AND p.turn = u.turn - 1 LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1 WHERE u.role = 'user')"""


def task_of(key: Column) -> Column:
    """A task for a row, from a digit of its key; the last one has none."""
    names = [*K.TASK_RATIO, None]
    return F.get(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int"))


TASK_OF = "[" + ", ".join(f"'{n}'" for n in K.TASK_RATIO) + ", NULL][1 + {key} % " + str(len(K.TASK_RATIO) + 1) + "]"


def news(spark: SparkSession, d: str) -> DataFrame:
    """News of documents: the first line is the title, all of it the content."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("seq"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), F.col("lang").alias("date"), "source")


NEWS = "news AS (SELECT doc_id AS seq, string_split(text, chr(10))[1] AS title, text AS content, lang AS date, source FROM documents)"

# ---------------------------------------------------------------- cleaning

_x, _clean = S.cleaned("text", K.MIN_TEXT, K.MAX_TEXT)
CLEAN = f"a AS (SELECT doc_id, text, {_x} AS x FROM documents), b AS (SELECT doc_id, {_clean} AS cleaned FROM a)"
_MASKS = {"n_phones": K.PHONE_MASK, "n_ids": K.ID_MASK, "n_emails": K.EMAIL_MASK, "n_cards": K.CARD_MASK}


@query(f"WITH {CLEAN} SELECT doc_id, cleaned, " + ", ".join(f"coalesce((length(cleaned) - length(replace(cleaned, '{m}', ''))) // {len(m)}, 0)::BIGINT AS {c}" for c, m in _MASKS.items()) + " FROM b")
def clean_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))
    size = lambda m: F.coalesce(((F.length("cleaned") - F.length(F.replace("cleaned", F.lit(m), F.lit("")))) / len(m)).cast("long"), F.lit(0))
    return rows.select("doc_id", "cleaned", *[size(m).alias(c) for c, m in _MASKS.items()])


@query(f"SELECT page_id, {S.tags('html')} AS stripped FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("stripped"))


@query(f"SELECT page_id, {S.squeeze('html')} AS squeezed FROM pages")
def squeeze_space(spark, d):
    return table(spark, d, "pages").select("page_id", X.squeeze(F.col("html")).alias("squeezed"))


@query(f"SELECT page_id, {S.urls('html')} AS html, {S.urls('url')} AS url FROM pages")
def remove_urls(spark, d):
    return table(spark, d, "pages").select("page_id", X.remove_urls(F.col("html")).alias("html"), X.remove_urls(F.col("url")).alias("url"))


@query(f"SELECT doc_id, {S.ads('text')}::BIGINT AS hits, {S.ads('text')} >= 3 AS is_ad FROM documents")
def ad_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", X.ad_hits(F.col("text")).cast("long").alias("hits"), X.is_ad(F.col("text")).alias("is_ad"))


@query("SELECT doc_id, length(text) >= 20 AS long_enough, CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || '...' ELSE text END AS truncated FROM documents")
def length_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.length("text") >= K.MIN_TEXT).alias("long_enough"), X.truncate(F.col("text")).alias("truncated"))


@query(f"SELECT doc_id, {S.masks('text')} AS masked FROM documents")
def mask_personal(spark, d):
    return table(spark, d, "documents").select("doc_id", X.mask_personal(F.col("text")).alias("masked"))


@query(f"SELECT page_id, {S.flat('html')} AS flat FROM pages")
def flat_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.flat_text(F.col("html")).alias("flat"))


_tx, _title = S.cleaned("title", *K.NEWS_TITLE)
_cx, _content = S.cleaned("content", K.MIN_TEXT, K.MAX_TEXT)


@query(f"WITH {NEWS}, t AS (SELECT *, {_tx} AS x FROM news), u AS (SELECT seq, content, {_title} AS title FROM t), v AS (SELECT *, {_cx} AS x FROM u) SELECT seq, title, coalesce({_content}, '') AS content FROM v WHERE title IS NOT NULL")
def clean_news(spark, d):
    return N.clean_news(news(spark, d)).select("seq", "title", "content")


@query(f"WITH {NEWS}, t AS (SELECT *, {_tx} AS x FROM news), u AS (SELECT {_title} AS title FROM t) SELECT count(*)::BIGINT AS total, count(title)::BIGINT AS valid, (count(*) - count(title))::BIGINT AS filtered FROM u")
def clean_news_counts(spark, d):
    rows = news(spark, d)
    return N.news_counts(rows, N.clean_news(rows))


@query(f"WITH {NEWS} SELECT seq, md5({S.strip('title')} || '_' || {S.strip('date')}) AS news_id, md5({S.strip('content')}) AS content_hash, md5(date || '_' || title) AS cache_key FROM news")
def identity_hashes(spark, d):
    return news(spark, d).select("seq", X.news_id(F.col("title"), F.col("date")).alias("news_id"), X.content_hash(F.col("content")).alias("content_hash"), X.cache_key(F.col("date"), F.col("title")).alias("cache_key"))


@query("SELECT doc_id, len(list_distinct(string_split(text, '')))::BIGINT AS n_distinct FROM documents")
def distinct_characters(spark, d):
    return table(spark, d, "documents").select("doc_id", X.distinct_characters(F.col("text")).cast("long").alias("n_distinct"))


@query(f"""WITH t AS (SELECT *, {S.strip('text')} AS s FROM conversations), g AS (SELECT conv_id, turn, {S.grams('s', 5)} AS g FROM t)
SELECT a.conv_id, a.turn, len(a.g)::BIGINT AS n_grams, round(len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS jaccard_next
FROM g a LEFT JOIN g b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def turn_similarity(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", X.strip(F.col("text")).alias("text"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    both = rows.join(after, ["conv_id", "turn"], "left").select("conv_id", "turn", M.gram_similarity(F.col("text"), F.col("next")).alias("s"))
    return both.select("conv_id", "turn", "s.n_grams", F.round("s.jaccard", 6).alias("jaccard_next"))


@query("WITH c AS (SELECT c_custkey, CAST(c_custkey * 7 AS VARCHAR) AS code FROM customer), z AS (SELECT c_custkey, CASE WHEN length(code) < 6 THEN lpad(code, 6, '0') ELSE code END AS code FROM c) SELECT c_custkey, code, CASE WHEN code LIKE '6%' OR code LIKE '9%' THEN '1.' ELSE '0.' END || code AS quote_id, CASE WHEN code LIKE '6%' THEN 'sh' ELSE 'sz' END || code AS exchange_code FROM z")
def symbol_codes(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", X.zero_padded((F.col("c_custkey") * 7).cast("string")).alias("code"))
    return rows.select("c_custkey", "code", X.quote_id(F.col("code")).alias("quote_id"), X.exchange_code(F.col("code")).alias("exchange_code"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price, nullif(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END, 'N/A') AS priority FROM orders WHERE o_orderkey IS NOT NULL")
def drop_empty_rows_columns(spark, d):
    open_ = F.col("o_orderstatus") != "O"
    rows = table(spark, d, "orders").select("o_orderkey", F.when(open_, F.col("o_totalprice")).alias("price"), F.when(open_, F.col("o_orderpriority")).alias("priority"), F.lit(None).cast("string").alias("nothing"))
    return R.drop_empty(rows)


# ---------------------------------------------------------------- conversion


def flat_turns(df: DataFrame) -> DataFrame:
    return df.select("seq", "system", "task_type", F.posexplode("conversations").alias("idx", "t")).select("seq", "system", "task_type", F.col("idx").cast("long").alias("idx"), F.col("t.from").alias("role"), F.col("t.value").alias("value"))


_FLAT = "SELECT seq, system, CAST(NULL AS VARCHAR) AS task_type, (i - 1)::BIGINT AS idx, turns[i].role AS role, turns[i].value AS value FROM (SELECT *, unnest(range(1, len(turns) + 1)) AS i FROM canon)"


@query(f"WITH {S.canonical(True)} {_FLAT}")
def messages_to_conversations(spark, d):
    return flat_turns(chats(spark, d))


@query(f"WITH {S.canonical(False)} {_FLAT}")
def messages_own_system(spark, d):
    return flat_turns(chats(spark, d, leak=False))


def _pairs(user: str, task: str) -> str:
    both = f"SELECT seq, {S.strip(user)} AS u, {S.strip('output')} AS a FROM inst"
    return f"WITH {INSTRUCTIONS}, p AS ({both}) SELECT seq, '' AS system, '{task}' AS task_type, i::BIGINT AS idx, CASE i WHEN 0 THEN 'human' ELSE 'gpt' END AS role, CASE i WHEN 0 THEN u ELSE a END AS value FROM p, (VALUES (0), (1)) v(i) WHERE u <> '' AND a <> ''"


@query(_pairs("CASE WHEN input <> '' THEN instruction || chr(10) || chr(10) || input ELSE instruction END", "general"))
def alpaca_to_conversations(spark, d):
    return flat_turns(C.from_alpaca(instructions(spark, d), task="general"))


@query(_pairs("CASE WHEN instruction <> '' AND input <> '' THEN instruction || chr(10) || chr(10) || input WHEN input <> '' THEN input ELSE instruction END", "financial_qa"))
def pairs_to_conversations(spark, d):
    return flat_turns(C.from_pairs(instructions(spark, d), task="financial_qa"))


@query(f"""WITH msgs AS ({S.MESSAGES}), mapped AS (SELECT seq, list_filter(list_transform(m, lambda t: {{'role': CASE WHEN t.role IN ('human', 'user') THEN 'human' WHEN t.role IN ('gpt', 'assistant') THEN 'gpt' END, 'value': coalesce(t.text, '')}}), lambda t: t.role IS NOT NULL) AS turns FROM msgs WHERE len(m) >= 2),
canon AS (SELECT seq, turns, '' AS system FROM mapped WHERE len(turns) >= 2) {_FLAT}""")
def mixed_to_conversations(spark, d):
    return flat_turns(C.from_mixed(messages(spark, d).withColumnRenamed("messages", "conversations")))


@query("SELECT source, count(*)::BIGINT AS n_rows, CASE source WHEN 'src0' THEN 'sentiment_analysis' WHEN 'src1' THEN 'financial_qa' ELSE 'general' END AS task, CASE source WHEN 'src0' THEN 'p-sentiment' ELSE 'p-general' END AS system_prompt FROM documents GROUP BY source")
def prompts_by_dataset(spark, d):
    names = F.when(F.col("source") == "src0", "set-a").when(F.col("source") == "src1", "set-b").otherwise(F.col("source"))
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("dataset", names)
    prompts = spark.createDataFrame([("sentiment_analysis", "p-sentiment"), ("general", "p-general")], "task string, system_prompt string")
    return C.with_prompts(rows, prompts, {"set-a": "sentiment_analysis", "set-b": "financial_qa"}).select("source", "n_rows", "task", "system_prompt")


@query("SELECT conv_id, CASE min_by(role, turn) WHEN 'system' THEN 'messages' ELSE 'alpaca' END AS layout FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) GROUP BY conv_id")
def first_row_layout(spark, d):
    """The layout of a dataset whose rows differ in theirs: the first row decides."""
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(F.min_by("role", "turn").alias("r"))
    lines = rows.select("seq", F.when(F.col("r") == "system", F.lit('{"messages": []}')).otherwise(F.lit('{"instruction": null}')).alias("line"))
    return lines.agg(F.min("seq").alias("conv_id")).withColumn("layout", F.lit(C.layout(lines)))


# ---------------------------------------------------------------- quality and dedup

_FIRSTS = """firsts AS (SELECT seq, turns, len(turns) AS n, list_filter(turns, lambda t: t.role = 'human')[1].value AS u, list_filter(turns, lambda t: t.role = 'gpt')[1].value AS a FROM {canon}),
reasons AS (SELECT seq, turns, """ + S.reason().replace("{", "{{").replace("}", "}}") + " AS reason FROM firsts)"
REASONS = f"{S.canonical(True)}, {_FIRSTS.format(canon='canon')}"


def spoiled(df: DataFrame) -> DataFrame:
    """Conversations of which seven in eight are changed, by their seq, so that they break one rule each; answers come in many lengths."""
    kind, value = F.col("seq") % 8, lambda t: t["value"]
    turns = F.col("conversations")
    named = lambda role, new: F.transform(turns, lambda t: F.struct(t["from"].alias("from"), F.when(t["from"] == role, new(value(t))).otherwise(value(t)).alias("value")))
    return df.withColumn("conversations", F.when(kind == 1, F.slice(turns, 1, 1))
        .when(kind == 2, F.transform(turns, lambda t: F.struct(F.lit("human").alias("from"), value(t).alias("value"))))
        .when(kind == 3, named("human", lambda v: F.substring(v, 1, 3))).when(kind == 4, named("gpt", lambda v: F.substring(v, 1, 10)))
        .when(kind == 5, named("gpt", lambda v: F.repeat(v, F.lit(400)))).when(kind == 6, named("gpt", lambda v: F.concat(F.lit("很抱歉，"), v)))
        .when(kind == 7, named("gpt", lambda v: F.repeat(F.lit("ab"), F.lit(50)))).otherwise(turns))


def _named(role: str, new: str) -> str:
    return f"list_transform(turns, lambda t: {{'role': t.role, 'value': CASE WHEN t.role = '{role}' THEN {new} ELSE t.value END}})"


SPOILED = f"""{S.canonical(True)}, worse AS (SELECT seq, CASE seq % 8 WHEN 1 THEN turns[1:1] WHEN 2 THEN list_transform(turns, lambda t: {{'role': 'human', 'value': t.value}})
  WHEN 3 THEN {_named("human", "substr(t.value, 1, 3)")} WHEN 4 THEN {_named("gpt", "substr(t.value, 1, 10)")} WHEN 5 THEN {_named("gpt", "repeat(t.value, 400)")}
  WHEN 6 THEN {_named("gpt", "'很抱歉，' || t.value")} WHEN 7 THEN {_named("gpt", "repeat('ab', 50)")} ELSE turns END AS turns FROM canon), {_FIRSTS.format(canon='worse')}"""


@query(f"WITH {SPOILED} SELECT seq, reason FROM reasons")
def quality_reasons(spark, d):
    return Q.with_reason(spoiled(chats(spark, d))).select("seq", "reason")


@query(f"WITH {SPOILED} SELECT reason, count(*)::BIGINT AS n FROM reasons WHERE reason <> 'OK' GROUP BY reason")
def reason_counts(spark, d):
    return Q.reason_counts(Q.with_reason(spoiled(chats(spark, d))))


@query(f"WITH {SPOILED} SELECT count(*)::BIGINT AS n_in, count(*) FILTER (reason = 'OK')::BIGINT AS n_out, round(1 - count(*) FILTER (reason = 'OK')::DOUBLE / greatest(count(*), 1), 6) AS filter_rate FROM reasons")
def filter_rate(spark, d):
    return Q.pass_rate(Q.with_reason(spoiled(chats(spark, d))))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5({S.strip('text')})")
def exact_dedup_documents(spark, d):
    return D.first_of_key(table(spark, d, "documents").withColumn("key", X.content_hash(F.col("text"))), "key", "doc_id").select("doc_id")


@query(f"WITH {S.canonical(True)} SELECT min(seq) AS seq FROM canon GROUP BY md5({S.strip('turns[1].value || turns[2].value')})")
def exact_dedup_conversations(spark, d):
    return D.first_of_key(chats(spark, d).withColumn("key", D.turns_key(F.col("conversations"))), "key").select("seq")


_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"


@query(f"WITH {_DOCS}, {S.near('docs')} SELECT a, b, round(jaccard, 6) AS jaccard FROM near UNION ALL SELECT c.id, d.id, 1.0 FROM classes c JOIN docs d ON coalesce({S.strip('d.text')}, '') = c.text WHERE d.id > c.id")
def near_duplicate_pairs(spark, d):
    """Pairs of the first rows of different texts, and of each copy with the first row of its text."""
    docs = table(spark, d, "documents")
    copies = D.copies(docs, "text", "doc_id").withColumn("jaccard", F.lit(1.0))
    return D.near_classes(docs, "text", "doc_id").select("a", "b", F.round("jaccard", 6).alias("jaccard")).unionByName(copies)


@query(f"WITH RECURSIVE {_DOCS}, {S.near('docs')}, {S.greedy()} SELECT id AS doc_id FROM classes WHERE NOT list_contains((SELECT ids FROM dropped), id)")
def greedy_near_dedup(spark, d):
    return D.greedy_near_dedup(table(spark, d, "documents"), "text", "doc_id").select("doc_id")


_ONCE = f"passed AS (SELECT seq, turns, {S.strip('turns[1].value || turns[2].value')} AS first_two FROM reasons WHERE reason = 'OK'), once AS (SELECT min(seq) AS seq, first(turns ORDER BY seq) AS turns FROM passed GROUP BY first_two)"
_ANSWERS = "said AS (SELECT seq AS id, turns, list_aggregate(list_transform(list_filter(turns, lambda t: t.role = 'gpt'), lambda t: t.value), 'string_agg', ' ') AS text FROM once)"


@query(f"WITH RECURSIVE {REASONS}, {_ONCE}, {_ANSWERS}, {S.near('said')}, {S.greedy()} SELECT id AS seq, len(turns)::BIGINT AS n_turns FROM classes JOIN said USING (id) WHERE NOT list_contains((SELECT ids FROM dropped), id)")
def filtered_conversations(spark, d):
    """Rules, exact and near-duplicates of conversations in one plan. No rule reads system texts, so none is carried on to later rows."""
    rows = cut(chats(spark, d, leak=False).select("seq", "conversations", F.size("conversations").cast("long").alias("n_turns")))
    kept = D.dedup_conversations(Q.with_reason(rows).filter("reason = 'OK'").drop("reason")).select("seq", "n_turns")
    discard(rows)
    return kept


# ---------------------------------------------------------------- bars


@query(f"WITH {S.BARS} SELECT * FROM bars")
def daily_bars(spark, d):
    return daily(spark, d)


@query(f"WITH {S.BARS} SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, sum(volume) AS volume FROM bars GROUP BY ALL")
def weekly_bars(spark, d):
    return B.weekly(daily(spark, d))


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("symbol", "date", *[F.round(c, 4).alias(c) for c in names])


@query(f"WITH {S.BARS} SELECT symbol, date, " + ", ".join(f"round({S.rolling('avg(close)', n)}, 4) AS \"MA{n}\"" for n in (5, 10, 20, 60)) + " FROM bars")
def moving_averages(spark, d):
    return _rounded(B.with_moving_averages(daily(spark, d)), ["MA5", "MA10", "MA20", "MA60"])


@query(f"WITH {S.BARS}, r AS (SELECT symbol, date, {S.rolling('avg(close)', 20)} AS m, {S.rolling('stddev_samp(close)', 20)} AS s FROM bars) SELECT symbol, date, round(m, 4) AS \"BOLL_mid\", round(m + 2 * s, 4) AS \"BOLL_upper\", round(m - 2 * s, 4) AS \"BOLL_lower\" FROM r")
def bollinger(spark, d):
    return _rounded(B.with_bollinger(daily(spark, d)), ["BOLL_mid", "BOLL_upper", "BOLL_lower"])


@query(f"WITH {S.BARS}, {S.MOVES} SELECT symbol, date, " + ", ".join(f"round({S.rsi(n)}, 4) AS \"RSI_{n}\"" for n in (6, 12, 24)) + " FROM sides")
def relative_strength(spark, d):
    return _rounded(B.with_rsi(daily(spark, d)), ["RSI_6", "RSI_12", "RSI_24"])


@query(f"""WITH RECURSIVE {S.BARS}, n AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
{S.fold('n', 'close', 2 / 13, 'fast')}, {S.fold('n', 'close', 2 / 27, 'slow')},
dif AS (SELECT f.symbol, f.rn, f.y - s.y AS dif FROM fast f JOIN slow s ON s.symbol = f.symbol AND s.rn = f.rn), {S.fold('dif', 'dif', 2 / 10, 'dea')}
SELECT n.symbol, n.date, round(d.dif, 4) AS "MACD_DIF", round(e.y, 4) AS "MACD_DEA", round(2 * (d.dif - e.y), 4) AS "MACD_HIST" FROM n JOIN dif d ON d.symbol = n.symbol AND d.rn = n.rn JOIN dea e ON e.symbol = n.symbol AND e.rn = n.rn""")
def macd(spark, d):
    return _rounded(B.recursive_indicators(daily(spark, d)), ["MACD_DIF", "MACD_DEA", "MACD_HIST"])


@query(f"""WITH RECURSIVE {S.BARS}, {S.RSV}, {S.fold('rsv', 'rsv', 1 / 3, 'kf')}, k AS (SELECT symbol, rn, y AS k FROM kf), {S.fold('k', 'k', 1 / 3, 'df')}
SELECT r.symbol, r.date, round(k.k, 4) AS "KDJ_K", round(df.y, 4) AS "KDJ_D", round(3 * k.k - 2 * df.y, 4) AS "KDJ_J" FROM rsv r JOIN k ON k.symbol = r.symbol AND k.rn = r.rn JOIN df ON df.symbol = r.symbol AND df.rn = r.rn""")
def kdj(spark, d):
    return _rounded(B.recursive_indicators(daily(spark, d)), ["KDJ_K", "KDJ_D", "KDJ_J"])


@query(f"WITH {S.BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, date, close, back::BIGINT AS back FROM r WHERE n >= 30 AND back <= 30")
def latest_rows(spark, d):
    return B.latest(daily(spark, d), 30, 30).select("symbol", "date", "close", F.col("back").cast("long").alias("back"))


@query()
def market_prompts(spark, d):
    """Indicator summaries filled into the analysis prompt."""
    summary = B.market_summary(B.with_indicators(daily(spark, d))).select(F.col("symbol").alias("stock_code"), F.col("symbol").alias("stock_name"), "market_data")
    return P.with_prompt(summary, "stock_analysis").select("stock_code", "prompt")


# ---------------------------------------------------------------- mixing


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), task_of(F.col("doc_id")).alias("task"))


_T = TASK_OF.format(key="doc_id")
TASKS = f"t AS (SELECT doc_id AS key, {_T} AS task FROM documents)"


@query(f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(task, 'general') ORDER BY {S.draw('key')}, key) AS r FROM t) SELECT key, coalesce(task, 'general') AS task FROM r WHERE r <= CASE coalesce(task, 'general') WHEN 'risk_assessment' THEN 10 WHEN 'general' THEN 15 ELSE 100 END")
def sample_tasks(spark, d):
    rows = labelled(spark, d).withColumn("task", F.coalesce("task", F.lit("general")))
    return mix.sample_tasks(rows, caps={"risk_assessment": 10, "general": 15}, default=100)


_QUOTA = "CASE task " + " ".join(f"WHEN '{t}' THEN floor((SELECT count(*) FROM t) * {r})" for t, r in K.TASK_RATIO.items()) + " END"


@query(f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {S.draw('key')}, key) AS r FROM t) SELECT key, task FROM r WHERE task IS NULL OR r <= {_QUOTA}")
def balance_tasks(spark, d):
    return mix.balance_tasks(labelled(spark, d), "task")


@query(f"SELECT doc_id AS key, row_number() OVER (ORDER BY {S.draw('doc_id')}, doc_id)::BIGINT AS position FROM documents")
def shuffle_positions(spark, d):
    return mix.shuffled(table(spark, d, "documents").select(F.col("doc_id").alias("key")))


@query(f"WITH r AS (SELECT doc_id AS key, row_number() OVER (ORDER BY {S.draw('doc_id')}, doc_id) AS position FROM documents) SELECT key, CASE WHEN position <= floor((SELECT count(*) FROM r) * 0.95) THEN 'train' ELSE 'eval' END AS split FROM r")
def train_eval_split(spark, d):
    return mix.split_train_eval(table(spark, d, "documents").select(F.col("doc_id").alias("key"))).select("key", "split")


@query(f"WITH {TASKS} SELECT coalesce(task, 'unknown') AS task, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM t), 4) AS percent FROM t GROUP BY 1")
def task_distribution(spark, d):
    return mix.task_distribution(labelled(spark, d), "task")


@query(f"WITH {S.canonical(True)}, v AS (SELECT unnest(turns) AS t FROM canon), n AS (SELECT length(t.value) AS n FROM v WHERE t.role = 'gpt') SELECT count(*)::BIGINT AS n_turns, round(avg(n), 4) AS mean_length, median(n)::DOUBLE AS median_length, min(n)::BIGINT AS min_length, max(n)::BIGINT AS max_length FROM n")
def answer_lengths(spark, d):
    return mix.answer_lengths(chats(spark, d))


@query(f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (ORDER BY {S.draw('key')}, key) AS position FROM t) SELECT coalesce(task, 'general') AS task, count(*)::BIGINT AS n FROM r WHERE position > floor((SELECT count(*) FROM r) * 0.95) GROUP BY 1")
def eval_distribution(spark, d):
    held = mix.split_train_eval(labelled(spark, d)).filter("split = 'eval'")
    return mix.task_distribution(held, "task", "general").select("task", "n")


# ---------------------------------------------------------------- metrics


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Truth: the quality label; guess: whether the text is longer than 1000 characters; three classes."""
    both = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    name = lambda good, toxic: F.when(toxic, "negative").when(good, "positive").otherwise("neutral")
    return both.select("doc_id", name(F.col("quality") == 1, F.col("toxic") == 1).alias("y_true"), name(F.col("n_chars") > 1000, F.col("n_chars") < 300).alias("y_pred"))


JUDGED = "j AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y_true, CASE WHEN n_chars < 300 THEN 'negative' WHEN n_chars > 1000 THEN 'positive' ELSE 'neutral' END AS y_pred FROM labels JOIN documents USING (doc_id))"
COUNTS = """l AS (SELECT y_true AS label FROM j UNION SELECT y_pred FROM j),
c AS (SELECT label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true <> label AND y_pred = label) AS fp, count(*) FILTER (y_true = label AND y_pred <> label) AS fn FROM l, j GROUP BY label),
pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c),
f AS (SELECT *, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM pr)"""


@query(f"WITH {JUDGED} SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy FROM j")
def accuracy(spark, d):
    return E.accuracy(judged(spark, d))


@query(f"WITH {JUDGED} SELECT y_true AS t, y_pred AS p, count(*)::BIGINT AS n FROM j GROUP BY ALL")
def confusion_matrix(spark, d):
    return E.confusion(judged(spark, d))


@query(f"WITH {JUDGED}, {COUNTS} SELECT label, precision, recall, f1 FROM f")
def per_class_scores(spark, d):
    return E.per_label(judged(spark, d))


@query(f"""WITH {JUDGED}, {COUNTS}, s AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c)
SELECT 'macro' AS average, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM f
UNION ALL SELECT 'micro', round(tp / (tp + fp), 4), round(tp / (tp + fn), 4), round(2 * tp / (2 * tp + fp + fn), 4) FROM s""")
def f1_summary(spark, d):
    pairs = judged(spark, d)
    parts = [E.f1_summary(pairs, a).withColumn("average", F.lit(a)) for a in ("macro", "micro")]
    return parts[0].unionByName(parts[1])


_ALIAS = {"positive": "利好", "negative": "负面", "neutral": " 中立 "}


@query(f"WITH {JUDGED}, {COUNTS} SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, precision, recall, f1, (SELECT count(*) FROM j)::BIGINT AS total, (SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 4) FROM j) AS accuracy FROM f")
def sentiment_report(spark, d):
    alias = F.create_map(*[F.lit(x) for pair in _ALIAS.items() for x in pair])
    return E.sentiment_report(judged(spark, d).select(alias[F.col("y_true")].alias("label"), F.col("y_pred").alias("predicted_label")))


WORDS = ["the", "and", "tion", "ing", "the"]


@query("SELECT doc_id, round((" + " + ".join(f"contains(text, '{w}')::INTEGER" for w in WORDS) + ")::DOUBLE / 5, 4) AS coverage FROM documents")
def keyword_coverage(spark, d):
    return E.keyword_report(table(spark, d, "documents"), WORDS).select("doc_id", "coverage")


@query(f"SELECT doc_id, {S.quality_score('text')} AS score FROM documents")
def response_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", M.response_quality(F.col("text")).alias("score"))


def replies(spark: SparkSession, d: str) -> DataFrame:
    """A turn as reference, the next one as hypothesis."""
    c = table(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return c.select("conv_id", "turn", F.col("text").alias("reference")).join(after, ["conv_id", "turn"])


REPLIES = "p AS (SELECT a.conv_id, a.turn, a.text AS reference, b.text AS prediction FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _bleu_sql() -> str:
    parts = []
    for side in ("reference", "prediction"):
        parts.append(f"{side[0]} AS (SELECT conv_id, turn, n, substr({side}, i, n) AS g, count(*) AS k FROM p, (VALUES (1), (2), (3), (4)) v(n), unnest(range(1, greatest(length({side}) - n + 2, 1))) u(i) GROUP BY ALL)")
    return f"""WITH {REPLIES}, {parts[0].replace('r AS', 'rg AS', 1)}, {parts[1].replace('p AS', 'pg AS', 1)},
hit AS (SELECT conv_id, turn, n, sum(least(pg.k, rg.k)) AS hit FROM pg JOIN rg USING (conv_id, turn, n, g) GROUP BY ALL),
prec AS (SELECT p.conv_id, p.turn, v.n, coalesce(hit, 0)::DOUBLE / greatest(length(prediction) - v.n + 1, 1) AS pr FROM p CROSS JOIN (VALUES (1), (2), (3), (4)) v(n) LEFT JOIN hit ON hit.conv_id = p.conv_id AND hit.turn = p.turn AND hit.n = v.n),
geo AS (SELECT conv_id, turn, min(pr) AS low, avg(ln(CASE WHEN pr > 0 THEN pr ELSE 1 END)) AS l FROM prec GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN low = 0 OR length(prediction) < 4 THEN 0.0 ELSE round(exp(l) * CASE WHEN length(prediction) < length(reference) THEN exp(1 - length(reference)::DOUBLE / length(prediction)) ELSE 1 END, 4) END AS bleu FROM p JOIN geo ON geo.conv_id = p.conv_id AND geo.turn = p.turn"""


@query(_bleu_sql())
def bleu(spark, d):
    return replies(spark, d).select("conv_id", "turn", M.bleu(F.col("reference"), F.col("prediction")).alias("bleu"))


@query()
def rouge_l(spark, d):
    rows = replies(spark, d).select("conv_id", "turn", M.rouge_l(F.col("reference"), F.col("prediction")).alias("r"))
    return rows.select("conv_id", "turn", *[F.round(f"r.{c}", 4).alias(c) for c in ("precision", "recall", "f1")])


@query()
def generation_report(spark, d):
    return E.generation_report(replies(spark, d), "stock_analysis")


@query()
def code_report(spark, d):
    """Documents wrapped in code, every third one broken."""
    wrap = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("import re\nx = '"), F.col("lang"))).otherwise(F.concat(F.lit("```python\ndef f():\n    return '"), F.col("lang"), F.lit("'\n```\n"), "text"))
    return E.code_report(table(spark, d, "documents").select(wrap.alias("prediction")))


def replies_to_mcq(spark: SparkSession, d: str) -> DataFrame:
    """Answers that use every rule: a leading letter, phrases, a lone letter, none."""
    letter = F.get(F.array(*map(F.lit, "ABCD")), (F.col("doc_id") % 4).cast("int"))
    kind = (F.col("doc_id") / 4).cast("long") % 5
    text = F.when(kind == 0, F.concat(F.lit("  "), letter, F.lit(". x"))).when(kind == 1, F.concat(F.lit("我认为答案是："), letter)).when(kind == 2, F.concat(F.lit("应该选择 "), letter)).when(kind == 3, F.concat(F.lit("it is "), letter)).otherwise(F.lit("maybe C or D"))
    truth = F.get(F.array(*map(F.lit, ["A", "b", "AB", "AC", "D", ""])), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.alias("response"), truth.alias("answer"))


MCQ = """q AS (SELECT doc_id, doc_id // 4 % 5 AS kind, ['A', 'B', 'C', 'D'][1 + doc_id % 4] AS letter, ['A', 'b', 'AB', 'AC', 'D', ''][1 + doc_id % 6] AS answer FROM documents),
m AS (SELECT doc_id, answer, trim(CASE kind WHEN 0 THEN '  ' || letter || '. x' WHEN 1 THEN '我认为答案是：' || letter WHEN 2 THEN '应该选择 ' || letter WHEN 3 THEN 'it is ' || letter ELSE 'maybe C or D' END) AS response FROM q)"""


@query(f"WITH {MCQ} SELECT doc_id, {S.answer('response')} AS predicted FROM m")
def mcq_answers(spark, d):
    return replies_to_mcq(spark, d).select("doc_id", M.extract_answer(F.col("response")).alias("predicted"))


@query(f"WITH {MCQ} SELECT doc_id, upper(answer) IN ('A', 'B', 'C', 'D', 'AB', 'BC', 'CD', 'ABC', 'BCD', 'ABCD') AS valid FROM m")
def mcq_validity(spark, d):
    return replies_to_mcq(spark, d).select("doc_id", M.valid_answer(F.col("answer")).alias("valid"))


@query(f"WITH {MCQ}, v AS (SELECT upper(answer) AS t, {S.answer('response')} AS p FROM m WHERE upper(answer) IN ('A', 'B', 'C', 'D', 'AB', 'BC', 'CD', 'ABC', 'BCD', 'ABCD')) SELECT count(*)::BIGINT AS n, round(avg((t = p)::INTEGER)::DOUBLE, 4) AS accuracy FROM v")
def mcq_accuracy(spark, d):
    rows = replies_to_mcq(spark, d).filter(M.valid_answer(F.col("answer")))
    return E.accuracy(rows.select(F.upper(X.strip(F.col("answer"))).alias("y_true"), M.extract_answer(F.col("response")).alias("y_pred")))


@query("SELECT p_partkey, " + S.lit(K.MCQ_PROMPT).replace("{question}", "' || p_name || '").replace("{A}", "' || p_brand || '").replace("{B}", "' || p_type || '").replace("{C}", "' || CAST(p_size AS VARCHAR) || '").replace("{D}", "") + " AS prompt FROM part")
def mcq_prompts(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lit("A").alias("answer"), F.col("p_name").alias("input"), F.col("p_brand").alias("A"), F.col("p_type").alias("B"), F.col("p_size").cast("string").alias("C"))
    return E.mcq_prompts(rows).select("p_partkey", "prompt")


# ---------------------------------------------------------------- incremental intake, prompts, generation


@query(f"WITH {NEWS}, n AS (SELECT *, md5({S.strip('title')} || '_' || {S.strip('date')}) AS news_id FROM news) SELECT min(seq) AS seq, news_id FROM n WHERE source <> 'src1' AND news_id NOT IN (SELECT news_id FROM n WHERE source = 'src1') GROUP BY news_id")
def incremental_news(spark, d):
    """What one source has is known; all others' documents arrive."""
    rows = news(spark, d).withColumn("news_id", X.news_id(F.col("title"), F.col("date")))
    return N.unseen(rows.filter("source <> 'src1'"), rows.filter("source = 'src1'")).select("seq", "news_id")


@query(f"WITH {NEWS}, n AS (SELECT seq, {S.flat('title')} AS title, {S.flat('content')} AS content, date, source FROM news) SELECT md5({S.strip('title')} || '_' || {S.strip('date')}) AS news_id, title, content, date, source, lpad(CAST(seq AS VARCHAR), 6, '0') AS stock_code, 'n' || seq AS stock_name FROM n WHERE length(title) >= 5")
def news_records(spark, d):
    rows = news(spark, d).withColumn("code", F.col("seq").cast("string"))
    names = rows.select(X.zero_padded(F.col("code")).alias("stock_code"), F.concat(F.lit("n"), "code").alias("stock_name"))
    return N.normalised(rows, code="code", names=names)


@query(f"WITH {NEWS}, r AS (SELECT seq, title, substr(content, 1, 500) AS content FROM news WHERE title IS NOT NULL AND {S.strip('title')} <> '' AND length(title) > 10 ORDER BY seq LIMIT 500) SELECT seq, title, content FROM r")
def sentiment_inputs(spark, d):
    return P.sentiment_inputs(news(spark, d), order="seq")


@query(f"WITH {NEWS} SELECT seq, " + S.lit(K.TEMPLATES["sentiment_analysis"]).replace("{title}", "' || title || '").replace("{content}", "' || content || '") + " AS prompt FROM news WHERE title IS NOT NULL AND content IS NOT NULL")
def filled_prompts(spark, d):
    return P.with_prompt(news(spark, d), "sentiment_analysis").select("seq", "prompt")


def echo(prompts: list[str]) -> list[tuple[str, int, int]]:
    """A stand-in for a model: the prompt's length and its first word."""
    return [(f"{len(p)} {p.split(maxsplit=1)[0] if p.split() else ''}", len(p), len(p.split())) for p in prompts]


@query("""WITH a AS (SELECT seq, title, md5('financial_qa' || '_' || title) AS key FROM (SELECT doc_id AS seq, string_split(text, chr(10))[1] AS title FROM documents)),
c AS (SELECT DISTINCT key FROM a WHERE seq % 3 = 0)
SELECT seq, c.key IS NOT NULL AS cached, CASE WHEN c.key IS NOT NULL THEN 'known' ELSE length(title) || ' ' || regexp_extract(title, '\\S+') END AS answer, CASE WHEN c.key IS NULL THEN length(title)::BIGINT END AS input_tokens FROM a LEFT JOIN c ON c.key = a.key""")
def cached_generation(spark, d):
    """Every third prompt has an answer in the cache; the others go to the generator."""
    asked = news(spark, d).select("seq", F.col("title").alias("prompt"), F.lit("financial_qa").alias("task"))
    cache = asked.filter("seq % 3 = 0").select(X.cache_key(F.col("task"), F.col("prompt")).alias("key"), F.lit("known").alias("answer"))
    return P.answered(asked, cache, echo).select("seq", "cached", "answer", "input_tokens")


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (length(trim(regexp_extract(text, '\\S+'))) >= 0)::BIGINT AS n_answered, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS output_tokens FROM conversations")
def generation_counts(spark, d):
    asked = table(spark, d, "conversations").select("conv_id", F.col("text").alias("prompt"))
    return P.generation_counts(P.generate(asked, echo))


@query("SELECT p_partkey::VARCHAR AS name, 'set_' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_filtered' END || '.json' AS file FROM part")
def preferred_files(spark, d):
    """A file of each part: plain, filtered or both, beside two outputs and a stranger."""
    own = table(spark, d, "part").select(F.explode(F.array(
        F.when(F.col("p_partkey") % 3 < 2, F.concat(F.lit("set_"), "p_partkey", F.lit(".json"))), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("set_"), "p_partkey", F.lit("_filtered.json"))),
    )).alias("name")).dropna()
    names = own.unionByName(spark.createDataFrame([("set_train.json",), ("set_eval.json",), ("other.json",)], "name string"))
    return R.preferred_files(names, prefix="set_", outputs=("set_train.json", "set_eval.json")).select(F.col("task").alias("name"), F.col("name").alias("file"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS open, o_totalprice AS close FROM orders")
def bars_from_lines(spark, d):
    """Quote lines whose opening price is a dash in every other row."""
    price = F.col("o_totalprice").cast("string")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, price).otherwise("-"), price)
    return R.bars_from_lines(table(spark, d, "orders").select("o_orderkey", line.alias("line"))).select("o_orderkey", "date", "open", "close")


@query("SELECT id, question FROM (VALUES " + ", ".join(f"({i}, {S.lit(q)})" for i, q in enumerate(K.QUESTIONS)) + ") v(id, question)")
def question_bank(spark, d):
    return spark.createDataFrame(P.questions(), "id int, question string")
