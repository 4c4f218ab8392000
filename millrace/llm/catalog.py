"""The queries opN_<name>: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode
from millrace.llm.chat import link_calls
from millrace.llm.minhash import near_duplicates
from millrace.llm.packing import pack
from millrace.llm.quality import quality
from millrace.llm.rules import quality_rules
from millrace.llm.secrets import scan
from millrace.llm.substrings import remove_shared
from millrace.llm.toxicity import toxicity
from millrace.llm.vectors import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_shared(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Schemas of the tools that ``tool_messages`` calls.
SCHEMAS = {
    "search": {"type": "object", "properties": {"text": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}, "required": ["text", "limit"]},
    "fetch": {"type": "object", "properties": {"limit": {"type": ["integer", "null"]}}, "required": ["text", "url"]},
}


def tool_messages(talk: DataFrame) -> DataFrame:
    """Messages with tool calls in place of plain ones, which are all that the tables have. A turn of the assistant becomes a call and a
    later turn of the user its result. Lengths of texts decide what is called and what goes wrong: identifiers that come twice, references
    back, ahead (cycles) or to nothing, results of no call, arguments that break their schema, a tool without one."""
    n, pair = F.length("text"), F.floor(F.col("turn") / 2)
    name = lambda k: F.concat(F.lit("k"), k.cast("string"))
    own = F.when(n % 11 == 0, "k0").otherwise(name(pair))
    after = F.when(n % 13 == 0, name(pair + 1)).when(n % 2 == 0, name(pair - 1))
    arguments = F.struct("text", (n % 60).alias("limit"), F.when(after.isNotNull(), F.struct(after.alias("$result"))).alias("after"))
    tool = F.get(F.array(*map(F.lit, ["search", "fetch", "unlisted"])), n % 3)
    call = F.to_json(F.struct(F.array(F.struct(own.alias("id"), tool.alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.when(n % 7 == 0, "lost").otherwise(name(F.floor((F.col("turn") - 1) / 2))).alias("tool_call_id"), F.col("text").alias("content")))
    answers = (F.col("role") == "user") & (F.col("turn") > 0)
    role = F.when(answers, "tool").otherwise(F.col("role"))
    return talk.select("conv_id", "turn", role.alias("role"), F.when(F.col("role") == "assistant", call).when(answers, result).otherwise(F.col("text")).alias("text"))


def op4_tool_call_linking(spark: SparkSession, sf_dir: str, schemas: dict | None = None) -> DataFrame:
    """schemas: as of ``link_calls``; given some, the table's messages are taken as they are."""
    talk = table(spark, sf_dir, "conversations")
    return link_calls(talk, schemas) if schemas else link_calls(tool_messages(talk), SCHEMAS)


OP4_SQL = """
WITH RECURSIVE m AS (SELECT *, length(text) AS n, turn // 2 AS pair FROM conversations),
calls AS (SELECT conv_id, turn, role, CASE WHEN n % 11 = 0 THEN 'k0' ELSE 'k' || pair END AS id, ['search', 'fetch', 'unlisted'][1 + n % 3] AS tool, n % 60 AS lim, text,
  CASE WHEN n % 13 = 0 THEN 'k' || (pair + 1) WHEN n % 2 = 0 THEN 'k' || (pair - 1) END AS ref FROM m WHERE role = 'assistant'),
results AS (SELECT conv_id, turn, CASE WHEN n % 7 = 0 THEN 'lost' ELSE 'k' || ((turn - 1) // 2) END AS id, text FROM m WHERE role = 'user' AND turn > 0),
heads AS (SELECT conv_id, id, min(turn) AS first, arg_min(coalesce(ref, ''), turn) AS ref FROM calls GROUP BY conv_id, id),
linked AS (SELECT h.*, t.id IS NOT NULL AS known FROM heads h LEFT JOIN heads t ON t.conv_id = h.conv_id AND t.id = h.ref),
levels(conv_id, id, level) AS (SELECT conv_id, id, 0 FROM linked WHERE NOT known
  UNION ALL SELECT h.conv_id, h.id, l.level + 1 FROM levels l JOIN linked h ON h.conv_id = l.conv_id AND h.ref = l.id),
answers AS (SELECT conv_id, id, max(turn) AS answer FROM results GROUP BY conv_id, id),
facts AS (SELECT h.*, l.level, a.answer FROM linked h LEFT JOIN levels l USING (conv_id, id) LEFT JOIN answers a USING (conv_id, id))
SELECT c.conv_id, c.turn, 0::BIGINT AS item, c.role, 'call' AS kind, c.id AS call_id, c.tool, f.level::INTEGER AS level, coalesce(c.turn = f.first AND f.answer > f.first, false) AS linked,
  concat_ws('; ', CASE WHEN c.tool = 'fetch' THEN '.url: missing' WHEN c.tool = 'unlisted' THEN 'unknown tool' WHEN c.lim < 1 THEN '.limit: below minimum' WHEN c.lim > 50 THEN '.limit: above maximum' END,
    CASE WHEN c.turn <> f.first THEN 'duplicate id' END, CASE WHEN f.level IS NULL THEN 'cycle' END,
    CASE WHEN c.turn = f.first AND f.ref <> '' AND NOT f.known THEN 'unknown reference ' || f.ref END) AS errors,
  CAST(CASE WHEN c.ref IS NULL THEN to_json({'arguments': {'limit': c.lim, 'text': c.text}, 'id': c.id, 'name': c.tool})
    ELSE to_json({'arguments': {'after': {'$result': c.ref}, 'limit': c.lim, 'text': c.text}, 'id': c.id, 'name': c.tool}) END AS VARCHAR) AS json
FROM calls c JOIN facts f USING (conv_id, id)
UNION ALL SELECT r.conv_id, r.turn, 0, 'tool', 'result', r.id, NULL, (f.level + 1)::INTEGER, coalesce(r.turn > f.first, false), '', CAST(to_json({'content': r.text, 'tool_call_id': r.id}) AS VARCHAR)
FROM results r LEFT JOIN facts f USING (conv_id, id)
UNION ALL SELECT conv_id, turn, 0, role, 'plain', NULL, NULL, NULL, NULL, '', CAST(to_json({'content': coalesce(text, ''), 'role': role}) AS VARCHAR)
FROM m WHERE role IS DISTINCT FROM 'assistant' AND NOT (role IS NOT DISTINCT FROM 'user' AND turn > 0)
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_tool_call_linking": op4_tool_call_linking,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_secrets": op6_secrets,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_vector_near_dedup": op10_vector_near_dedup,
}
ORACLES: dict[str, str] = {"op4_tool_call_linking": OP4_SQL}
