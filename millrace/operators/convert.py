"""Instruction and chat layouts to one conversation schema.

The canonical row is (seq, conversations: array of (from, value), system, task_type); seq keeps the file order, which some
layouts depend on. task_type is null when it is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import constants as K
from millrace.functions.text import is_present, strip
from millrace.operators.order import carried_forward

TURN = "struct<from:string,value:string>"


def _turn(role: str, value: Column) -> Column:
    return F.struct(F.lit(role).alias("from"), value.alias("value"))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def canonical(df: DataFrame, user: Column, answer: Column, system: str = "", task: str = "", seq: str = "seq") -> DataFrame:
    """Rows with both sides; a blank side rejects the row, both are stripped."""
    return df.filter(is_present(user) & is_present(answer)).select(
        seq, F.array(_turn("human", strip(user)), _turn("gpt", strip(answer))).alias("conversations"),
        F.lit(system).alias("system"), F.nullif(F.lit(task), F.lit("")).alias("task_type"),
    )


def from_alpaca(df: DataFrame, system: str = "", task: str = "", seq: str = "seq") -> DataFrame:
    """instruction, input, output: a non-empty input follows the instruction after a blank line."""
    instruction, given = _text(df, "instruction"), _text(df, "input")
    return canonical(df, F.when(given != "", F.concat(instruction, F.lit("\n\n"), given)).otherwise(instruction), _text(df, "output"), system, task, seq)


def from_pairs(df: DataFrame, system: str = "", task: str = "", seq: str = "seq") -> DataFrame:
    """instruction and input, or the one that is there."""
    instruction, given = _text(df, "instruction"), _text(df, "input")
    user = F.when((instruction != "") & (given != ""), F.concat(instruction, F.lit("\n\n"), given)).when(given != "", given).otherwise(instruction)
    return canonical(df, user, _text(df, "output"), system, task, seq)


def _mapped(turns: Column, roles: tuple[str, ...], values: tuple[str, ...], fields: list[str]) -> Column:
    """Turns as (from, value) with the two canonical roles; others go."""
    pick = lambda t, names: F.coalesce(*[t[n] for n in names if n in fields], F.lit(""))
    role = lambda t: F.when(pick(t, roles).isin(K.USER_ROLES), "human").when(pick(t, roles).isin(K.MODEL_ROLES), "gpt")
    both = F.transform(turns, lambda t: F.struct(role(t).alias("from"), pick(t, values).alias("value")))
    return F.filter(both, lambda t: t["from"].isNotNull())


def _fields(df: DataFrame, name: str) -> list[str]:
    return df.schema[name].dataType.elementType.fieldNames()


def from_mixed(df: DataFrame, system: str = "", task: str = "general", seq: str = "seq") -> DataFrame:
    """conversations with from/role and value/content (two turns at least, before and after mapping; blank ones stay), else
    the instruction layout with ``task``. A conversation has no task type. The argument's system text wins over the row's."""
    own = F.lit(system) if system else _text(df, "system")
    parts = []
    talk = F.lit(False)
    if "conversations" in df.columns:
        talk = F.coalesce(F.size("conversations") > 0, F.lit(False))
        mapped = _mapped(F.col("conversations"), ("from", "role"), ("value", "content"), _fields(df, "conversations"))
        fine = df.filter(talk & (F.size("conversations") >= 2)).withColumn("_turns", mapped).filter(F.size("_turns") >= 2)
        parts.append(fine.select(seq, F.col("_turns").alias("conversations"), own.alias("system"), F.lit(None).cast("string").alias("task_type")))
    parts.append(from_alpaca(df.filter(~talk), system, task, seq))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def from_messages(df: DataFrame, system: str = "", task: str = "", leak: bool = True, dataset: str | None = None, seq: str = "seq") -> DataFrame:
    """messages with role/content: blank turns go, roles are mapped, two turns must be left.

    ``leak``: a system turn also serves every later row of its dataset until the next one, as in the original; else only its
    own row. Rows of fewer than two messages set nothing; rows whose turns are too few in the end do.
    """
    fields = _fields(df, "messages")
    text = lambda t: F.coalesce(*[t[n] for n in ("content", "value") if n in fields], F.lit(""))
    role = lambda t: F.coalesce(*[t[n] for n in ("role", "from") if n in fields], F.lit(""))
    rows = df.filter(F.size("messages") >= 2)
    spoken = F.filter("messages", lambda t: is_present(text(t)))
    own = F.element_at(F.filter(spoken, lambda t: role(t) == "system"), -1)
    rows = rows.withColumn("_system", F.when(F.size(F.filter(spoken, lambda t: role(t) == "system")) > 0, strip(text(own))))
    mapped = F.transform(_mapped(spoken, ("role", "from"), ("content", "value"), fields), lambda t: F.struct(t["from"].alias("from"), strip(t["value"]).alias("value")))
    rows = rows.withColumn("_turns", mapped)
    if leak:  # what is carried on is written: not the messages, which the turns come from
        rows = rows.select(seq, "_turns", "_system", (F.col(dataset) if dataset else F.lit("")).alias("_set"))
        rows = carried_forward(rows, "_set", seq, "_system", "_now")
    else:
        rows = rows.withColumn("_now", F.col("_system"))
    return rows.filter(F.size("_turns") >= 2).select(
        seq, F.col("_turns").alias("conversations"), F.coalesce("_now", F.lit(system)).alias("system"), F.nullif(F.lit(task), F.lit("")).alias("task_type")
    )


def layout(lines: DataFrame, line: str = "line", seq: str = "seq") -> str:
    """The layout of a dataset by the keys of its first row alone: mixed, messages, alpaca, pairs or unknown."""
    keys = lines.select(F.min_by(F.json_object_keys(line), seq).alias("k")).first()["k"] or []
    for name, needed in (("mixed", {"conversations"}), ("messages", {"messages"}), ("alpaca", {"instruction"}), ("pairs", {"input", "output"})):
        if needed <= set(keys):
            return name
    return "unknown"


LINE = (
    "struct<conversations:array<struct<from:string,value:string,role:string,content:string>>,messages:array<struct<role:string,content:string>>,"
    "system:string,instruction:string,input:string,output:string>"
)


def convert(lines: DataFrame, system: str = "", task: str = "", line: str = "line", seq: str = "seq") -> DataFrame:
    """JSON rows of one dataset to canonical rows, by the layout of the first one. An unknown layout gives no rows."""
    kind = layout(lines, line, seq)
    rows = lines.select(seq, F.from_json(line, LINE).alias("r")).select(seq, "r.*")
    if kind == "mixed":
        return from_mixed(rows, system, task, seq)
    if kind == "messages":
        return from_messages(rows, system, task, seq=seq)
    if kind in ("alpaca", "pairs"):
        return (from_alpaca if kind == "alpaca" else from_pairs)(rows, system, task, seq)
    return canonical(rows.filter(F.lit(False)), F.lit(""), F.lit(""), system, task, seq)


def with_prompts(df: DataFrame, prompts: DataFrame, tasks: dict[str, str] | None = None, dataset: str = "dataset", default: str = "general") -> DataFrame:
    """task by dataset (``tasks``: dataset name -> task) and system_prompt by task, both with the default; prompts is a dictionary of a few rows
    (task, system_prompt)."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in tasks.items() for x in pair]), F.col(dataset)) if tasks else F.lit(None).cast("string")
    out = df.withColumn("task", F.coalesce(named, F.lit(default)))
    own = F.broadcast(prompts.select("task", F.col("system_prompt").alias("_own")))
    base = F.broadcast(prompts.filter(F.col("task") == default).select(F.lit(default).alias("_default"), F.col("system_prompt").alias("_base")).limit(1))
    out = out.join(own, "task", "left").withColumn("_default", F.lit(default)).join(base, "_default", "left")
    return out.withColumn("system_prompt", F.coalesce("_own", "_base", F.lit(""))).drop("_own", "_base", "_default")
