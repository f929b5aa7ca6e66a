"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become
one block; the blocks are joined to one text. Control strings inside roles and texts are escaped in a
way that can be undone. The loss mask lists the places of the assistant's texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The template's marks: start of a block, end of its role, border between merged turns, end of a block.
START, SEP, NEXT, END = "<|start|>", "<|sep|>", "<|next|>", "<|end|>\n"
#: Escapes begin with U+241B; what they stand for, by the digit that follows. The sign itself comes first.
ESCAPE = "␛"
CONTROL = (ESCAPE, "<|", "</s>", "<s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"


def escape(x: Column) -> Column:
    return reduce(lambda c, k: F.replace(c, F.lit(CONTROL[k]), F.lit(f"{ESCAPE}{k}")), range(len(CONTROL)), x)


def unescape(x: Column) -> Column:
    return reduce(lambda c, k: F.replace(c, F.lit(f"{ESCAPE}{k}"), F.lit(CONTROL[k])), reversed(range(len(CONTROL))), x)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of s, e: code points of formatted, end exclusive), one row a conversation.

    Rows are turns, in order of turn, then role, then text (so ties and repeated rows have one order and
    all stay); null roles and texts are empty, null turns come first; rows without a conversation's id
    form one of their own. An empty table gives no rows.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    role_at = lambda i: F.get(F.col("ts"), i)["role"]
    pieces = F.transform(
        "ts",
        lambda t, i: F.struct(
            F.when((i > 0) & (role_at(i - 1) == t["role"]), F.lit(NEXT)).otherwise(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP))).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(role_at(i + 1) == t["role"], F.lit("")).otherwise(F.lit(END)).alias("tail"),
            (t["role"] == ASSISTANT).alias("loss"),
        ),
    )
    chats = chats.select("conv_id", pieces.alias("ps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("of"))

    def step(acc, p):
        s = acc["at"] + F.length(p["head"])
        e = s + F.length(p["body"])
        return F.struct((e + F.length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(acc["of"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["of"]).alias("of"))

    return chats.select("conv_id", F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), F.aggregate("ps", start, step, lambda acc: acc["of"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, merged ones apart again."""
    quoted = lambda s: s.replace("|", "\\|")
    blocks = F.split(formatted, quoted(END), -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def block(b):
        head_body = F.split(b, quoted(SEP), 2)
        role = unescape(F.substring(F.get(head_body, F.lit(0)), F.lit(len(START) + 1), F.length(b)))
        return F.transform(F.split(F.get(head_body, F.lit(1)), quoted(NEXT), -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block))


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text and its mask."""
    chats = format_chats(conversations)
    loss = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["s"] + 1, x["e"] - x["s"]))), "")
    chats = chats.withColumns({"turns": read_back(F.col("formatted")), "loss_text": loss})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


#: A conversation that holds control strings of other templates.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return report(table.unionByName(probe))


def _sql_escape(x: str) -> str:
    for k, c in enumerate(CONTROL):
        x = f"replace({x}, '{c}', '{ESCAPE}{k}')"
    return x


SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), n as (
  select *, lag(role) over w as before, lead(role) over w as after from t window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{ASSISTANT}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = '{ASSISTANT}'), '')) as loss_sha256,
  sum(length({_sql_escape("text")}) + case when before = role then {len(NEXT)} else {len(START) + len(SEP)} + length({_sql_escape("role")}) end
    + case when after = role then 0 else {len(END)} end)::bigint as formatted_chars
from n group by conv_id
"""
