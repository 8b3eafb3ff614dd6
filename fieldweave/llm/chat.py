r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template: each turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` and a line feed.  A
control string inside a role or text cannot occur unescaped: every ``<``, followed by any
number of backslashes and a bar, gets one backslash more after the ``<``.  Taking it away
again restores the text.

Every assistant turn becomes an example of its own: all turns up to and including it, where
``loss_start`` and ``loss_end`` (code points, end exclusive) mask exactly its text.  A
conversation that does not end in an assistant turn gives one more example with all its turns
and an empty mask, so that the output carries every turn.

The examples of a conversation are prefixes of one string, which is built once; they come one
row at a time out of an explode of turn numbers.  The only shuffle is by conversation.

Defined results: null texts and roles are empty; turns are ordered by turn, role and text,
nulls first, and repeated rows stay; a null conv_id is one conversation; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TARGET = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_chat(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end, last): one row per example."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.struct(F.col("turn").alias("o1"), F.col("role").alias("o2"), F.col("text").alias("o3"), turn.alias("t"))
    conv = conversations.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(order)).alias("rows"))
    piece = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    conv = conv.select("conv_id", F.transform("rows", lambda x: F.struct(x["t"]["role"].alias("role"), F.length(escape(x["t"]["text"])).alias("chars"), piece(x["t"]).alias("piece"))).alias("turns"))
    conv = conv.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["chars"].alias("chars"))).alias("turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("full"),
    )
    # the k-th control string ends the k-th turn, as texts hold none that is not escaped
    one = conv.select("conv_id", "full", F.size("turns").alias("total"), F.posexplode("turns").alias("at", "t"))
    final = F.col("at") == F.col("total") - 1
    target = F.col("t.role") == TARGET
    upto = F.concat(F.call_function("substring_index", F.col("full"), F.lit(END), F.col("at") + 1), F.lit(END))
    one = one.where(target | final).withColumn("formatted", F.when(final, F.col("full")).otherwise(upto))
    end = F.length("formatted")
    text_end = end - F.lit(len(END))
    return one.select(
        "conv_id",
        F.col("at").alias("example"),
        (F.col("at") + 1).alias("n_turns"),
        "formatted",
        F.when(target, text_end - F.col("t.chars")).otherwise(end).alias("loss_start"),
        F.when(target, text_end).otherwise(end).alias("loss_end"),
        final.alias("last"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, TEXT, 1), F.lit(len(TURN) + 1), F.length(p))).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, TEXT, 1)) + F.lit(len(TEXT) + 1), F.length(p))).alias("text"),
        ),
    )


def op2_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the examples."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    ex = format_chat(rows)
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    got = ex.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"), F.when(F.col("last"), F.col("formatted")).alias("whole"))
    by = got.groupBy("conv_id").agg(
        F.first("whole", ignorenulls=True).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    by = by.withColumn("turns", read_turns(F.col("whole")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same rows in DuckDB's SQL.
OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         24 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) AS size
  FROM c),
e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
