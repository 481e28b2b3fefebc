"""Operator 8, chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own.  Its context is all turns before it; only
its own text, with the end mark, is trainable: characters train_from to train_to (counted in code
points, the end excluded) of the example's text.  A turn is rendered as

    <|role|>newline text <|end|>newline

A window over each conversation, sorted by turn, streams the growing prefix; that is one shuffle on
conv_id.  The examples of a conversation are emitted one by one, never held together, so
a conversation needs memory in proportion to its own length.

Defined results: rows of a null conv_id belong to no conversation and are left out; a null turn comes
first; turns of the same number are ordered by role, then text; repeated rows are
turns of their own; roles are compared trimmed and in lower case, a null role is '';
a null text is ''.  A blank assistant turn is nothing to train on: it is no example but
stays in the context of later ones.  '<|' within a text or role is written '< |', so no text forges a mark.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

END = "<|end|>\n"
TARGET = "assistant"
_BLANK = "[ \\t\\n\\r]+"


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn, context_turns, text, train_from, train_to), a row per assistant turn that isn't blank."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    t = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit("")))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said"),
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    head = F.concat(F.lit("<|"), safe(F.col("role")), F.lit("|>\n"))
    reply = F.concat(safe(F.col("said")), F.lit(END))
    before = F.collect_list(F.concat(head, reply)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.select("conv_id", "turn", "role", "said", F.row_number().over(order).alias("position"), before.alias("before"))
    t = t.where((F.col("role") == TARGET) & (F.regexp_replace("said", _BLANK, "") != ""))
    context = F.concat(F.array_join("before", ""), head)
    return t.select(
        "conv_id", "position", "turn", F.size("before").alias("context_turns"), F.concat(context, reply).alias("text"),
        F.length(context).alias("train_from"), (F.length(context) + F.length(reply)).alias("train_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS said
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head, replace(said, '<|', '< |') || '<|end|>' || chr(10) AS reply FROM t),
w AS (
  SELECT *, CAST(row_number() OVER o AS INTEGER) AS position,
         coalesce(string_agg(head || reply, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said))
SELECT conv_id, position, turn, position - 1 AS context_turns, before || head || reply AS text,
       CAST(length(before || head) AS INTEGER) AS train_from, CAST(length(before || head || reply) AS INTEGER) AS train_to
FROM w WHERE role = '{TARGET}' AND regexp_replace(said, '{_BLANK}', '', 'g') <> ''
"""
