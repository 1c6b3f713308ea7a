"""Chat formatting with a grammar round trip, in built-in expressions only.

A conversation is rendered as a level line and then, for each turn,

    ### ROLE: TEXT</turn>\\n

The parser is deterministic: cut at the end mark, drop the start mark, and cut at the first
": ". Level 0 renders texts as they are. The rendered text is parsed again and the turns are
compared with the source; where they differ, or a text holds a mark as it is, the conversation
is rendered on the next level, which escapes more, until they are identical:

level 1  the marks inside role and text are replaced by escapes (a backslash and a letter)
level 2  backslashes are replaced as well, so every backslash of the output begins an escape

Level 2 reads back by its making, whatever the texts hold. The level stands in the first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END, GAP = "### ", "</turn>\n", ": "
LEVELS = 3
#: Control string and its escape; the text has these, roles the gap as well.
MARKS = ((END.rstrip("\n"), "\\t"), (START.rstrip(" "), "\\h"))
ROLE_MARKS = (*MARKS, (":", "\\c"))


def escape(text: Column, level: int, marks: tuple[tuple[str, str], ...] = MARKS) -> Column:
    """The text as it stands in the output on a level."""
    if level == 0:
        return text
    if level > 1:
        text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for mark, code in marks:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescape(text: Column, level: int, marks: tuple[tuple[str, str], ...] = MARKS) -> Column:
    """The inverse of ``escape``: exact on level 2, elsewhere as far as the text allows."""
    if level == 0:
        return text
    for mark, code in marks:
        text = F.replace(text, F.lit(code), F.lit(mark))
    return F.replace(text, F.lit("\\b"), F.lit("\\")) if level > 1 else text


def render(turns: Column, level: int) -> Column:
    """The conversation as one string; ``turns`` is an array of structs of role and text."""
    def one(t: Column) -> Column:
        return F.concat(F.lit(START), escape(t["role"], level, ROLE_MARKS), F.lit(GAP), escape(t["text"], level), F.lit(END))

    return F.concat(F.lit(f"level {level}\n"), F.array_join(F.transform(turns, one), ""))


def parse(rendered: Column, level: int) -> Column:
    """The turns, an array of structs of role and text, read back from the output."""
    body = F.substring(rendered, len(f"level {level}\n") + 1, 2**31 - 1)
    cut = F.split(body, r"\Q" + END + r"\E")
    parts = F.slice(cut, 1, F.size(cut) - 1)  # nothing stands after the last end mark

    def one(p: Column) -> Column:
        at = F.instr(p, GAP)
        role = F.substring(p, F.lit(len(START) + 1), at - 1 - len(START))
        text = F.substring(p, at + len(GAP), F.length(p))
        return F.struct(unescape(role, level, ROLE_MARKS).alias("role"), unescape(text, level).alias("text"))

    return F.transform(parts, one)


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, turns, level, formatted, parsed``, a row for each conversation.

    ``rows`` has a row for each turn: conv_id, turn, role, text. Null texts and roles are
    empty. Turns stand in the order of turn (null first), ties in that of role and text;
    repeated rows are turns of their own; a null conv_id is a conversation like another. An
    empty table gives no rows. Other columns are left out.

    The shuffle brings the turns of a conversation together, since its output is one string.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    got = got.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    clash = F.exists("turns", lambda t: F.concat(t["role"], F.lit(" "), t["text"]).rlike(r"</turn>|###"))
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when((~clash if k == 0 else F.lit(True)) & (parse(render(F.col("turns"), k), k) == F.col("turns")), k).otherwise(level)
    got = got.withColumn("level", level)

    def by_level(of) -> Column:
        pick = of(LEVELS - 1)
        for k in reversed(range(LEVELS - 1)):
            pick = F.when(F.col("level") == k, of(k)).otherwise(pick)
        return pick

    got = got.withColumn("formatted", by_level(lambda k: render(F.col("turns"), k)))
    return got.withColumn("parsed", by_level(lambda k: parse(F.col("formatted"), k)))


def loss_text(turns: Column) -> Column:
    """What the loss covers: the texts of the assistant, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digest(chats: DataFrame) -> DataFrame:
    """The digests of what is read back from the output of ``format_chats``."""
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("parsed"))
    return chats.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "level",
        (F.col("parsed") == F.col("turns")).alias("identical"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digest(format_chats(rows.unionByName(hard)))


#: The digests follow from the source where the round trip is exact; formatted_chars and
#: level by the grammar.
SQL_OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         bool_or(regexp_matches(role || ' ' || text, '</turn>|###') OR contains(role, ': ')) AS clash1,
         bool_or(contains(text, '\t') OR contains(text, '\h') OR contains(role, '\t') OR contains(role, '\h') OR contains(role, '\c')) AS clash2,
         sum(length(role) + length(text) + 14) AS plain,
         sum(len(regexp_extract_all(text, '</turn>')) * 5 + len(regexp_extract_all(text, '###'))
             + len(regexp_extract_all(role, '</turn>')) * 5 + len(regexp_extract_all(role, '###')) - len(regexp_extract_all(role, ':'))) AS less,
         sum(length(text) - length(replace(text, '\', '')) + length(role) - length(replace(role, '\', ''))) AS slashes
  FROM t GROUP BY conv_id
), l AS (SELECT *, CASE WHEN NOT clash1 THEN 0 WHEN NOT clash2 THEN 1 ELSE 2 END AS level FROM c)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(8 + plain - CASE WHEN level > 0 THEN less ELSE 0 END + CASE WHEN level > 1 THEN slashes ELSE 0 END AS BIGINT) AS formatted_chars,
       CAST(level AS INTEGER) AS level, true AS identical
FROM l
"""
