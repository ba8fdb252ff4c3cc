"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes an example: the whole conversation before it as context, its own text alone under the
loss mask. Turns behind the last assistant turn (or a conversation without one) give an example with no loss, so the
output holds every turn. A turn is written as its mark, its text and "</s>". Marks are [INST] for user, [/INST] for
assistant, [SYS] for system and [:role] for any other role. The backslash, "[", "<" and "]" of a text or role are
written as \\0, \\1, \\2 and \\3, so no text can hold a mark, and reading back is exact.

Defined cases: null text and null role are empty; a null conversation id is a conversation; rows are ordered by
turn (null first), then role and text, so ties and repeated rows have one order; an empty table gives an empty
result; other columns are ignored. A conversation is one training record and must fit in a task; the examples of
one with n assistant turns hold n contexts, which is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</s>"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
CODES = {"\\": "\\0", "[": "\\1", "<": "\\2", "]": "\\3"}


def escape(c: Column) -> Column:
    for plain, code in CODES.items():  # the backslash first
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(CODES.items()):  # the backslash last
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _mark(role: Column) -> Column:
    c = F.concat(F.lit("[:"), escape(role), F.lit("]"))
    for name, mark in MARKS.items():
        c = F.when(role == name, F.lit(mark)).otherwise(c)
    return c


def _role(mark: Column) -> Column:
    c = unescape(F.substring(mark, F.lit(3), F.length(mark) - 3))
    for name, m in MARKS.items():
        c = F.when(mark == m, F.lit(name)).otherwise(c)
    return c


def chat_examples(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (from 0), n_turns, formatted, loss_start (from 0) and loss_length in characters of formatted."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    convs = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    written = F.transform("turns", lambda t: F.struct(_mark(t["role"]).alias("mark"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("reply")))
    convs = convs.select("conv_id", written.alias("w"))
    # where an example ends: at each reply, and at the end if that is none
    ends = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("w", i)["reply"] | (i == F.size("w")))
    examples = convs.select("conv_id", "w", F.posexplode(ends).alias("example", "n_turns"))
    line = F.transform(F.slice("w", 1, F.col("n_turns")), lambda t: F.concat(t["mark"], t["text"], F.lit(END)))
    examples = examples.select("conv_id", "example", "n_turns", F.array_join(line, "").alias("formatted"), F.element_at("w", F.col("n_turns")).alias("last"))
    length = F.when(F.col("last.reply"), F.length("last.text")).otherwise(0)
    return examples.select(F.col("conv_id").alias(id_col), "example", "n_turns", "formatted", (F.length("formatted") - len(END) - F.length("last.text")).alias("loss_start"), length.alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The turns of an example, as array<struct<role, text>>."""
    cut = F.split(formatted, END, -1)
    cut = F.slice(cut, 1, F.size(cut) - 1)

    def turn(x: Column) -> Column:
        ends = F.instr(x, "]")
        return F.struct(_role(F.substring(x, F.lit(1), ends)).alias("role"), unescape(F.substring(x, ends + 1, F.length(x))).alias("text"))

    return F.transform(cut, turn)


def digest(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader finds in the examples, a row for each conversation."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    each = examples.select(F.col(id_col).alias("conv_id"), "example", "n_turns", "formatted", loss.alias("loss"))
    convs = each.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    convs = convs.withColumn("turns", read_turns(F.col("longest")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        F.col("conv_id").alias(id_col), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: DuckDB. A turn's written length: its mark, its text with one more character for each escaped one, and the end.
ORACLE = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 4 + length(text) + length(regexp_replace(text, '[^\\\\\\[<\\]]', '', 'g'))
    + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 5
      ELSE 3 + length(role) + length(regexp_replace(role, '[^\\\\\\[<\\]]', '', 'g')) END AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS last
  FROM rows
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR k = last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
