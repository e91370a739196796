"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one training example: all preceding turns are its
context, and only that reply is trainable. Turns are written as
``<s>role[INST]text[/INST]</s>``. Control strings inside roles and texts are
escaped with the character U+241B: it becomes ``U+241B e``, the ``<`` of ``<s>``
or ``</s>`` becomes ``U+241B l`` and the ``[`` of ``[INST]`` or ``[/INST]``
becomes ``U+241B b``, which :func:`unescaped` undoes exactly.

Only DataFrame functions are used. One shuffle by ``conv_id`` gathers the turns
of a conversation; expansion and reading back keep that partitioning. The
context of an example is a prefix of the conversation, so examples are made one
row at a time from the gathered turns and never shuffled.

Nulls: null text or role is empty; null ``turn`` sorts first; rows with a null
``conv_id`` form one conversation. Equal turns sort by role, then text, and
repeated rows are kept. A conversation without assistant turns gives one row
with an empty target, as do turns after the last reply (``kind`` = ``rest``).
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.shared import table

ESC = "␛"


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit(ESC), F.lit(ESC + "e"))
    c = F.regexp_replace(c, r"<(?=/?s>)", ESC + "l")
    return F.regexp_replace(c, r"\[(?=/?INST\])", ESC + "b")


def unescaped(c: Column) -> Column:
    c = F.replace(c, F.lit(ESC + "l"), F.lit("<"))
    c = F.replace(c, F.lit(ESC + "b"), F.lit("["))
    return F.replace(c, F.lit(ESC + "e"), F.lit(ESC))


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>"), role, F.lit("[INST]"), text, F.lit("[/INST]</s>"))


def expand_examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn and one ``rest`` row where turns follow the last reply.

    ``conv_id``, ``example`` (0-based), ``kind`` (``reply`` or ``rest``), ``last`` (of
    its conversation), ``formatted`` (context and target), ``loss_start``,
    ``loss_chars`` (the trainable code points of ``formatted``, 0-based start).
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = gathered.select(
        "conv_id",
        F.transform("turns", lambda t: formatted_turn(escaped(t["role"]), escaped(t["text"]))).alias("parts"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("reply"),
        F.transform("turns", lambda t: F.length(escaped(t["text"]))).alias("chars"),
    )
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("reply", i) | (i == n - 1))
    one = parts.select("conv_id", "parts", "reply", "chars", F.posexplode(ends).alias("example", "at")).withColumns(
        {"formatted": F.concat_ws("", F.slice("parts", 1, F.col("at") + 1)), "is_reply": F.get("reply", F.col("at")), "last": F.col("at") == n - 1}
    )
    tail = len("[/INST]</s>")
    loss = F.when(F.col("is_reply"), F.get("chars", F.col("at"))).otherwise(F.lit(0))
    return one.select(
        "conv_id", "example", F.when(F.col("is_reply"), "reply").otherwise("rest").alias("kind"), "last", "formatted",
        (F.length("formatted") - tail - loss).alias("loss_start"), loss.alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``struct(role, text)``."""
    pieces = F.split(formatted, "</s>")
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescaped(F.substring_index(p.substr(F.lit(4), F.length(p)), "[INST]", 1)).alias("role"),
            unescaped(F.regexp_extract(p, r"(?s)\[INST\](.*)\[/INST\]$", 1)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what the examples hold, one row for each conversation."""
    target = F.when(F.col("kind") == "reply", F.expr("substring(formatted, loss_start + 1, loss_chars)"))
    read = examples.select("conv_id", "example", F.when(F.col("last"), F.col("formatted")).alias("whole"), target.alias("target"), F.length("formatted").alias("size"))
    by = read.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("targets"),
        F.sum("size").alias("formatted_chars"),
    )
    by = by.select("conv_id", read_turns(F.col("whole")).alias("turns"), unescaped(F.concat_ws("", F.col("targets.target"))).alias("loss"), "formatted_chars")
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return by.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts hold the control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = turns.sparkSession.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(rows)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(expand_examples(with_probe(table(spark, sf_dir, "conversations"))))


_ESC_SQL = "replace(replace(replace(replace(replace({0}, '␛', '␛e'), '<s>', '␛ls>'), '</s>', '␛l/s>'), '[INST]', '␛bINST]'), '[/INST]', '␛b/INST]')"

OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    20 + length({_ESC_SQL.format("role")}) + length({_ESC_SQL.format("text")}) AS size FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
