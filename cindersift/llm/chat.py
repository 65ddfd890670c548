"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply trainable. Turns
after the last reply (or all, without one) make a last example that trains nothing, so no turn is lost.

Template: ``[INST] role\\ntext [/INST]`` for a turn of any other role, ``<s>text</s>`` for the assistant's. In texts, a
control string gets a backslash after its first character, and one more where it has some, which undoes exactly;
in roles, a backslash becomes ``\\s`` and a line feed ``\\n`` first.

Defined results: turns go by turn number, ties by role and text, a null turn first; a null text or role is empty; rows
of a null conversation id are one conversation with a null id; repeated rows are turns of their own; an empty table has
no examples. Only the four columns named are read. One conversation's text is one value, so it must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The template's control strings.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>")
ASSISTANT = "assistant"
_ESCAPABLE = r"(\[)(\\*)(/?INST\])|(<)(\\*)(/?s>)"
_ESCAPED = r"(\[)\\(\\*)(/?INST\])|(<)\\(\\*)(/?s>)"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPABLE, r"$1$4\\$2$5$3$6")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$4$2$5$3$6")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def examples(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, target, text, loss_start, loss_end): one row per example; the code points [loss_start, loss_end) are trainable.

    target is the number, from 0, of the trainable turn among the conversation's turns; null in an example that trains nothing.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    said = F.when(role == ASSISTANT, F.concat(F.lit("<s>"), escaped(text), F.lit("</s>"))).otherwise(F.concat(F.lit("[INST] "), _role(role), F.lit("\n"), escaped(text), F.lit(" [/INST]")))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), said.alias("said")).alias("t"))
    # The raw text only orders ties; equal turns, roles and texts are equal in the formatted turn too.
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    rows = rows.select("conv_id", F.transform("t", lambda x: x["said"]).alias("said"), F.transform("t", lambda x: x["role"] == ASSISTANT).alias("reply"))
    last = F.size("reply") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.element_at("reply", i + 1) | (i == last))
    rows = rows.select("conv_id", "said", "reply", F.explode(targets).alias("target"))
    target = F.element_at("reply", F.col("target") + 1)
    whole = rows.select("conv_id", F.when(target, F.col("target")).alias("target"), F.array_join(F.slice("said", F.lit(1), F.col("target") + 1), "").alias("text"), F.length(F.element_at("said", F.col("target") + 1)).alias("n"))
    end = F.length("text").cast("long")
    trains = F.col("target").isNotNull()
    return whole.select("conv_id", "target", "text", F.when(trains, end - F.col("n") + len("<s>")).alias("loss_start"), F.when(trains, end - len("</s>")).alias("loss_end"))


def parsed(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""

    def turn(x: Column) -> Column:
        reply = F.struct(F.lit(ASSISTANT).alias("role"), unescaped(F.substring(x, F.lit(4), F.length(x) - 7)).alias("text"))
        inner = F.substring(x, F.lit(8), F.length(x) - 15)
        cut = F.instr(inner, "\n")
        other = F.struct(_unrole(F.substring(inner, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(inner, cut + 1, F.length(inner))).alias("text"))
        return F.when(F.startswith(x, F.lit("<s>")), reply).otherwise(other)

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), turn)


def trained_text(example_text: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescaped(F.substring(example_text, (start + 1).cast("int"), (end - start).cast("int")))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, their digest, and the digest of all text under the loss mask."""
    e = examples(turns)
    # The longest example of a conversation, its last, holds all its turns.
    per = e.select("conv_id", "target", F.length("text").cast("long").alias("n"), trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"), "text")
    per = per.groupBy("conv_id").agg(F.sum("n").alias("formatted_chars"), F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "loss")))).alias("loss"), F.max_by("text", "n").alias("text"))
    per = per.withColumn("loss", F.array_join(F.transform("loss", lambda x: x["loss"]), "")).withColumn("turns", parsed(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
