"""Short-term chat memory and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.config import DEFAULTS
from engram.operators.skew import joined_lines

# The wording of a prompt around its facts and history.
FACTS_HEAD = "Known facts about the user and the context:\n"
FACTS_TAIL = "\nUse these facts where they help; do not list them unless asked.\n\n"


def last_messages(messages: DataFrame, n: int = DEFAULTS.chat_history) -> DataFrame:
    """The last n messages of each session."""
    window = W.partitionBy("session_id").orderBy(F.col("seq").desc())
    return messages.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def retained(messages: DataFrame, size: int = DEFAULTS.session_size) -> DataFrame:
    """What the chat memory keeps of each session."""
    return last_messages(messages, size)


def clear_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def history_before(messages: DataFrame, current: DataFrame, n: int = DEFAULTS.worker_history) -> DataFrame:
    """Recent history before the last occurrence of the message at hand.

    ``current``: session_id, sender, message, one row per session. Where the
    message does not occur in the last n, all of them are kept.
    """
    near = last_messages(messages, n)
    at = near.join(current, "session_id").filter(
        (F.col("role") == F.col("sender")) & (F.col("content") == F.col("message"))
    )
    cut = at.groupBy("session_id").agg(F.max("seq").alias("_cut"))
    return (
        near.join(cut, "session_id", "left")
        .filter(F.col("_cut").isNull() | (F.col("seq") < F.col("_cut")))
        .drop("_cut")
    )


def _ordered(order: list[str], text: Column) -> Column:
    packed = F.sort_array(F.collect_list(F.struct(*order, text.alias("_text"))))
    return F.array_join(F.transform(packed, lambda s: s["_text"]), "")


def transcript(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """``role: content`` lines of each (already cut) session as one text."""
    line = F.concat("role", F.lit(": "), "content", F.lit("\n"))
    return messages.groupBy(key).agg(_ordered(["seq"], line).alias("history"))


def fact_line() -> Column:
    return F.concat(
        F.lit("- "), "attribute", F.lit(": "), "val",
        F.format_string(" (Confidence: %.2f)\n", F.coalesce("confidence_score", F.lit(0.0))),
    )


def _prompt(facts: Column, history: Column, message: Column) -> Column:
    return F.concat(
        F.coalesce(F.concat(F.lit(FACTS_HEAD), facts, F.lit(FACTS_TAIL)), F.lit("")),
        F.coalesce(F.concat(F.lit("Earlier messages:\n"), history, F.lit("\n")), F.lit("")),
        F.lit("New message: "), message, F.lit("\nAnswer:"),
    )


def assemble_prompts(
    asked: DataFrame, facts: DataFrame, messages: DataFrame, history: int = DEFAULTS.chat_history
) -> DataFrame:
    """Prompt of each request out of its facts, its session's history and its message.

    ``asked``: request_id, session_id, message. ``facts``: request_id, part, ord,
    attribute, val, confidence_score, a bounded number per request.
    """
    known = facts.groupBy("request_id").agg(_ordered(["part", "ord"], fact_line()).alias("_facts"))
    talk = transcript(last_messages(messages, history))
    prompt = _prompt(F.col("_facts"), F.col("history"), F.col("message"))
    return (
        asked.join(known, "request_id", "left")
        .join(talk, "session_id", "left")
        .withColumn("prompt", prompt)
        .drop("_facts", "history")
    )


def context_prompts(asked: DataFrame, context: DataFrame, history: DataFrame) -> DataFrame:
    """Prompt of each request out of retrieved context, (already cut) history and message."""
    lines = context.withColumn("line", fact_line()).withColumnRenamed("part", "kind")
    known = joined_lines(lines, ["request_id"], ["kind", "rn", "line"], "line", "_facts")
    prompt = _prompt(F.col("_facts"), F.col("history"), F.col("message"))
    return (
        asked.join(known, "request_id", "left")
        .join(transcript(history), "session_id", "left")
        .withColumn("prompt", prompt)
        .drop("_facts", "history")
    )
