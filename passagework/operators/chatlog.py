"""Conversation logs: paging, trimming, titles, rolling summaries.

A conversation may be very long. Everything here needs only its newest or oldest
messages, taken with a constant rank limit, or a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import constants as K
from passagework import skew
from passagework.functions import text as X
from passagework.functions.arrays import ordered_text


def role_label(role: Column) -> Column:
    return F.when(role == "user", K.USER_LABEL).otherwise(K.MODEL_LABEL)


def labelled_lines(
    rows: DataFrame, conv: str, turn: str, chars: int, out: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Messages of a conversation as labelled lines; the caller bounds the rows."""
    line = F.concat(role_label(F.col("role")), F.lit(": "), F.substring("text", 1, chars))
    lines = F.collect_list(F.struct(F.col(turn).alias("position"), line.alias("text")))
    more = [column.alias(name) for name, column in (extra or {}).items()]
    return rows.groupBy(conv).agg(ordered_text(lines, "\n").alias(out), *more)


def newest(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` messages of every conversation, ``age`` 1 being the newest."""
    return skew.top_per_key(messages, [conv], [F.desc(turn)], n, "age")


def followup_context(
    messages: DataFrame, last: int = 6, chars: int = 200, conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """History text for conversations with more than one message."""
    recent = newest(messages, last, conv, turn)
    lines = labelled_lines(recent, conv, turn, chars, "history", {"_n": F.count("*")})
    return lines.where("_n > 1").drop("_n")


def session_list(sessions: DataFrame, messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """Sessions with their number of messages, the most recently touched first."""
    counts = messages.groupBy(session).agg(F.count("*").alias("message_count"))
    touched = F.coalesce("updated_at", "created_at")
    return (
        sessions.join(counts, session, "left")
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)))
        .orderBy(F.desc(touched), session)
    )


def session_page(
    messages: DataFrame, limit: int = K.CHAT_PAGE, before: Column | None = None, conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Last ``limit`` messages of every session, optionally before a turn, with ``has_more``.

    One message more than the page is fetched to know whether older ones exist.
    """
    scoped = messages if before is None else messages.where(F.col(turn) < before)
    fetched = newest(scoped, limit + 1, conv, turn)
    extra = F.max("age").over(Window.partitionBy(conv)) > limit
    return fetched.withColumn("has_more", extra).where(F.col("age") <= limit).drop("age")


def keep_last(messages: DataFrame, n: int = 50, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return newest(messages, n, conv, turn).drop("age")


def trim_history(
    messages: DataFrame,
    max_tokens: int = K.CHAT_TOKENS,
    max_rounds: int = K.CHAT_ROUNDS,
    tokens: Callable[[Column], Column] = X.estimate_tokens,
    conv: str = "conv_id",
    turn: str = "turn",
) -> DataFrame:
    """Newest messages within the token budget and the number of user rounds.

    A system message in front is always kept and counted first. Every message costs
    at least one token, whatever ``tokens`` returns, so no more than ``max_tokens`` of
    them can be kept: the rank limit loses nothing.
    """
    costed = messages.withColumn("_tokens", F.greatest(F.lit(1), F.coalesce(tokens(F.col("text")), F.lit(1))))
    heads = skew.first_per_key(costed, [conv], F.col(turn), [turn, "role", "_tokens"]).where("role = 'system'")
    system = heads.select(conv, F.col(turn).alias("_system_turn"), F.col("_tokens").alias("_system_tokens"))
    # One more row than can be kept covers the system message at the far end.
    recent = newest(costed, max_tokens + 1, conv, turn).join(system, conv, "left")
    body = recent.where(F.col("_system_turn").isNull() | (F.col(turn) != F.col("_system_turn")))
    back = Window.partitionBy(conv).orderBy(F.desc(turn))
    spent = F.sum("_tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))
    rounds = F.coalesce(
        F.sum((F.col("role") == "user").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    fits = (spent + F.coalesce("_system_tokens", F.lit(0)) <= max_tokens) & (rounds < max_rounds)
    # Both conditions only ever turn false once, so no message after a gap is kept.
    kept = body.withColumn("_fits", fits).where("_fits").select(*messages.columns)
    fronts = messages.join(
        heads.select(conv, turn), [conv, turn], "left_semi"
    ).select(*messages.columns)
    return kept.unionByName(fronts)


def auto_title(messages: DataFrame, sessions: DataFrame, chars: int = 10, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Title from the first user message, only where it still is the default."""
    users = messages.where("role = 'user'")
    firsts = skew.first_per_key(users, [conv], F.col(turn), ["text"])
    clean = F.replace(X.strip(F.col("text")), F.lit("\n"), F.lit(" "))
    made = F.substring(clean, 1, chars)
    title = F.when(F.coalesce(made, F.lit("")) != "", made).otherwise(F.lit(K.DEFAULT_TITLE))
    joined = sessions.join(firsts, conv, "left")
    return joined.withColumn(
        "title", F.when(F.col("title") == K.DEFAULT_TITLE, title).otherwise(F.col("title"))
    ).drop("text")


def last_question(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    users = messages.where("role = 'user'")
    return skew.last_per_key(users, [conv], F.col(turn), ["text"]).withColumnRenamed("text", "question")


def answered_flag(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """True when the last message already is an answer."""
    last = skew.last_per_key(messages, [conv], F.col(turn), ["role"])
    return last.select(conv, (F.col("role") == "assistant").alias("answered"))


def summarize_due(
    messages: DataFrame,
    trigger: int = K.SUMMARISE_TRIGGER,
    keep: int = K.SUMMARISE_KEEP,
    conv: str = "conv_id",
    turn: str = "turn",
    block: int = 10_000,
) -> DataFrame:
    """Messages to summarise: the oldest open ones of sessions over the trigger.

    A missing flag counts as not summarised. The number taken is the open *user*
    messages minus ``keep``, yet the messages taken are of any role. Positions are
    counted block by block, so a very long session is not ordered in one task.
    """
    is_open = ~F.coalesce(F.col("summarized"), F.lit(False))
    waiting = messages.where(is_open)
    due = waiting.groupBy(conv).agg(
        F.count_if(F.col("role") == "user").alias("_users"), F.count("*").alias("_n")
    )
    due = due.where((F.col("_users") > trigger) & (F.col("_users") > keep))
    taken = due.select(conv, (F.col("_users") - keep).alias("take"), "_n")
    placed = skew.running_total(
        waiting, [conv], [turn], F.floor(F.col(turn) / block), {"_place": F.lit(1)}
    )
    return skew.join_groups(placed, taken, [conv], "_n", [turn], "inner").where("_place <= take").drop("_place", "take")


def summary_texts(taken: DataFrame, sessions: DataFrame, chars: int = 2000, conv: str = "conv_id", turn: str = "turn", fallback: int = 500) -> DataFrame:
    """New summary per session without a model: the old one and the start of the new lines.

    Only lines that reach into the first ``fallback`` characters are gathered; a line
    has at least four characters, so ``fallback`` of them are always enough.
    """
    head = skew.top_per_key(taken, [conv], [F.col(turn)], fallback, "_rank")
    lines = labelled_lines(head, conv, turn, chars, "new_text")
    joined = lines.join(sessions.select(conv, "summary"), conv, "left")
    start = F.substring("new_text", 1, fallback)
    old = F.coalesce("summary", F.lit(""))
    return joined.select(
        conv,
        F.when(old != "", F.concat(old, F.lit(K.EARLIER_HEADER), start)).otherwise(start).alias("summary"),
    )


def mark_summarized(messages: DataFrame, taken: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """New state of the messages after a summary run."""
    marks = taken.select(conv, turn, F.lit(True).alias("_mark"))
    return (
        messages.join(marks, [conv, turn], "left")
        .withColumn("summarized", F.coalesce("_mark", "summarized", F.lit(False)))
        .drop("_mark")
    )


def inject_summary(messages: DataFrame, summaries: DataFrame, conv: str = "conv_id", turn: str = "turn", prompt: str = "") -> DataFrame:
    """Add the rolling summary to the system message; sessions without one get one."""
    text = F.concat(F.lit(K.SUMMARY_HEADER), F.col("summary"))
    usable = summaries.where(F.coalesce("summary", F.lit("")) != "")
    leading = skew.first_per_key(messages, [conv], F.col(turn), [turn, "role"])
    extended = usable.join(leading.where("role = 'system'"), conv).select(
        conv, turn, F.lit("system").alias("role"), text.alias("_extra")
    )
    changed = messages.join(extended, [conv, turn, "role"], "left").withColumn(
        "text", F.concat("text", F.coalesce("_extra", F.lit("")))
    ).drop("_extra")
    missing = leading.where("role <> 'system'").join(usable, conv, "left")
    added = missing.select(
        conv,
        (F.col(turn) - 1).alias(turn),
        F.lit("system").alias("role"),
        F.concat(F.lit(prompt), F.coalesce(text, F.lit(""))).alias("text"),
    )
    return changed.select(conv, turn, "role", "text").unionByName(added)


def append_turns(exchanges: DataFrame, chars: int = 10_000, conv: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Message rows of (question, answer) pairs, cut to the column width, and the touched sessions."""
    pair = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )
    rows = exchanges.select(conv, "ts", F.explode(pair).alias("m")).select(
        conv, "ts", "m.part", "m.role", F.substring(F.coalesce("m.text", F.lit("")), 1, chars).alias("text")
    )
    touched = exchanges.groupBy(conv).agg(F.max("ts").alias("updated_at"))
    return rows, touched
