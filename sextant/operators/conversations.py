"""Chat history: pages, token budgets, compression and session records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.strings import SPACE
from sextant.functions.tokens import estimate_tokens, message_cost
from sextant.operators.ranking import running_sum
from sextant.settings import DEFAULTS, Settings

SESSION = ["session_id"]


def history_page(rows: DataFrame, order: list[Column], page: int, size: int, max_size: int = 100) -> DataFrame:
    """One page of a filtered history with the total count on every row."""
    page, size = max(page, 1), min(max(size, 1), max_size)
    total = rows.agg(F.count("*").alias("total")).withColumn("__one", F.lit(1))
    shown = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return shown.withColumn("__one", F.lit(1)).join(total, "__one").drop("__one")


def session_history(messages: DataFrame, session_id) -> DataFrame:
    """All live messages of a session, oldest first."""
    return messages.filter((F.col("session_id") == session_id) & (F.col("deleted") == 0)).orderBy("position")


def session_tokens(messages: DataFrame) -> DataFrame:
    """Estimated tokens and message count of each session."""
    return messages.groupBy(*SESSION).agg(
        F.sum(message_cost("role", "content")).cast("long").alias("history_tokens"),
        F.count("*").alias("n_messages"),
    )


def trigger_tokens(window: Column, settings: Settings = DEFAULTS) -> Column:
    configured = settings.compression_trigger_tokens
    if configured <= 0:
        return F.greatest(F.lit(1024), F.floor(window * 0.8)).cast("long")
    return F.least(F.lit(configured), window).cast("long")


def summary_reserve(budget: Column, settings: Settings = DEFAULTS) -> Column:
    configured = max(1024, settings.summary_reserve_tokens)
    return F.least(F.lit(configured), F.greatest(F.lit(1024), F.floor(budget / 5))).cast("long")


def history_budget(window: Column, settings: Settings = DEFAULTS) -> Column:
    return F.greatest(F.lit(1024), window - max(0, settings.retrieval_reserve_tokens)).cast("long")


def context_plan(sessions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Compression decision and the budgets of each session.

    ``sessions``: session_id, history_tokens, question, context_window.
    """
    window = F.col("context_window").cast("long")
    budget = history_budget(window, settings)
    trigger = trigger_tokens(window, settings)
    compressed = F.col("history_tokens") >= trigger
    reserve = F.when(compressed, summary_reserve(budget, settings)).otherwise(F.lit(0)).cast("long")
    free = F.greatest(
        F.lit(0), budget - reserve - estimate_tokens("question") - settings.token_safety_margin
    ).cast("long")
    raw = F.when(compressed, F.least(free, F.greatest(F.lit(1024), trigger - reserve))).otherwise(free)
    return sessions.select(
        *SESSION,
        "history_tokens",
        budget.alias("token_budget"),
        compressed.alias("compressed"),
        reserve.alias("summary_reserve"),
        raw.cast("long").alias("raw_budget"),
    )


def select_history(messages: DataFrame, budgets: DataFrame) -> DataFrame:
    """Newest messages within each session's ``raw_budget``.

    Costs are positive, so the newest messages that fit are those whose running cost from
    the end is within the budget. A newest message that is too large alone is cut to the
    budget and kept alone. The running cost is summed in blocks of positions, so one long
    session is no bottleneck.
    """
    costed = messages.withColumn("cost", message_cost("role", "content").cast("long"))
    summed = running_sum(costed, SESSION, "position", "cost", "through", descending=True)
    last = messages.groupBy(*SESSION).agg(F.max("position").alias("__last"))
    rows = summed.join(budgets.select(*SESSION, "raw_budget"), SESSION).join(last, SESSION)
    newest = F.col("position") == F.col("__last")
    fits = F.col("through") <= F.col("raw_budget")
    cut = newest & ~fits
    blank = F.regexp_replace("content", r"[\s\x1c-\x1f]+", "") == ""
    shortened = F.when(blank, F.lit("")).otherwise(F.substring(F.col("content"), F.lit(1), F.col("raw_budget").cast("int")))
    return (
        rows.filter((F.col("raw_budget") > 0) & (fits | newest))
        .withColumn("content", F.when(cut, shortened).otherwise(F.col("content")))
        .drop("__last", "raw_budget", "through", "cost")
    )


def summarize_omitted(messages: DataFrame, selected: DataFrame, plans: DataFrame) -> DataFrame:
    """Extractive summary of the messages left out, under the session's reserve.

    One line per omitted message, oldest first, as long as the running cost fits.
    """
    kept = selected.groupBy(*SESSION).agg(F.count("*").alias("n_kept"))
    sizes = messages.groupBy(*SESSION).agg(F.count("*").alias("n_all"))
    counts = sizes.join(kept, SESSION, "left").select(
        *SESSION, (F.col("n_all") - F.coalesce("n_kept", F.lit(0))).alias("n_omitted")
    )
    # the selection is a suffix, so the omitted messages come before its first position
    first_kept = selected.groupBy(*SESSION).agg(F.min("position").alias("first_kept"))
    line = F.concat(
        "role", F.lit(": "), F.trim(F.regexp_replace("content", r"[ \t\n\x0B\f\r]+", " ")), F.lit("\n")
    )
    omitted = (
        messages.join(first_kept, SESSION, "left")
        .filter(F.col("first_kept").isNull() | (F.col("position") < F.col("first_kept")))
        .withColumn("line", line)
        .withColumn("cost", estimate_tokens("line").cast("long"))
    )
    summed = running_sum(omitted.select(*SESSION, "position", "line", "cost"), SESSION, "position", "cost", "through")
    head = F.concat(
        F.lit("Earlier conversation summary: compressed "), F.col("n_omitted").cast("string"),
        F.lit(
            " historical messages.\nRetained facts, user goals, constraints, decisions, and pending tasks in "
            "chronological order:\n"
        ),
    )
    framed = (
        plans.filter("compressed").select(*SESSION, "summary_reserve").join(counts, SESSION).filter("n_omitted > 0")
        .withColumn("head", head).withColumn("head_cost", estimate_tokens("head").cast("long"))
    )
    fitting = summed.join(framed, SESSION).filter(F.col("head_cost") + F.col("through") <= F.col("summary_reserve"))
    lines = fitting.groupBy(*SESSION).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), ""
        ).alias("lines")
    )
    return framed.join(lines, SESSION, "left").select(
        *SESSION,
        "n_omitted",
        F.regexp_replace(F.concat("head", F.coalesce("lines", F.lit(""))), rf"(?U){SPACE}+\z", "").alias("summary"),
    )


def session_records(messages: DataFrame) -> DataFrame:
    """Title from the first question and the last activity of each session."""
    questions = F.col("role") == "user"
    first = F.min_by(F.when(questions, F.col("content")), F.when(questions, F.col("position")))
    return messages.groupBy(*SESSION).agg(
        F.substring(first, 1, 40).alias("title"), F.max("position").alias("last_position"), F.count("*").alias("n_messages")
    )


def delete_sessions(sessions: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soft-delete sessions and, with them, their live messages."""
    marked = doomed.select(*SESSION).distinct().withColumn("__gone", F.lit(1))

    def mark(rows: DataFrame) -> DataFrame:
        gone = F.col("__gone").isNotNull() & (F.col("deleted") == 0)
        return (
            rows.join(marked, SESSION, "left")
            .withColumn("deleted", F.when(gone, F.lit(1)).otherwise(F.col("deleted")))
            .drop("__gone")
        )

    return mark(sessions), mark(messages)
