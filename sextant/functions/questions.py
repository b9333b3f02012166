"""Predicates and sizes derived from a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.strings import _col, collapse, normalize_query
from sextant.settings import DEFAULTS, Settings

# --- fixed values: word lists of the question rules ---
GREETINGS = (
    "hi", "hello", "hey", "你好", "您好", "在吗", "谢谢", "感谢", "ok", "好的", "嗯",
)
PRONOUNS = (
    "这个|那个|它|他|她|它们|他们|她们|这些|那些|上述|前面|刚才|之前|请问|怎么做|怎么弄|如何处理"
)
TEMPLATE_WORDS = "样本|范本|模板|示例|格式|模版|参考件|sample|template|example|boilerplate"
DRAFT_WORDS = "拟|起草|撰写|编写|生成|写一|给我一份|draft|write|create"
WHOLE_WORDS = (
    "找一份|查找一份|给我一份|参考|完整|全文|整份|整篇|原文|complete|full|find|search|reference"
)
DOCUMENT_WORDS = "合同|协议|文书|标书|招标文件|投标文件|章程|制度|contract|agreement|proposal|tender"
# --- end of fixed values ---


def needs_rewrite(query, has_history, min_chars: int = 8) -> Column:
    """Whether a follow-up question should be rewritten before the search."""
    text = F.coalesce(_col(query), F.lit(""))
    dense = normalize_query(query)
    marked = text.rlike("[?？吗呢]")
    return (
        F.when((dense == "") | dense.isin(*GREETINGS), F.lit(False))
        .when(~F.coalesce(_col(has_history), F.lit(False)), F.lit(False))
        .when(text.rlike(PRONOUNS), F.length(dense) >= 4)
        .when(F.length(dense) < min_chars, F.lit(False))
        .otherwise((F.length(dense) <= 24) & marked)
    )


def clean_rewrite(reply) -> Column:
    """Model reply without surrounding quotes, one line, 500 characters."""
    text = F.regexp_replace(_col(reply), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    text = F.regexp_replace(text, r'^"+|"+\z', "")
    text = F.regexp_replace(text, r"^'+|'+\z", "")
    return F.substring(collapse(text), 1, 500)


def accepts_rewrite(query, rewritten) -> Column:
    value = collapse(F.coalesce(_col(rewritten), F.lit("")))
    size = F.length(value)
    return (size >= 4) & (size <= 500) & ~F.lower(value).isin(*GREETINGS) & (value != _col(query))


def retrieval_query(query, rewritten, has_history, min_chars: int = 8) -> Column:
    """The supplied rewrite where one is due and acceptable, else the question itself."""
    use = needs_rewrite(query, has_history, min_chars) & accepts_rewrite(query, rewritten)
    return F.when(F.coalesce(use, F.lit(False)), _col(rewritten)).otherwise(_col(query))


def wants_full_document(query, enabled: bool = True) -> Column:
    text = normalize_query(query)
    about_document = text.rlike(DOCUMENT_WORDS)
    return F.lit(enabled) & (
        text.rlike(TEMPLATE_WORDS) | (about_document & (text.rlike(DRAFT_WORDS) | text.rlike(WHOLE_WORDS)))
    )


def child_window(top_k, settings: Settings = DEFAULTS) -> Column:
    return _col(top_k) * (max(settings.child_chunks_per_parent, 1) * 2)


def candidate_window(top_k, settings: Settings = DEFAULTS) -> Column:
    floor = settings.rerank_top_n if settings.rerank_enabled else 0
    child = child_window(top_k, settings)
    return F.greatest(child * max(settings.candidate_multiplier, 1), F.lit(floor).cast("long"))


def cross_kb_window(top_k, settings: Settings = DEFAULTS) -> Column:
    floor = settings.rerank_top_n if settings.rerank_enabled else 0
    return F.greatest(_col(top_k) * max(settings.child_chunks_per_parent, 1), F.lit(floor).cast("long"))


def parent_window(top_k, settings: Settings = DEFAULTS) -> Column:
    if not settings.rerank_enabled:
        return _col(top_k)
    top_n = max(settings.rerank_top_n, 0)
    per_parent = max(settings.child_chunks_per_parent, 1)
    floor = (top_n + per_parent - 1) // per_parent
    widened = F.least(F.lit(top_n).cast("long"), _col(top_k) * max(settings.candidate_multiplier, 1))
    return F.greatest(_col(top_k), F.lit(floor).cast("long"), widened)


def hit_window(top_k, settings: Settings = DEFAULTS) -> Column:
    return _col(top_k) * max(settings.child_chunks_per_parent, 1)
