"""Tokens, phrases and lexical scores as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.strings import CJK, SPACE, _col, collapse, squeeze, strip

TOKEN = rf"[a-zA-Z0-9][a-zA-Z0-9_+#./-]*|[{CJK}]+"
CJK_RUN = rf"^[{CJK}]+\z"
NGRAM_LIMIT = 24

# --- fixed values: conversational openings and closings of a question ---
QUESTION_PREFIXES = (
    "请帮我", "帮我查一下", "帮忙查一下", "讲一下", "讲一讲", "讲讲", "说一下", "说一说", "说说",
    "介绍一下", "说明一下", "请介绍", "我想知道", "想知道", "请问", "帮我", "帮忙", "麻烦", "查一下",
    "查询", "查找", "找一下", "检索", "搜索", "看一下", "告诉我", "关于", "请",
)
QUESTION_SUFFIXES = (
    "主要包括哪些", "主要包括什么", "分别是什么", "包括哪些", "包括什么", "有哪些内容", "有哪几项",
    "有哪几条", "有哪几个", "是什么", "是哪些", "有哪些", "的内容", "内容", "吗", "呢", "呀",
)
SEGMENT_BREAK = r"[\r\n\t,;:!?，。！？；：、（）()\[\]{}<>《》“”‘’\"']+"
CHAPTER_HEAD = r"^第[一二三四五六七八九十百千万0-9]+[章节篇部分条款](.{4,})\z"
# --- end of fixed values ---


def bound(value: Column, body) -> Column:
    """``body`` of a value that it reads more than once: the one-element array makes the value once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def raw_tokens(value) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(value), F.lit(""))), F.lit(TOKEN), F.lit(0))


def has_token(value) -> Column:
    return F.lower(F.coalesce(_col(value), F.lit(""))).rlike(TOKEN)


def cjk_ngrams(run: Column) -> Column:
    """Bigrams, then trigrams, at most 24 together."""
    size = F.length(run)
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(run, i, F.lit(2)))
    triples = F.when(
        size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.substring(run, i, F.lit(3)))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(size >= 2, F.slice(F.concat(pairs, triples), 1, NGRAM_LIMIT)).otherwise(
        F.array().cast("array<string>")
    )


def index_tokens(value) -> Column:
    """Raw tokens followed by the n-grams of CJK runs, repeats kept."""

    def with_ngrams(raw: Column) -> Column:
        runs = F.filter(raw, lambda t: t.rlike(CJK_RUN))
        return F.when(F.size(runs) == 0, raw).otherwise(F.concat(raw, F.flatten(F.transform(runs, cjk_ngrams))))

    # the one-element array binds the raw tokens, so a text is scanned once
    return F.element_at(F.transform(F.array(raw_tokens(value)), with_ngrams), 1)


def tokenize(value) -> Column:
    """Distinct tokens in order of first appearance."""
    return F.array_distinct(index_tokens(value))


def phrase_segments(query) -> Column:
    value = F.lower(F.coalesce(_col(query), F.lit("")))
    sources = F.array(collapse(value), F.regexp_replace(value, rf"(?U){SPACE}+", ""))
    pieces = F.flatten(F.transform(sources, lambda s: F.split(s, SEGMENT_BREAK)))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def strip_question_words(phrase) -> Column:
    """Remove openings and closings until nothing changes.

    Each round drops one opening (first of the list that fits) and one closing; every
    round that matters shortens the phrase, so its length bounds the rounds. After a round
    that changed nothing the others are skipped.
    """
    opening = "^(?:" + "|".join(QUESTION_PREFIXES) + ")"
    closing = "(?:" + "|".join(QUESTION_SUFFIXES) + r")\z"

    def one_round(state: Column, _i: Column) -> Column:
        without_opening = strip(F.regexp_replace(state["text"], opening, ""))
        stripped = strip(F.regexp_replace(without_opening, closing, ""))
        after = bound(stripped, lambda t: F.struct(t.alias("text"), (t != state["text"]).alias("again")))
        return F.when(state["again"], after).otherwise(state)

    def stripped_of(start: Column) -> Column:
        first = F.struct(start.alias("text"), F.lit(True).alias("again"))
        rounds = F.aggregate(F.sequence(F.lit(1), F.length(start) + 1), first, one_round, lambda s: s["text"])
        return F.when(start.rlike(opening) | start.rlike(closing), rounds).otherwise(start)

    return bound(collapse(phrase), stripped_of)


def phrase_candidates(phrase: Column) -> Column:
    """A phrase of four or more characters with its long pieces and variants."""

    def of_text(text: Column) -> Column:
        return bound(F.regexp_replace(text, rf"(?U){SPACE}+", ""), lambda dense: of_dense(text, dense))

    def of_dense(text: Column, dense: Column) -> Column:
        pieces = F.filter(F.split(text, rf"(?U){SPACE}+"), lambda p: F.length(p) >= 4)
        after_head = F.regexp_extract(dense, CHAPTER_HEAD, 1)
        extra = F.filter(
            F.array(F.when(dense != text, dense), bound(after_head, lambda a: F.when(a != "", a))),
            lambda x: x.isNotNull(),
        )
        return F.when(F.length(dense) >= 4, F.concat(F.array(text), pieces, extra)).otherwise(
            F.array().cast("array<string>")
        )

    return bound(F.regexp_replace(phrase, r"^[ \-_/\\]+|[ \-_/\\]+\z", ""), of_text)


def phrase_terms(query) -> Column:
    """Search phrases of a question, most complete first."""
    phrases = F.transform(phrase_segments(query), strip_question_words)
    return F.array_distinct(F.flatten(F.transform(phrases, phrase_candidates)))


def search_terms(query) -> Column:
    """Phrases followed by tokens: the terms of a keyword search."""
    return F.array_distinct(F.concat(phrase_terms(query), tokenize(query)))


def rerank_terms(query) -> Column:
    """Phrases, tokens and the tokens of the separator-expanded query."""
    spread = F.regexp_replace(_col(query), r"[/\\|,;:，；、()\[\]{}<>]", " ")
    return F.array_distinct(F.concat(phrase_terms(query), tokenize(query), tokenize(spread)))


def score_tokens(terms: Column, tokens: Column, lowered: Column) -> Column:
    """Token hits plus half a point per substring hit, over the root of the token count."""
    exact = F.size(F.array_intersect(F.array_distinct(terms), tokens))
    inside = F.size(F.filter(terms, lambda t: F.contains(lowered, t)))
    root = F.greatest(F.sqrt(F.size(tokens).cast("double")), F.lit(1.0))
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise((exact + inside * F.lit(0.5)) / root)


def keyword_score(terms: Column, text) -> Column:
    """:func:`score_tokens` of a text; tokenise once with it where a text meets many queries."""
    body = F.coalesce(_col(text), F.lit(""))
    return F.element_at(
        F.transform(F.array(tokenize(body)), lambda tokens: score_tokens(terms, tokens, F.lower(body))), 1
    )


def dense_length(term: Column) -> Column:
    return F.length(F.regexp_replace(term, rf"(?U){SPACE}+", ""))


def term_weight(term: Column) -> Column:
    size = dense_length(term)
    return F.when(size >= 8, F.lit(6)).when(size >= 4, F.lit(3)).otherwise(F.lit(1))


def metadata_term_weight(term: Column) -> Column:
    return term_weight(term) + 2


def like_terms(terms: Column, limit: int = 16) -> Column:
    """Substring-search terms ranked by weight, then length, then position."""
    lowered = F.filter(
        F.array_distinct(F.transform(terms, lambda t: F.lower(strip(t)))), lambda t: dense_length(t) >= 2
    )
    ranked = F.sort_array(
        F.transform(
            lowered,
            lambda t, i: F.struct(
                (-term_weight(t)).alias("w"), (-dense_length(t)).alias("n"), i.alias("i"), t.alias("term")
            ),
        )
    )
    return F.slice(F.transform(ranked, lambda s: s["term"]), 1, max(limit, 1))


def required_prefixes(query, limit: int = 16) -> Column:
    """Prefixes a full-text match must all contain."""
    return F.slice(tokenize(query), 1, limit)


def query_keywords(text) -> Column:
    """Up to four tokens worth searching on their own."""
    wanted = F.filter(
        tokenize(text), lambda t: (F.length(t) >= 4) | ((F.length(t) >= 2) & t.rlike(CJK_RUN))
    )
    return F.slice(wanted, 1, 4)


def expanded_queries(original, rewritten, limit: int = 3) -> Column:
    """Distinct search variants of a question, the rewritten form first."""
    first, second = _col(original), F.coalesce(_col(rewritten), _col(original))
    if limit <= 1:
        pool = F.array(second, first)
    else:
        pool = F.concat(
            F.array(second, first),
            phrase_terms(first),
            phrase_terms(second),
            query_keywords(F.concat_ws(" ", first, second)),
        )
    return F.slice(F.array_distinct(F.filter(pool, lambda q: q != "")), 1, max(limit, 1))
