"""Text-cleaning column functions.

All of them are built-in expressions, so they stay inside the JVM. Patterns use
``(?U)`` where the cleaning rule means Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"  # with (?U): every Unicode blank
#: The same characters, for trimming: only a text's ends are looked at then.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
BLANKS = r"[ \t\r\f\x0B]+"  # horizontal blanks only
CJK = r"\x{4e00}-\x{9fff}"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.btrim(_col(value), F.lit(SPACES))


def rstrip(value) -> Column:
    return F.rtrim(_col(value), F.lit(SPACES))


def collapse(value) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return strip(F.regexp_replace(_col(value), rf"(?U){SPACE}+", " "))


def squeeze(value) -> Column:
    """White-space-free lower-case form, used as a comparison key."""
    return F.lower(F.regexp_replace(_col(value), rf"(?U){SPACE}+", ""))


def clean_text(value) -> Column:
    """NUL to blank, blank runs to one, three or more newlines to two, trimmed."""
    text = F.regexp_replace(_col(value), r"\x00", " ")
    text = F.regexp_replace(text, BLANKS, " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def lines_of(value) -> Column:
    return F.split(_col(value), r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]")


def _tidy_line(line: Column) -> Column:
    line = strip(F.regexp_replace(line, BLANKS, " "))
    line = F.regexp_replace(line, rf"(?U){SPACE}+([,.;:!?、。，；：！？])", "$1")
    line = F.regexp_replace(line, rf"(?U)([(\[{{（【《]){SPACE}+", "$1")
    line = F.regexp_replace(line, rf"(?U){SPACE}+([)\]}}）】》])", "$1")
    return F.regexp_replace(line, rf"(?U)(?<=[{CJK}]){SPACE}+(?=[{CJK}])", "")


def normalize_lines(value) -> Column:
    """Line-wise tidy-up with consecutive duplicate lines dropped.

    A line is dropped when its key equals the key of the line before it. Comparing
    with the direct neighbour is exact: a dropped line has its neighbour's key.
    """
    kept = F.filter(
        F.transform(
            F.filter(lines_of(value), lambda x: x.rlike(rf"(?U)[^\s\x1c-\x1f]")), _tidy_line
        ),
        lambda x: x != "",
    )
    paired = F.transform(kept, lambda x: F.struct(x.alias("line"), squeeze(x).alias("key")))

    def drop_repeats(pairs: Column) -> Column:
        return F.transform(
            F.filter(
                pairs,
                lambda p, i: (i == 0) | (p["key"] == "") | (p["key"] != F.get(pairs, i - 1)["key"]),
            ),
            lambda p: p["line"],
        )

    # one-element array binds the pairs once
    bound = F.element_at(F.transform(F.array(paired), drop_repeats), 1)
    return strip(F.array_join(bound, "\n"))


def has_text(value) -> Column:
    """Whether a text has anything but blanks. Its normalised lines are not empty then; asking those would make them twice."""
    return _col(value).rlike(r"(?U)[^\s\x1c-\x1f]")


def join_unique_texts(values) -> Column:
    """Blank-line join of normalised texts, first of each key kept."""
    items = F.filter(F.transform(_col(values), normalize_lines), lambda x: x != "")
    keyed = F.transform(items, lambda x: F.struct(x.alias("text"), squeeze(x).alias("key")))

    def keep_first(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["key"])
        firsts = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
        return F.transform(firsts, lambda p: p["text"])

    bound = F.element_at(F.transform(F.array(keyed), keep_first), 1)
    return F.coalesce(F.array_join(bound, "\n\n"), F.lit(""))


def compact_text(value, limit: int, suffix="...") -> Column:
    """Collapse white space and cut with a suffix when the text is longer."""
    text = collapse(F.coalesce(_col(value), F.lit("")))
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    cut = F.concat(rstrip(F.substring(text, 1, limit)), tail)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def normalize_query(value) -> Column:
    return squeeze(F.coalesce(_col(value), F.lit("")))


def first_line(value, limit: int = 160) -> Column:
    full = F.filter(F.transform(lines_of(value), strip), lambda x: x != "")
    return F.substring(F.coalesce(F.get(full, F.lit(0)), F.lit("")), 1, limit)


# A reasoning block ends at its closing tag, or at the end when it is never closed.
_THINK = r"(?is)<think>(.*?)(?:</think>|\z)"


def strip_thinking(value) -> Column:
    return strip(F.regexp_replace(F.coalesce(_col(value), F.lit("")), _THINK, ""))


def reasoning_text(value) -> Column:
    """The concatenated content of the reasoning blocks of a finished completion."""
    return F.array_join(F.regexp_extract_all(F.coalesce(_col(value), F.lit("")), F.lit(_THINK), F.lit(1)), "")


def answer_text(value) -> Column:
    """Everything outside the reasoning blocks, untrimmed."""
    return F.regexp_replace(F.coalesce(_col(value), F.lit("")), _THINK, "")


def parse_score_array(value) -> Column:
    """Scores out of a model reply: code fence dropped, whole array or first bracket span.

    Anything that is not an array of numbers gives null.
    """
    text = strip(F.coalesce(_col(value), F.lit("")))
    text = F.when(
        text.startswith("```"),
        strip(F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```\z", "")),
    ).otherwise(text)
    whole = F.when(text.startswith("["), F.from_json(text, "array<double>"))
    is_json = F.get_json_object(text, "$").isNotNull()
    span = F.regexp_extract(text, r"(\[[\s\S]*\])", 1)
    inner = F.when(~is_json & (span != ""), F.from_json(span, "array<double>"))
    scores = F.coalesce(whole, inner)
    return F.when(F.forall(scores, lambda x: x.isNotNull()), scores)
