"""Secret scans: fixed patterns and sliding-window entropy, all built-in functions.

Spans come from splitting the text by a pattern: the pieces between matches and the
matches themselves give every match's place, in characters. Random-looking strings are
runs of key characters. A window slides over each; the sum of ``n * log2(n)`` over its
character counts is updated from the counts of the character that enters and the one that
leaves, which gives the window's Shannon entropy. Windows over the limit of the run's
character class are joined to spans, except those that overlap a match of an allow-list
pattern. Only runs with two letters and two digits are scanned.

Cases: a null text is empty; an empty text has no spans; rows keep their place, so
repeated rows give equal rows; an empty table gives no rows; other columns, whatever their
names, are left alone by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.columns import let

# --- fixed values: the base patterns ---
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # shorter keys are dropped, and no longer one starts inside them
HEX = r"[0-9a-f]{16,}"  # whole runs, as a run ends only where another character stands
ASSIGN_LEAST = 12

# --- parameters of the entropy scan ---
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character that a window needs, by the character class of its run.
LIMITS = {"hex": 3.0, "mixed": 3.75, "lower": 3.5, "upper": 3.5}
#: What looks random but is no secret: identifiers, alphabets, place holders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|redacted|sample",
    r"(?i)abcdefghij|0123456789",
    r"^[0-9=_+/-]+$",
)

SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Places of the leftmost, non-overlapping matches; ``group`` must be ``least`` long."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        stop = start + F.length(x["found"])
        here = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop")))
        kept = F.when(F.length(x["inner"]) >= least, F.concat(state["spans"], here)).otherwise(state["spans"])
        return F.struct(stop.alias("at"), kept.alias("spans"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(text, pattern, -1)
    zipped = F.filter(
        F.arrays_zip(pieces.alias("piece"), found.alias("found"), inner.alias("inner")), lambda x: x["found"].isNotNull()
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    places = F.aggregate(zipped, start, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), places).otherwise(F.array().cast(SPAN))


def _n_log_n(n: Column) -> Column:
    return n * F.log2(F.greatest(n, F.lit(1)))


def _entropy_windows(chars: Column, limit: Column, window: int, allowed: Column) -> Column:
    """Unions of the windows of an array of characters whose entropy reaches the limit.

    Windows that overlap one of the allowed spans do not count.
    """

    def count(array: Column, c: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == c))

    def step(state: Column, p: Column) -> Column:
        # p: the place of the character that enters, from 0
        enters, full = F.get(chars, p), p >= window
        middle = F.slice(chars, F.greatest(p - window + 2, F.lit(1)), F.least(p, F.lit(window - 1)))
        leaves = F.get(chars, p - window)
        left = F.when(full, count(F.slice(chars, F.greatest(p - window + 1, F.lit(1)), window), leaves)).otherwise(0)
        before = state["sum"] - _n_log_n(left) + _n_log_n(F.greatest(left - 1, F.lit(0)))

        def entered(n: Column) -> Column:
            total = before - _n_log_n(n) + _n_log_n(n + 1)

            def judged(total: Column) -> Column:
                bits = F.lit(window).cast("double")
                first = p - window + 1
                high = (p >= window - 1) & (F.log2(bits) - total / bits >= limit)
                high = high & ~F.exists(allowed, lambda x: (x["start"] <= p) & (x["stop"] > first))
                joins = F.size(state["spans"]) > 0
                last = F.element_at(state["spans"], -1)
                grown = F.when(
                    joins & (first <= last["stop"]),
                    F.concat(
                        F.slice(state["spans"], 1, F.greatest(F.size(state["spans"]) - 1, F.lit(0))),
                        F.array(F.struct(last["start"].alias("start"), (p + 1).alias("stop"))),
                    ),
                ).otherwise(
                    F.concat(state["spans"], F.array(F.struct(first.alias("start"), (p + 1).alias("stop"))))
                )
                return F.struct(total.alias("sum"), F.when(high, grown).otherwise(state["spans"]).alias("spans"))

            return let(total, judged)

        return let(count(middle, enters), entered)

    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda state: state["spans"])


def _random_spans(text: Column, window: int, limits: dict[str, float]) -> Column:
    """Entropy spans of the runs that mix letters and digits, beside what the allow-list explains."""

    def scanned(run: Column) -> Column:
        limit = (
            F.when(run["text"].rlike("^[0-9a-fA-F-]+$"), F.lit(limits["hex"]))
            .when(~run["text"].rlike("[A-Z]"), F.lit(limits["lower"]))
            .when(~run["text"].rlike("[a-z]"), F.lit(limits["upper"]))
            .otherwise(F.lit(limits["mixed"]))
        )
        allowed = F.concat(*[_spans(run["text"], pattern, 0) for pattern in ALLOWED])
        windows = let(allowed, lambda held: let(F.split(run["text"], ""), lambda chars: _entropy_windows(chars, limit, window, held)))
        return F.transform(
            windows,
            lambda x: F.struct(
                (run["start"] + x["start"]).alias("start"),
                F.lit(len(KINDS) - 1).alias("rank"),
                (run["start"] + x["stop"]).alias("stop"),
            ),
        )

    def suspicious(run: Column) -> Column:
        return run["text"].rlike("[0-9].*[0-9]") & run["text"].rlike("[A-Za-z].*[A-Za-z]")

    found = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    runs = F.transform(
        F.arrays_zip(_spans(text, RUN, 0).alias("span"), found.alias("text")),
        lambda x: F.struct(x["span"]["start"].alias("start"), x["text"].alias("text")),
    )
    spans = F.flatten(F.transform(F.filter(runs, suspicious), scanned))
    return F.when(text.rlike(RUN), spans).otherwise(F.array().cast(SPAN))


def secret_spans(text: Column, window: int = WINDOW, limits: dict[str, float] | None = None) -> Column:
    """Sorted spans ``(start, rank, stop)`` of a text column, rank being the place in ``KINDS``."""

    def spans(t: Column) -> Column:
        base = F.concat(
            _spans(t, ASSIGN, 0, group=2, least=ASSIGN_LEAST), _spans(t, ACCESS, 1), _spans(t, HEX, 2)
        )

        def with_random(base: Column) -> Column:
            fresh = F.filter(
                _random_spans(t, window, LIMITS | (limits or {})),
                lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["stop"] >= x["stop"])),
            )
            return F.array_sort(F.concat(base, fresh))

        return let(base, with_random)

    return let(F.coalesce(text, F.lit("")), spans)


def describe(spans: Column, ranks: int) -> Column:
    """``kind:start:end`` of the spans of the first so many kinds, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda x: x["rank"] < ranks)
    return F.array_join(
        F.transform(kept, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["stop"])), ","
    )


def digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: counts, checksum and spans per document."""

    def n(rank: int) -> Column:
        return F.size(F.filter("secret_spans", lambda x: x["rank"] == rank)).cast("long")

    found = docs.select("doc_id", secret_spans(F.col("text")).alias("secret_spans"))
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(describe(F.col("secret_spans"), 3), 256).alias("base_sha256"),
        describe(F.col("secret_spans"), len(KINDS)).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Put ``mark`` in the place of every found span; all other text and columns stay.

    Overlapping spans are one. Texts without a span, null texts too, are left as they are.
    """

    def step(state: Column, x: Column) -> Column:
        start = F.greatest(x["start"], state["at"])
        ahead = F.substring(state["rest"], F.lit(1), start - state["at"])
        rest = F.substring(state["rest"], F.greatest(x["stop"] - state["at"], F.lit(0)) + 1, F.length(state["rest"]))
        overlaps = (x["start"] < state["at"]) & (state["at"] > 0)
        return F.when(
            x["stop"] <= state["at"], state
        ).otherwise(
            F.struct(
                x["stop"].alias("at"),
                rest.alias("rest"),
                F.when(overlaps, state["done"]).otherwise(F.concat(state["done"], F.array(ahead, F.lit(mark)))).alias("done"),
            )
        )

    def clean(spans: Column) -> Column:
        empty = F.array().cast("array<string>")
        start = F.struct(F.lit(0).alias("at"), F.col("text").alias("rest"), empty.alias("done"))
        masked = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["done"], ""), s["rest"]))
        return F.when(F.size(spans) > 0, masked).otherwise(F.col("text"))

    return docs.withColumn("text", let(secret_spans(F.col("text")), clean))
