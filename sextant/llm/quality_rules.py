"""Quality rules: a decision list learned by sequential covering, all built-in functions.

Statistics of each text are numbers; a rule is a conjunction of thresholds on them that
tells bad documents. Rules are learned one after the other from labelled documents that
pass the fixed rules: a rule grows by the condition of the greatest information gain until
it covers no good document of the growing set, and is pruned to the beginning that does
best on the pruning set. A rule stays if it is precise on both; what it covers is left out
for the next. Each step is one aggregation over a bounded sample; the driver sees sums per
threshold only. The list becomes one conditional expression.

The sample holds about ``SAMPLE`` labelled documents, chosen by a hash of their ids. It
bounds the fit only: statistics, fixed rules and verdicts are those of every document.

Cases: a null text has no words; texts without words fail the fixed rules; a document with
several labels has the worse one, and null labels are none; without labels of both kinds
no rule is learned and the fixed rules decide; repeated rows give equal rows; an empty
table gives no rows; ``keep_good`` leaves all columns as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.columns import let, words
from sextant.session import store

# --- fixed values: word breaks, symbols and the fixed rules ---
BREAKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
REPEATED_PERCENT = 50

# --- parameters of learning ---
SAMPLE = 6000
SEED = 11
RULES = 8
CONDITIONS = 4
THRESHOLDS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98)
PRECISION = 0.95
LEAST_COVERED = 5

FEATURES = (
    "words", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "marks", "distinct", "line_words", "digits",
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def statistics(text: Column) -> Column:
    """A struct of the base statistics, ``base_failed``, and ``features`` in their order.

    Every intermediate value is bound where it is made, so that a filter on the result that
    the optimizer moves costs one computation and not one for each use.
    """

    def repeated(tokens: Column) -> Column:
        last = F.size(tokens) - 3

        def gram(i: Column) -> Column:
            return F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))

        places = F.sequence(F.lit(0), last)

        def count(grams: Column) -> Column:
            # equal windows stand side by side once sorted; their places, sorted again, tell
            # how many words each repeated window adds
            def doubled(ordered: Column) -> Column:
                at = F.transform(
                    F.filter(
                        ordered,
                        lambda x, i: (x["gram"] == F.get(ordered, i - 1)["gram"]) | (x["gram"] == F.get(ordered, i + 1)["gram"]),
                    ),
                    lambda x: x["at"],
                )
                return let(
                    F.sort_array(at),
                    lambda p: F.aggregate(
                        F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))),
                        F.lit(0),
                        lambda s, x: s + x,
                    ),
                )

            return F.when(
                F.size(F.array_distinct(grams)) < F.size(grams),
                let(F.sort_array(F.transform(places, lambda i: F.struct(gram(i).alias("gram"), i.alias("at")))), doubled),
            ).otherwise(0)

        hashes = F.transform(places, lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))
        return F.when(last > 0, let(hashes, count)).otherwise(0)

    def lines(t: Column) -> Column:
        full = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return let(full, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))

    def counts(t: Column) -> Column:
        return let(
            words(t, BREAKS),
            lambda tokens: F.struct(
                F.size(tokens).cast("long").alias("n_words"),
                F.aggregate(tokens, F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                lines(t).alias("lines"),
                repeated(tokens).cast("long").alias("n_repeat_words"),
                F.regexp_count(t, F.lit("[A-Z]")).alias("capitals"),
                F.regexp_count(t, F.lit("[!?]")).alias("marks"),
                F.regexp_count(t, F.lit("[0-9]")).alias("digits"),
                F.size(F.array_distinct(tokens)).alias("distinct"),
            ),
        )

    def rated(c: Column) -> Column:
        n, chars = (F.greatest(c[x], F.lit(1)).cast("double") for x in ("n_words", "word_chars"))
        n_lines, twice = F.greatest(c["lines"]["all"], F.lit(1)).cast("double"), c["lines"]["all"] - c["lines"]["distinct"]
        features = (
            c["n_words"], c["word_chars"] / n, c["n_symbols"] / n, twice / n_lines, c["n_repeat_words"] / n,
            c["capitals"] / chars, c["marks"] / n, c["distinct"] / n, n / n_lines, c["digits"] / n,
        )
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEATED_PERCENT * c["n_words"])
        return F.struct(
            *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols")],
            twice.cast("long").alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.array(*[f.cast("double") for f in features]).alias("features"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(counts(t), rated))


# A condition is (feature, upper, threshold): value <= threshold if upper, else value > threshold.


def _holds(condition: tuple[int, bool, float], features: Column) -> Column:
    feature, upper, threshold = condition
    value = F.get(features, feature)
    return value <= threshold if upper else value > threshold


def _all_hold(rule: list[tuple[int, bool, float]], features: Column | None = None) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & _holds(condition, F.col("features") if features is None else features)
    return out


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``(bad, prune, features)`` of about ``size`` labelled documents past the fixed rules."""
    named = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = named.count()
    share = min(1.0, size / max(total, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20))
    drawn = named.filter(draw < share * (1 << 20)).select(F.col("doc_id").alias("labelled"), "quality")
    # its size is bounded by the parameter
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled"))
    split = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(3)) == 0
    chosen = met.select((F.col("quality") == 0).alias("bad"), split.alias("prune"), statistics(F.col("text")).alias("s"))
    # filtered once it is written, as the filter would else move to all documents
    known = store(chosen, "quality-sample").filter("NOT s.base_failed")
    return known.select("bad", "prune", "s.features").coalesce(1)


def learn(known: DataFrame) -> list[list[tuple[int, bool, float]]]:
    """The ordered rules."""
    per_feature = known.agg(
        *[F.percentile_approx(F.get(F.col("features"), k), list(THRESHOLDS), 10_000).alias(f"f{k}") for k in range(len(FEATURES))]
    ).first()
    marks = [sorted(set(per_feature[k] or [])) for k in range(len(FEATURES))]
    if not any(marks):
        return []
    # the place of each value among the thresholds of its feature, so that one sum serves all
    places = [
        sum(((F.get("features", k) > t).cast("int") for t in m), F.lit(0)) for k, m in enumerate(marks)
    ]
    binned = store(known.withColumn("places", F.array(*places)), "quality-sample").coalesce(1)
    rules: list[list[tuple[int, bool, float]]] = []
    left = F.lit(True)
    while len(rules) < RULES:
        rule = _grow(binned.filter(left & ~F.col("prune")), marks)
        if rule:
            rule = _prune(binned.filter(left), rule)
        if not rule:
            break
        rule = _center(binned.filter(left), rule)
        rules.append(rule)
        left = left & ~_all_hold(rule)
    return rules


def _grow(rows: DataFrame, marks: list[list[float]]) -> list[tuple[int, bool, float]]:
    rule: list[tuple[int, bool, float]] = []
    while len(rule) < CONDITIONS:
        sums = (
            rows.filter(_all_hold(rule))
            .select("bad", F.posexplode("places").alias("feature", "place"))
            .groupBy("feature", "place")
            .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
            .collect()
        )
        table = [[[0, 0] for _ in range(len(m) + 1)] for m in marks]
        for r in sums:
            table[r["feature"]][r["place"]] = [r["p"], r["n"]]
        p, n = (sum(x[i] for x in table[0]) for i in (0, 1))
        if not p or not n:
            break
        best = None
        for feature, m in enumerate(marks):
            below = [0, 0]
            for k, threshold in enumerate(m):
                below = [below[0] + table[feature][k][0], below[1] + table[feature][k][1]]
                for upper, (a, b) in ((True, below), (False, (p - below[0], n - below[1]))):
                    if a >= LEAST_COVERED:
                        gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = gain, (feature, upper, threshold)
        if best is None:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: list[tuple[int, bool, float]]) -> list[tuple[int, bool, float]]:
    """The shortest best beginning of the rule, or none if it isn't precise."""
    counts = rows.agg(
        *[
            F.count_if(_all_hold(rule[: k + 1]) & (F.col("prune") == prune) & (F.col("bad") == bad)).alias(f"c{k}_{prune}_{bad}")
            for k in range(len(rule))
            for prune in (True, False)
            for bad in (True, False)
        ]
    ).first()
    best = None
    for k in range(len(rule)):
        p, n, gp, gn = (counts[f"c{k}_{prune}_{bad}"] for prune in (True, False) for bad in (True, False))
        precise = p > 0 and p >= PRECISION * (p + n) and gp >= PRECISION * (gp + gn)
        if precise and (best is None or (p - n) / (p + n) > best[0]):
            best = (p - n) / (p + n), rule[: k + 1]
    return best[1] if best else []


def _center(rows: DataFrame, rule: list[tuple[int, bool, float]]) -> list[tuple[int, bool, float]]:
    """Move each lower bound halfway to the least value that the rule covers.

    Upper bounds are values of covered documents already, so both leave a margin to the good.
    """
    nearest = rows.filter(_all_hold(rule)).agg(
        *[F.min(F.get("features", f)).alias(f"c{k}") for k, (f, _, _) in enumerate(rule)]
    ).first()
    return [(f, upper, t if upper else (t + nearest[k]) / 2) for k, (f, upper, t) in enumerate(rule)]


def verdict(rules: list[list[tuple[int, bool, float]]], features: Column) -> Column:
    """The decision list as one conditional expression: false for the first rule that holds."""
    if not rules:
        return F.lit(True)
    out = F.when(_all_hold(rules[0], features), False)
    for rule in rules[1:]:
        out = out.when(_all_hold(rule, features), False)
    return out.otherwise(True)


def judgement(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Column:
    """A struct of the base statistics and ``kept`` for the text of the documents."""
    rules = learn(sample(docs, labels, size))

    def judged(s: Column) -> Column:
        kept = ~s["base_failed"] & verdict(rules, s["features"])
        return F.struct(*[s[m].alias(m) for m in MEASURES], kept.alias("kept"))

    return let(statistics(F.col("text")), judged)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of the registered query."""
    return docs.select("doc_id", judgement(docs, labels).alias("s")).select("doc_id", "s.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return docs.filter(judgement(docs, labels)["kept"])
