"""Spelling variants: words of the corpus that differ by one letter, grouped by a frequent form.

Every pair of near words is found by bidirectional FM-index searches (``fm_index``). The
vocabulary is dealt to shards so that a word meets only words that can be near: its error
lies in one half or the other, so near words share the other half exactly and meet under
the key of that half. A word stands in the index under its halves as a word of its own
length, one less and one more, and is searched under its own two. A key that more than
``LIMIT`` words share is refined: the window of the error is halved again, and words share what
lies around it. So a beginning that a third of all words share is spread over keys that
say more of the word, down to windows of one letter, and no shard grows with a hot key.
Each shard gives one row a searched word, not one a pair.

Words are counted before they are shuffled. The chains of forms are short: each form is
``FORM_TIMES`` times as frequent as its variant, and a few doublings reach their ends.

Cases: a null text has no words; a null id counts as an empty one; repeated rows count
again; only ``doc_id`` and ``text`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.fm_index import FmIndex
from sextant.session import store

# --- fixed values: what a word is, and which runs lose a code point ---
RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES_ONE_OF = 31
LEAST_CHARS, LEAST_TIMES, FORM_TIMES = 7, 2, 10

#: Rows of a shard, and words of a key that are not refined.
SHARD, LIMIT = 16_384, 8_192


def vocabulary(docs: DataFrame, chars: int = LEAST_CHARS, times: int = LEAST_TIMES) -> DataFrame:
    """``(word, n)`` of all words that are long and frequent enough."""
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{chars},}}"), F.lit(0))
    lowered = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = lowered.select(F.when(h % LOSES_ONE_OF == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of what a word must share: ``first`` letters at its beginning and ``rest`` at its end."""
    rest = F.col("length") - F.col("last")
    size = F.length("word")
    parts = [F.substring("word", F.lit(1), F.col("first")), F.substring("word", size - rest + 1, rest)]
    return rows.withColumn("key", F.xxhash64("first", rest, *parts))


def windows(words: DataFrame, chars: int = LEAST_CHARS) -> DataFrame:
    """``(word, n, length, first, last, key)``: each word under both halves of each length near its own.

    ``length`` is that of the words it may be near to; the error lies in ``[first, last)`` of them.
    """
    length = F.explode(F.sequence(F.greatest(F.length("word") - 1, F.lit(chars)), F.length("word") + 1))
    lengths = words.select("word", "n", length.alias("length"))
    middle = F.floor(F.col("length") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("first"), middle.alias("last")), F.struct(middle.alias("first"), F.col("length").alias("last"))
    )
    return _keyed(lengths.select("word", "n", "length", F.explode(halves).alias("w")).select("word", "n", "length", "w.*"))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    halves = F.array(
        F.struct("first", middle.alias("last")), F.struct(middle.alias("first"), F.col("last").alias("last"))
    )
    return _keyed(rows.select("word", "n", "length", F.explode(halves).alias("w")).select("word", "n", "length", "w.*"))


def refined(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Halve the windows of keys that more than ``limit`` rows share until none does, or they are one letter."""
    done, wide = [], F.col("last") - F.col("first") > 1
    while True:
        hot = store(rows.filter(wide).groupBy("key").agg(F.count("*").alias("times")).filter(F.col("times") > limit).select("key"), "hot-halves")
        if hot.isEmpty():
            done.append(rows)
            break
        marked = rows.join(hot.withColumn("hot", F.lit(True)), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)) & wide)
        done.append(marked.filter(~F.col("hot")).drop("hot").select(*rows.columns))
        rows = store(_halved(marked.filter("hot")).select(*rows.columns), "finer-halves")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def _shard(table: pa.Table) -> pa.Table:
    """Search the rows of a word's own length in the index of all words of the shard."""
    words = table["word"].to_pylist()
    index = FmIndex(list(set(words)))
    place = {w: k for k, w in enumerate(index.words)}
    number = np.array([place[w] for w in words], np.int64)
    times = np.zeros(len(index.words), np.int64)
    times[number] = table["n"].to_numpy()
    first, last, length = (table[c].to_numpy().astype(np.int64) for c in ("first", "last", "length"))
    asked = np.flatnonzero(length == index.lengths[number])
    q, x = index.near(number[asked], first[asked], last[asked])
    word = number[asked][q]
    order = np.lexsort((x, -times[x], word))
    word, x = word[order], x[order]
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
    columns = {
        "word": pa.array([index.words[k] for k in word[start]], pa.string()),
        "n_near": pa.array(np.diff(np.append(start, len(word))), pa.int64()),
        "form": pa.array([index.words[k] for k in x[start]], pa.string()),
        "form_n": pa.array(times[x[start]], pa.int64()),
    }
    return pa.table(columns)


def near_words(words: DataFrame, chars: int = LEAST_CHARS, shard: int = SHARD, limit: int = LIMIT) -> DataFrame:
    """``(word, n_near, form, form_n)`` of words with near words: how many, and the most frequent one.

    ``words`` are distinct ``(word, n)`` of at least ``chars`` letters. Ties go to the first word by code points.
    """
    rows = store(refined(windows(words, chars), limit), "word-halves")
    shards = rows.count() // shard + 1
    dealt = rows.select("word", "n", "length", "first", "last", F.pmod("key", F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInArrow(_shard, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form")).alias("best")
    whole = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return whole.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n"))


def _roots(linked: DataFrame, ratio: int) -> DataFrame:
    """``(word, root)``: the last word that the forms lead to, by doubling the steps.

    Counts are below 2^63 and each step multiplies them by ``ratio`` at least, which bounds the steps.
    """
    steps = linked.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(63 / math.log2(ratio)))):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = store(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return steps


def variants(docs: DataFrame, chars: int = LEAST_CHARS, times: int = LEAST_TIMES, ratio: int = FORM_TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words of the corpus; ``ratio`` is at least two."""
    words = store(vocabulary(docs, chars, times), "words")
    near = near_words(words, chars)
    is_form = F.col("form_n") >= F.col("n") * ratio
    judged = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    judged = store(judged, "variants")
    roots = _roots(judged.filter(F.col("form").isNotNull()), ratio)
    root = F.coalesce("root", "word").alias("root")
    return judged.join(roots, "word", "left").select("word", "form", root, "n", "n_near", "form_n")
