"""Fusing result lists, merging search channels and expanding children to parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.functions import lexical as L
from sextant.functions import questions as Q
from sextant.functions.metadata import BOOST_FIELDS, metadata_boost
from sextant.functions.strings import normalize_query
from sextant.operators.ranking import best_per_key, min_max_over, top_per_group
from sextant.session import store
from sextant.settings import DEFAULTS, Settings

KEY = ["query_id", "tenant_id", "kb_id"]


def rank_variants(hits: DataFrame) -> DataFrame:
    """1-based rank of a hit in the result list of its query variant."""
    order = W.partitionBy(*KEY, "variant_index").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return hits.withColumn("variant_rank", F.row_number().over(order))


def fuse_variants(ranked: DataFrame, windows: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Sum of score and reciprocal rank over the variants that found a chunk.

    ``windows`` (query scope, window) says how many fused chunks a query keeps.
    """
    fused = ranked.groupBy(*KEY, "chunk_id").agg(
        F.round(F.sum(F.col("score") + F.lit(1.0) / (F.col("variant_rank") + 60.0)), 9).alias("score"),
        F.count_distinct("variant").alias("variant_count"),
        F.min_by("variant_index", F.struct(-F.col("score"), F.col("variant_index"))).alias("best_variant"),
    )
    order = [F.col("score").desc(), F.col("chunk_id")]
    return top_per_group(fused.join(windows, KEY), KEY, order, F.col("window"), bound=settings.candidate_bound).drop("window")


def dense_phrases(query) -> Column:
    """Blank-free phrases of a question, long enough to be worth a boost."""
    return F.filter(F.transform(L.phrase_terms(query), normalize_query), lambda p: F.length(p) >= 4)


def exact_phrase_boost(phrases: Column, names: list[Column], text: Column) -> Column:
    """0.65 or 0.35 for the longest question phrase found in names or text, blanks ignored."""
    haystack = normalize_query(
        F.concat_ws("\n", *[F.coalesce(n, F.lit("")) for n in names], F.coalesce(text, F.lit("")))
    )

    def best(hay: Column) -> Column:
        found = F.filter(phrases, lambda p: F.contains(hay, p))
        return F.coalesce(
            F.array_max(F.transform(found, lambda p: F.when(F.length(p) >= 8, F.lit(0.65)).otherwise(F.lit(0.35)))),
            F.lit(0.0),
        )

    return F.element_at(F.transform(F.array(haystack), best), 1)


def channel_bonus(variant_count: Column, in_both: Column) -> Column:
    return F.least(variant_count, F.lit(3)) * F.lit(0.015) + F.when(in_both, F.lit(0.04)).otherwise(F.lit(0.0))


def merge_channels(
    vector: DataFrame, keyword: DataFrame, queries: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS,
) -> DataFrame:
    """Outer-join the two channels and score each chunk by the query's mode.

    Both inputs: query scope, chunk_id, score, variant_count. ``queries`` adds query, mode
    and top_k. Hybrid scores weigh the normalised channels and add the boosts; the other
    modes use their single channel alone. Text joins in for the merged candidates only.
    """
    def normalised(hits: DataFrame, name: str) -> DataFrame:
        return hits.select(
            *KEY, "chunk_id",
            min_max_over(F.col("score"), KEY).alias(f"{name}_score"),
            F.col("variant_count").alias(f"{name}_variants"),
        )

    merged = normalised(vector, "vector").join(normalised(keyword, "keyword"), [*KEY, "chunk_id"], "full_outer")
    # stored, so that its size is known and the texts need no shuffle for a small one
    merged = store(merged, "merged-channels")
    # phrases are made once per query, not once per candidate
    asked = queries.select(*KEY, "mode", "top_k", dense_phrases("query").alias("phrases"))
    rows = merged.join(
        chunks.select(
            "tenant_id", "kb_id", "chunk_id", "doc_id", "parent_id", "file_name", "page", "metadata", "text"
        ),
        ["tenant_id", "kb_id", "chunk_id"],
    ).join(asked, KEY)
    v, k = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("keyword_score", F.lit(0.0))
    field = {
        "file_name": F.col("file_name"),
        "page": F.col("page").cast("string"),
        **{n: F.col("metadata")[n] for n in BOOST_FIELDS if n not in ("file_name", "page")},
    }
    names = [field[n] for n in ("file_name", "section_title", "section_path", "keywords")]
    boosts = channel_bonus(
        F.coalesce("vector_variants", "keyword_variants", F.lit(0)),
        F.col("vector_score").isNotNull() & F.col("keyword_score").isNotNull(),
    ) + exact_phrase_boost(F.col("phrases"), names, F.col("text"))
    if settings.metadata_boost_enabled:
        boosts = boosts + metadata_boost([field[n] for n in BOOST_FIELDS], settings.metadata_boost_weight)
    # only the sum of floats is rounded here: a rounded normal score could round another way when it is shown
    combined = (
        F.when(F.col("mode") == "vector", v)
        .when(F.col("mode") == "keyword", k)
        .otherwise(F.round(v * settings.vector_weight + k * settings.keyword_weight + boosts, 9))
    )
    scored = rows.select(
        *KEY, "chunk_id", "doc_id", "parent_id", "top_k", "vector_score", "keyword_score", combined.alias("score"),
    )
    kept = top_per_group(
        scored, KEY, [F.col("score").desc(), F.col("chunk_id")], Q.candidate_window("top_k", settings),
        bound=settings.candidate_bound,
    )
    return kept.drop("top_k")


def dedupe_hits(hits: DataFrame, limit, keys=("query_id",), bound: int | None = None) -> DataFrame:
    """Best row of each chunk, then the best ``limit`` chunks of a query."""
    best = best_per_key(hits, [*keys, "chunk_id"], [-F.col("score")])
    return top_per_group(best, list(keys), [F.col("score").desc(), F.col("chunk_id")], limit, bound=bound)


def with_channel_fallback(queries: DataFrame, vector: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Warnings of queries whose vector channel is unavailable; those run keyword-only.

    ``reasons`` (scope, reason) lists the scopes without a usable vector table.
    """
    warning = F.concat(
        F.lit("Vector retrieval is unavailable; keyword-only fallback was used. Reason: "), F.col("reason")
    )
    if reasons is None:
        answered = vector.select("tenant_id", "kb_id").distinct().withColumn("__ok", F.lit(True))
        joined = queries.join(answered, ["tenant_id", "kb_id"], "left").withColumn(
            "reason", F.when(F.col("__ok").isNull(), F.lit("no vector table"))
        ).drop("__ok")
    else:
        joined = queries.join(reasons, ["tenant_id", "kb_id"], "left")
    asks_vectors = F.col("mode").isin("hybrid", "vector")
    return joined.withColumn(
        "warnings",
        F.when(asks_vectors & F.col("reason").isNotNull(), F.array(warning)).otherwise(
            F.array().cast("array<string>")
        ),
    ).drop("reason")


def distinct_warnings(rows: DataFrame, keys=("query_id",)) -> DataFrame:
    """Distinct non-empty warnings of a query."""
    flat = rows.select(*keys, F.explode_outer("warnings").alias("w"))
    return flat.groupBy(*keys).agg(F.sort_array(F.collect_set(F.when(F.col("w") != "", F.col("w")))).alias("warnings"))


# --- parents ---


def best_children(child_hits: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Best child hit of each parent, for the best parents of a query."""
    with_parent = child_hits.filter(F.coalesce("parent_id", F.lit("")) != "")
    best = with_parent.groupBy(*KEY, "parent_id").agg(
        F.min_by(
            F.struct("chunk_id", "score", "vector_score", "keyword_score"),
            F.struct(-F.col("score"), F.col("chunk_id")),
        ).alias("s")
    )
    flat = best.select(
        *KEY, "parent_id",
        F.col("s.chunk_id").alias("seed_id"),
        F.col("s.score").alias("seed_score"),
        F.col("s.vector_score").alias("seed_vector_score"),
        F.col("s.keyword_score").alias("seed_keyword_score"),
    ).join(queries.select(*KEY, "top_k"), KEY)
    return top_per_group(
        flat, KEY, [F.col("seed_score").desc(), F.col("parent_id")], Q.parent_window("top_k", settings),
        bound=settings.parent_bound,
    ).drop("top_k")


def children_of(parents: DataFrame, chunks: DataFrame, per_parent: int) -> DataFrame:
    """First children of each wanted parent by chunk index.

    ``parents`` has the scope and parent_id (repeats allowed); a parent is read once.
    """
    wanted = parents.select("tenant_id", "kb_id", "parent_id").distinct()
    kids = chunks.filter(F.col("chunk_type") == "child").select(
        "tenant_id", "kb_id", "parent_id", "chunk_id", "chunk_index", "child_index", "text"
    )
    return top_per_group(
        kids.join(wanted, ["tenant_id", "kb_id", "parent_id"]),
        ["tenant_id", "kb_id", "parent_id"],
        [F.col("chunk_index"), F.col("chunk_id")],
        per_parent,
    )


def parents_by_id(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parent rows of the wanted (scope, parent_id) pairs."""
    ids = wanted.select("tenant_id", "kb_id", "parent_id").distinct()
    return chunks.filter(F.col("chunk_type") == "parent").join(ids, ["tenant_id", "kb_id", "parent_id"], "left_semi")


def parents_by_document(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parent rows of the wanted (scope, doc_id) pairs."""
    docs = wanted.select("tenant_id", "kb_id", "doc_id").distinct()
    return chunks.filter(F.col("chunk_type") == "parent").join(docs, ["tenant_id", "kb_id", "doc_id"], "left_semi")


def stale_hits(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose parent has no child row any more: the audit list."""
    live = chunks.filter(F.col("chunk_type") == "child").select("tenant_id", "kb_id", "parent_id")
    return seeds.join(live, ["tenant_id", "kb_id", "parent_id"], "left_anti")


def expand_to_parents(
    child_hits: DataFrame, queries: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Replace child hits by the best children of their parents, with the parent's text.

    ``queries``: scope, retrieval_query, top_k. A seed stands first, then the children
    that match the question best, then the earlier ones. A seed without child rows is
    stale and drops out of the join.
    """
    per_parent = settings.child_chunks_per_parent
    seeds = best_children(child_hits, queries, settings)
    kids = children_of(seeds, chunks, per_parent * 4).select(
        "tenant_id", "kb_id", "parent_id", "chunk_id", "chunk_index", "child_index",
        F.lower("text").alias("lowered"), L.tokenize("text").alias("tokens"),
    )
    terms = queries.select(*KEY, "top_k", L.tokenize("retrieval_query").alias("terms"))
    paired = (
        seeds.join(kids, ["tenant_id", "kb_id", "parent_id"])
        .join(terms, KEY)
        .withColumn("kw", L.score_tokens(F.col("terms"), F.col("tokens"), F.col("lowered")))
        .withColumn("is_seed", F.col("chunk_id") == F.col("seed_id"))
        .drop("lowered", "tokens", "terms")
    )
    picked = top_per_group(
        paired,
        [*KEY, "parent_id"],
        [F.col("is_seed").desc(), F.col("kw").desc(), F.coalesce("child_index", F.lit(0)).asc(), F.col("chunk_id")],
        per_parent,
    )
    scored = picked.select(
        *KEY, "chunk_id", "parent_id", "child_index", "chunk_index", "top_k",
        F.round(F.col("seed_score") + F.least("kw", F.lit(1.0)) * 0.05, 9).alias("score"),
        F.when(F.col("is_seed"), F.col("seed_vector_score")).alias("vector_score"),
        F.col("seed_keyword_score").alias("keyword_score"),
        F.col("seed_id").alias("matched_child_id"),
        F.col("seed_score").alias("parent_score"),
    )
    limit = Q.parent_window("top_k", settings) * max(per_parent, 1)
    return dedupe_hits(scored, limit, KEY, bound=settings.parent_bound * max(per_parent, 1)).drop("top_k")


def attach_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join the text, names and parent text of a bounded set of hits.

    The hits are stored, so that their size is known; the parents are cut to theirs before the join.
    """
    hits = store(hits, "hits")
    details = chunks.select(
        "tenant_id", "kb_id", "chunk_id", "doc_id", "text", "file_name", "source_uri", "page", "metadata"
    )
    parents = chunks.filter(F.col("chunk_type") == "parent").select(
        "tenant_id", "kb_id", "parent_id", F.col("text").alias("parent_text")
    )
    parents = parents.join(hits.select("tenant_id", "kb_id", "parent_id"), ["tenant_id", "kb_id", "parent_id"], "left_semi")
    return (
        hits.join(details, ["tenant_id", "kb_id", "chunk_id"])
        .join(parents, ["tenant_id", "kb_id", "parent_id"], "left")
        .withColumn("parent_text", F.coalesce("parent_text", F.lit("")))
    )
