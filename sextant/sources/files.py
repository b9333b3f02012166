"""File scans: whole texts, CSV tables, JSON lines, gold sets and result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions.strings import strip
from sextant.operators.ranking import best_per_key
from sextant.schemas import GOLD_LINE, RESULT_LINE


def file_name(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per text or markdown file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_uri"),
        file_name(F.col("_metadata.file_path")).alias("file_name"),
        F.col("value").alias("text"),
    )


def _csv(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    reader = spark.read.options(header=True, inferSchema=False, encoding=encoding, multiLine=True, escape='"')
    return reader.csv(paths).withColumn("source", F.input_file_name())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as text columns with a ``source`` column.

    Files that are valid UTF-8 (a byte-order mark is dropped) are read as such, the
    others as GB18030. Files are read together where their header lines are equal, so that
    each keeps its own columns; a column that a file lacks is null. Encoding and header are
    found on the executors. Reading GB18030 needs
    ``spark.sql.legacy.javaCharsets``.
    """
    files = spark.read.format("binaryFile").load(path)
    named = files.select(
        "path",
        F.expr("is_valid_utf8(cast(content as string))").alias("utf8"),
        F.expr("hex(cast(split_part(cast(content as string), '\\n', 1) as binary))").alias("header"),
    )
    # a row a kind of file; the paths are those that the reader lists on the driver anyway
    kinds = named.groupBy("utf8", "header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("utf8", "header").collect()
    if any(not k["utf8"] for k in kinds):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    frames = [_csv(spark, k["paths"], "UTF-8" if k["utf8"] else "GB18030") for k in kinds]
    if not frames:
        raise ValueError(f"no CSV file at {path}")
    table = frames[0]
    for frame in frames[1:]:
        table = table.unionByName(frame, allowMissingColumns=True)
    return table


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(source, line_no, line)`` of text files, which are read split by split.

    The rows of a split stay in order in one task. Splits are counted, a prefix scan over the splits
    of a file gives the lines before each, and a row adds its place in its split. So a file of any
    size is read by many tasks, and only one row a split is shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("source", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("source", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    line_no = (F.col("place") + F.col("shift") + 1).alias("line_no")
    return lines.join(starts, ["source", "block"]).select("source", line_no, "line")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parsed JSON lines with file and line number; blank lines and # lines skipped.

    ``row`` is null for a line that is not a JSON object.
    """
    lines = numbered_lines(spark, path).withColumn("line", strip("line"))
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    is_object = F.col("line").startswith("{") & F.get_json_object("line", "$").isNotNull()
    return kept.select(
        "source", "line_no", "line", F.when(is_object, F.from_json("line", schema)).alias("row")
    )


def _first_text(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"row.{n}"), F.lit("")) for n in names], F.lit(""))


def _first_list(*names: str) -> Column:
    found = [F.when(F.size(F.col(f"row.relevant.{n}")) > 0, F.col(f"row.relevant.{n}")) for n in names]
    return F.array_distinct(F.coalesce(*found, F.array().cast("array<string>")))


def parse_gold(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold items with aliases and defaults applied, and the rejected lines."""
    parsed = lines.select(
        "source",
        "line_no",
        "line",
        strip(_first_text("id")).alias("query_id"),
        strip(_first_text("query")).alias("query"),
        strip(_first_text("tenantId", "tenant_id")).alias("tenant_id"),
        strip(_first_text("kbId", "kb_id")).alias("kb_id"),
        F.coalesce("row.answerable", F.lit(True)).alias("answerable"),
        _first_list("docIds", "doc_ids").alias("doc_ids"),
        _first_list("chunkIds", "chunk_ids").alias("chunk_ids"),
        _first_list("parentIds", "parent_ids").alias("parent_ids"),
        F.coalesce(
            F.when(F.size("row.metadataFilter") > 0, F.col("row.metadataFilter")),
            F.col("row.metadata_filter"),
            F.create_map().cast("map<string,string>"),
        ).alias("metadata_filter"),
        F.coalesce("row.tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("row.notes", F.lit("")).alias("notes"),
    )
    complete = (
        (F.col("query_id") != "") & (F.col("query") != "") & (F.col("tenant_id") != "") & (F.col("kb_id") != "")
    )
    return parsed.filter(complete).drop("source", "line_no", "line"), parsed.filter(~complete).select(
        "source", "line_no", "line"
    )


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_gold(read_json_lines(spark, path, GOLD_LINE))


def parse_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result sets by query, the last line of an id winning, and the rejected lines."""
    parsed = lines.withColumn("query_id", strip(_first_text("id", "queryId", "query_id")))
    good = parsed.filter("query_id <> ''").select(
        "query_id",
        "source",
        "line_no",
        F.coalesce("row.error", F.lit("")).alias("error"),
        F.coalesce("row.hits", F.array()).alias("hits"),
    )
    last = best_per_key(good, ["query_id"], [-F.col("line_no")]).select("query_id", "error", "hits")
    return last, parsed.filter("query_id = ''").select("source", "line_no", "line")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_results(read_json_lines(spark, path, RESULT_LINE))
