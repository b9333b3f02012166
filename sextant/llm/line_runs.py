"""Line dedup over levelled sorted runs of line hashes.

The corpus comes in batches. Each batch counts, for every line key, the documents that
hold it, merge-anti-joins the runs for keys that are known to be common already, and adds
what is left as a sorted run of its own. When a level holds ``FANOUT`` runs they are
merged into one run of the next level, where the counts of a key meet; so a key is
rewritten once a level, and there are only as many runs as levels times ``FANOUT``.

A run is a table of 128-bit hashes with document counts, bucketed and sorted by the hash in the
shared folder: runs are joined and merged bucket by bucket without a shuffle. A line that
stands in a third of all documents is one row a task before it is shuffled, and one row a
run; as soon as a run says that it is common, later batches leave it out.

A key is a line without blanks at its ends and with A-Z in lower case; empty keys are no keys.
Documents are told apart by ``doc_id``: rows that repeat one are one document, null ids are
one too, and lines of a document count once. Cases: a null or empty text is one empty line;
other columns are not read; an empty table gives no rows. ``keep_rare`` keeps all columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.session import shared_dir, store

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents that make a line common.
LEAST = 10
#: Batches that a table is dealt to, and runs of a level that are merged. Two runs meet in one
#: merge join of their buckets; a merge of more shuffles the joined ones again.
BATCHES, FANOUT = 8, 2
HASH = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """The keys of all lines of a text, in order."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """``(doc_id, h1, h2)``: the distinct line keys of each document."""
    keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: k != ""))
    return docs.select("doc_id", F.explode(F.transform(keys, _hashed)).alias("h")).select("doc_id", "h.*").distinct()


class LineRuns:
    """Levels of sorted runs ``(h1, h2, docs)`` in the shared folder.

    A run is written before it is listed, and merged runs are listed in place of their
    sources only when written, so a failed batch can be added again.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST, fanout: int = FANOUT) -> None:
        self.spark, self.least, self.fanout = spark, least, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, counted: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            counted.write.format("parquet")
            .bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", shared_dir(self.spark, "line-run"))
            .saveAsTable(name)
        )
        return name

    def add(self, batch: DataFrame) -> None:
        """Add a batch of ``(h1, h2)`` rows, one for each document of each key."""
        fresh = batch.groupBy(*HASH).agg(F.count("*").alias("docs"))
        for name in (n for level in self.levels for n in level):
            known = self.spark.table(name).filter(F.col("docs") >= self.least).select(*HASH)
            fresh = fresh.join(known.hint("merge"), HASH, "left_anti")
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _merged(self, names: list[str]) -> DataFrame:
        # a run holds a key once, so runs are merged by joins; a union of them is no hashed table
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("docs", "more")
            total = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            rows = rows.join(other, HASH, "full").select(*HASH, total.alias("docs"))
        return rows

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            runs = self.levels[level]
            if len(runs) < self.fanout:
                return
            merged = self._write(self._merged(runs))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self.levels[level] = []
            self._forget(runs)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def counts(self) -> DataFrame:
        """``(h1, h2, docs)`` of all runs; a common key's count is at least ``least``, not always exact."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long")
        return self._merged(names)

    def common(self) -> DataFrame:
        """``(h1, h2)`` of the keys found in at least ``least`` documents."""
        return self.counts().filter(F.col("docs") >= self.least).select(*HASH)


def common_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``(doc_id, common)``: the hashes of a document's lines that are common in the whole table."""
    of = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(batches)).cast("int")
    path = shared_dir(docs.sparkSession, "line-hashes")
    line_hashes(docs).withColumn("batch", of).write.partitionBy("batch").parquet(path)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long, batch int"
    lines = docs.sparkSession.read.schema(schema).parquet(path)
    runs = LineRuns(docs.sparkSession, least, fanout)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k).select(*HASH))
    common = store(runs.common(), "common-lines")
    return lines.join(common, HASH, "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct(*HASH)).alias("common"))


def keep_rare(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop all common lines; adds ``n_lines`` and ``n_dropped``, or replaces columns so called."""
    found = common_lines(docs, least, batches, fanout).select(F.col("doc_id").alias("__id"), F.col("common").alias("__common"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marked = docs.select(*columns).join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    hashes = F.when(F.col("__common").isNotNull(), F.transform(line_keys(F.col("text")), _hashed))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, dropped = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "__common", "__hashes")))
            for text, common, held in rows:
                lines = (text or "").split("\n")
                sizes.append(len(lines))
                if common:
                    gone = {(x["h1"], x["h2"]) for x in common}
                    lines = [x for x, h in zip(lines, held) if (h["h1"], h["h2"]) not in gone]
                dropped.append(sizes[-1] - len(lines))
                texts.append("\n".join(lines))
            made = {"text": pa.array(texts, pa.string())}
            values = [made.get(c, batch.column(c)) if c in made else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*values, pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())], [*columns, "n_lines", "n_dropped"]
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_lines long, n_dropped long"
    return marked.withColumn("__hashes", hashes).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The result of the registered query: lines, dropped lines and checksum of each document."""
    kept = keep_rare(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
