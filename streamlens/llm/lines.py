"""Line deduplication over levelled, sorted runs of line hashes.

``LineRuns`` holds the hashes of all lines seen so far, each with the document that owns the
line, as runs: Parquet tables sorted by hash, with no hash in two of them. ``absorb`` takes a
batch of documents, merge-anti-joins its line hashes with the runs, writes what is new as a run
of level 0, and says which lines of the batch belong to an earlier owner. When a level has
``fanout`` runs, they are merged into one of the next level.

``dedup_lines`` feeds a table in batches of ascending doc_id, so the owner of a line is the
smallest doc_id that holds it. A line's key is the line without ASCII white space at its ends and
with A-Z in lower case; keys under ten code points are left alone. Keys are compared by 128 bits.

A line that a third of all documents share is one hash with very many rows: owners are
pre-aggregated before the shuffle, and rows meet owners in a join of two plain exchanges, whose
large partitions Spark splits by itself.

Defined results: a null or empty text is one empty line and stays (as an empty text). Rows that
share a doc_id are one document. A null doc_id counts as the smallest. An empty table gives an
empty table. Other columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamlens.checkpoints import fresh_path
from streamlens.llm.common import NO_ID, SPACES, ascii_lower, free_name, stored

MIN_CHARS = 10
KEYS = ["_k1", "_k2"]
OWNER_SCHEMA = "_k1 long, _k2 long, _owner long"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The runs of line hashes in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.path = path or fresh_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def owners(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], OWNER_SCHEMA)
        return self.spark.read.schema(OWNER_SCHEMA).parquet(*paths)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/run-{self.written}"
        self.written += 1
        rows.repartition(*KEYS).sortWithinPartitions(*KEYS).write.parquet(path)
        return path

    def absorb(self, lines: DataFrame) -> None:
        """Add the hashes of a batch (``_k1, _k2, _id``) that no run has."""
        first = lines.groupBy(*KEYS).agg(F.min("_id").alias("_owner"))
        if self.written:
            first = first.join(self.owners().hint("merge"), KEYS, "left_anti")
        self.levels[0].append(self._write(first))
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                continue
            merged = self._write(self.spark.read.schema(OWNER_SCHEMA).parquet(*level))
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k] = []
            self.levels[k + 1].append(merged)
            return self._compact()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line that can be dropped: ids of the row and the place and hash of the line."""
    placed = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"),
        F.xxhash64("text").alias("_text"),
        F.posexplode(_lines(F.col("text"))).alias("_at", "_line"),
    )
    keyed = placed.select("_id", "_text", "_at", ascii_lower(F.btrim("_line", F.lit(SPACES))).alias("_key"))
    return keyed.filter(F.length("_key") >= min_chars).select(
        "_id", "_text", "_at", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(1), "_key").alias("_k2")
    )


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with shortened texts, and ``n_lines`` and ``n_dropped`` in a struct as its last column.

    The struct is called ``_lines``, with more underscores before it where a column has that name.
    """
    spark = docs.sparkSession
    cuts = docs.select(
        F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("cuts")
    ).first()["cuts"]
    batch = sum(((F.col("_id") > c).cast("int") for c in sorted(set(cuts or []))), F.lit(0))
    hashed = stored(line_hashes(docs, min_chars).withColumn("_batch", batch), "lines", "_batch")
    runs = LineRuns(spark, fanout=fanout)
    for k in range(len(set(cuts or [])) + 1):
        runs.absorb(hashed.filter(F.col("_batch") == k).select("_id", *KEYS))
    lost = (
        hashed.join(runs.owners().hint("merge"), KEYS)
        .filter("_owner < _id")
        .groupBy("_id", "_text")
        .agg(F.collect_set("_at").alias("_lost"))
    )
    source = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"),
        F.xxhash64("text").alias("_text"),
    )
    joined = source.join(lost, ["_id", "_text"], "left")
    lines = _lines(F.col("_row.text"))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(
        F.transform(F.array_except(every, F.col("_lost")), lambda i: F.get(lines, i)), "\n"
    )
    text = F.when(F.col("_lost").isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns],
        F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
        ).alias(free_name("_lines", docs.columns)),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of lines and a digest of what is kept."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))
