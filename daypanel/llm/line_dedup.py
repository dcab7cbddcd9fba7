"""Lines that many documents share, found with levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; empty keys are never
dropped. Keys are held as two 64-bit hashes. :class:`LineRuns` is the store: every batch of documents is one
run, a Parquet folder of (hash, number of documents) sorted by hash. A new batch is anti-joined with the keys
that the runs already hold as common, and the rest becomes its run; ``fanout`` runs of a level are merged into
one run of the next level, so a key is rewritten once per level. A key is common when the counts of all runs
add up to ``threshold``.

Null texts are one empty line, as empty texts are. A line that repeats inside a document counts once, and
so do rows that repeat a doc_id. Empty tables give empty results. Only DataFrame functions are
used; frequent lines are added up before every shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from ..sources.tables import scratch

THRESHOLD = 10
FANOUT = 2
BATCHES = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z in lower case.

    ``lower`` changes other letters too, so it serves lines of ASCII only; it is much the faster one.
    """
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


class LineRuns:
    """Runs of (h1, h2, n_docs) by level in ``folder``; ``levels[k]`` lists the paths of level k."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, threshold: int = THRESHOLD):
        self.spark, self.folder, self.fanout, self.threshold = spark, folder, fanout, threshold
        self.levels: list[list[str]] = [[]]
        self._written = 0

    def _write(self, entries: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}/run-{self._written}"
        self._written += 1
        entries.repartition("h1").sortWithinPartitions(*_HASH).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        schema = "h1 bigint, h2 bigint, n_docs bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def add(self, batch: DataFrame) -> None:
        """Add the (h1, h2, n_docs) of a batch as a run and merge the levels that are full."""
        runs = [p for level in self.levels for p in level]
        if runs:
            known = self._read(runs).filter(F.col("n_docs") >= self.threshold).select(*_HASH).distinct()
            batch = batch.join(known, _HASH, "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._read(self.levels[level]).groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"))
            self.levels[level] = []
            self._write(merged, level + 1)
            level += 1

    def common(self) -> DataFrame:
        """(h1, h2) of the keys found in at least ``threshold`` documents."""
        runs = self._read([p for level in self.levels for p in level])
        counted = runs.groupBy(*_HASH).agg(F.sum("n_docs").alias("n_docs"))
        return counted.filter(F.col("n_docs") >= self.threshold).select(*_HASH)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, batch, pos, h1, h2) of every line whose key is not empty."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = docs.select("doc_id", text_hash.alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).filter("key != ''")
    return keyed.select(
        "doc_id", "text_hash", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int").alias("batch"), "pos",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(_LOWER), "key").alias("h2"),
    )


def document_counts(lines: DataFrame) -> DataFrame:
    """(batch, h1, h2, n_docs): each document counts once for each of its keys."""
    once = lines.select("doc_id", "batch", *_HASH).distinct()
    return once.groupBy("batch", *_HASH).agg(F.count(F.lit(1)).alias("n_docs"))


def without_common_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without the lines that are common."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    hashed = cut(hashed_lines(docs))
    counts = cut(document_counts(hashed))
    runs = LineRuns(spark, scratch(spark, "line-runs"), threshold=threshold)
    for b in range(BATCHES):
        runs.add(counts.filter(F.col("batch") == b).drop("batch"))
    common = cut(runs.common())

    found = hashed.join(common, _HASH, "left_semi")
    drops = found.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops")).alias("x")
    lines = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), text_lines(F.col("text")).alias("lines")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.text_hash") == F.col("x.text_hash"))
    joined = lines.join(drops, same, "left").select("d.doc_id", "lines", F.coalesce("drops", F.array().cast("array<int>")).alias("drops"))
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drops"))
    return joined.select(
        "doc_id", n.cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"),
        F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n").alias("kept"),
    )
