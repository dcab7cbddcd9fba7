"""Reading and writing predictions, folds, feature blocks and run records."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION = "user_id bigint, predict double"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor of a cluster can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="daypanel-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("user_id", "predict").write.option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PREDICTION).csv(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet split by a few low-cardinality columns, so that readers prune whole folders.

    Rows keep their spread over tasks: one value (a fold, an anchor) may hold most of the table.
    """
    df.write.partitionBy(*columns).parquet(path)


def save_panel(panel: DataFrame, table: str, buckets: int) -> None:
    """Keep a daily panel bucketed by user: operators that read the table back need no shuffle at all."""
    panel.write.mode("overwrite").bucketBy(buckets, "user_id").sortBy("user_id", "day").saveAsTable(table)


def _block_path(path: str, block: str, floor_days: int | None, population: str) -> str:
    return f"{path}/block={block}/floor={floor_days or 0}/population={population}"


def store_block(df: DataFrame, path: str, block: str, floor_days: int | None = None, population: str = "recent") -> None:
    """Keep a feature block per anchor, so that later runs read it instead of computing it.

    The key is block, history floor, population and anchor; anchors stored before are replaced.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("anchor").parquet(_block_path(path, block, floor_days, population))


def read_blocks(spark: SparkSession, path: str, blocks: list[str], anchors: list[int], columns: list[str],
                floor_days: int | None = None, population: str = "recent") -> DataFrame:
    """Chosen columns of chosen blocks and anchors, joined on the keys."""
    parts = []
    for b in blocks:
        part = spark.read.parquet(_block_path(path, b, floor_days, population)).filter(F.col("anchor").isin(anchors))
        parts.append(part.select("anchor", "user_id", *[c for c in columns if c in part.columns]))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, ["anchor", "user_id"])
    return out


def stored_anchors(spark: SparkSession, table: str) -> set[int]:
    """Anchors that a feature table holds, read from the catalog alone."""
    if not spark.catalog.tableExists(table):
        return set()
    return {int(r["partition"].partition("=")[2]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}


def store_missing(spark: SparkSession, table: str, anchors: list[int], make: Callable[[list[int]], DataFrame],
                  buckets: int, path: str | None = None) -> list[int]:
    """Add to a feature table the anchors it does not hold yet, and return them.

    ``make`` builds the rows (anchor, user_id, …) of the anchors it is given and is not called when none is missing. One
    table holds one block, floor and population. It is partitioned by anchor and bucketed by user, so tables of several blocks
    meet without a shuffle. A write that fails adds no anchor, and the next call computes it again. ``path`` puts a new
    table elsewhere than the warehouse.
    """
    held = stored_anchors(spark, table)
    missing = [a for a in dict.fromkeys(anchors) if a not in held]
    if missing:
        # One task per bucket, so that an anchor has as many files as buckets.
        writer = make(missing).repartition(buckets, "user_id").write.mode("append").format("parquet")
        writer = writer.partitionBy("anchor").bucketBy(buckets, "user_id").sortBy("user_id")
        (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return missing


def read_stored(spark: SparkSession, stored: list[str], anchors: list[int], columns: list[str]) -> DataFrame:
    """Chosen columns and anchors of feature tables with equal buckets, joined in place.

    ``spark.sql.requireAllClusterKeysForCoPartition=false`` lets Spark see that buckets by user suffice for (anchor, user).
    """
    out = None
    for table in stored:
        part = spark.table(table).filter(F.col("anchor").isin(anchors))
        part = part.select("anchor", "user_id", *[c for c in columns if c in part.columns])
        out = part if out is None else out.join(part, ["anchor", "user_id"])
    return out


def merge_records(old: DataFrame, new: DataFrame, kept: tuple[str, ...] = ("lb", "verdict")) -> DataFrame:
    """New records win by ``exp_id``; hand-entered fields survive where the new record leaves them empty."""
    columns = [c for c in new.columns if c != "exp_id"]
    present = F.col("n._new")
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), "exp_id", "full_outer")
    picked = []
    for c in columns:
        mine = F.col(f"n.{c}")
        if c in kept:
            mine = F.coalesce(F.nullif(mine, F.lit("")), F.nullif(F.col(f"o.{c}"), F.lit("")), F.lit(""))
        picked.append(F.when(present, mine).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select("exp_id", *picked)


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """Row count and a sum of row hashes: equal for equal content in any order or file layout.

    A null is written as a mark of its own, so it is no empty value and shifts no column.
    """
    text = F.concat_ws(",", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])
    value = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).cast("string").alias("content"))
