"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, source mix, shards.

Every stage reads what the stage before kept and applies its decisions: toxic documents, all but one document
of each group of near-duplicates, and documents that hold benchmark passages go; the rest is written in the
order of the source mix; the last stage adds each document's shard and its slot in it, which follows the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daypanel.llm import decontaminate, mixing, near_docs, sharding, toxicity
from daypanel.sources.tables import scratch

# Target weights of the sources; None makes them proportional to the square root of a source's documents.
MIX_WEIGHTS: dict[str, float] | None = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def string_kernel_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def order_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_docs.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pfair_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the mix of sources is read."""
    return mixing.in_mix_order(docs, MIX_WEIGHTS)


def bounded_ring_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard`` and ``slot``; the slots of a shard are in the order of the mix.

    Files promise no order, so that of the mix is worked out again from the same rows.
    """
    return sharding.with_shards(docs, order=mixing.mixed(docs, MIX_WEIGHTS))


STAGES: list[tuple[str, Stage]] = [
    ("string_kernel_toxicity", string_kernel_toxicity),
    ("order_minhash", order_minhash),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pfair_mixing", pfair_mixing),
    ("bounded_ring_shards", bounded_ring_shards),
]

# The kernel model, the alignments and the ring's hash have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet beside the checkpoints and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
