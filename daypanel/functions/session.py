"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from the files.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a scratch folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="daypanel-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
