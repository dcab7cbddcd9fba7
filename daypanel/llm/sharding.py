"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. A shard stands at ``NODES`` of them, a row at the cell of its hashed key, and a
row belongs to the first node clockwise. No shard takes more rows than its bound; with no slack the bounds
are the row count divided evenly, so that counts differ by one at most. What a full shard cannot take goes on
clockwise, node by node, the last rows of an arc first. Whoever adds a shard or rows moves the rows of the
new arcs and what flows over, and nothing else.

Which rows flow where depends on counts per cell only. These (``CELLS`` numbers at most, whatever the data)
are carried round the ring in one small loop; rows are ranked inside their cell by range partitioning, so a
cell that one repeated key fills is spread over tasks, and looked up in the plan of at most ``CELLS`` + nodes
x overflow steps rows.

Null keys have a place on the ring like any other value. Null texts count no bytes. Rows that repeat are rows
of their own. An empty table gives an empty result. Columns beside the key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ordinal_positions
from ..functions.session import cut

SHARDS = 40
NODES = 64
CELLS = 1 << 16
ROW_BYTES = 16


def node_cells(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all virtual nodes in clockwise order, and their shards; one shard's places never change."""
    cells, owners = [], []
    for shard in range(shards):
        cells.append(np.random.default_rng([shard, 77]).integers(0, CELLS, nodes))
        owners.append(np.full(nodes, shard))
    cells, owners = np.concatenate(cells), np.concatenate(owners)
    order = np.lexsort((owners, cells))
    return cells[order], owners[order]


def bounds(rows: int, shards: int, slack: float) -> np.ndarray:
    """Most rows per shard: even shares that add up to ``rows``, or (1 + slack) times the mean."""
    if slack > 0:
        return np.full(shards, int(np.ceil((1 + slack) * rows / shards)))
    return rows // shards + (np.arange(shards) < rows % shards)


def flow(counts: np.ndarray, shards: int, nodes: int = NODES, slack: float = 0.0) -> pd.DataFrame:
    """(cell, first, last, shard, slot): ranks ``first``..``last`` (from 1) of a cell get slots from ``slot`` on."""
    at, owner = node_cells(shards, nodes)
    arc = np.searchsorted(at, np.arange(CELLS)) % len(at)
    # Cells of an arc in clockwise order: those after the last node come first in the arc of the first one.
    clockwise = np.lexsort((np.arange(CELLS) <= at[-1], arc))
    room, used = bounds(int(counts.sum()), shards, slack), np.zeros(shards, np.int64)
    left = np.bincount(arc, counts, len(at)).astype(np.int64)
    taken = [[] for _ in at]  # per arc: (rows, shard, slot) in rank order
    step, waiting = 0, np.flatnonzero(left)
    while len(waiting):
        for a in waiting:
            shard = owner[(a + step) % len(at)]
            rows = min(left[a], room[shard] - used[shard])
            if rows > 0:
                taken[a].append((rows, shard, used[shard]))
                used[shard] += rows
                left[a] -= rows
        step, waiting = step + 1, waiting[left[waiting] > 0]
    plan = []
    queues = [iter(t) for t in taken]
    open_part = [next(q, None) for q in queues]
    for cell in clockwise:
        rank, a = 1, arc[cell]
        while rank <= counts[cell]:
            rows, shard, slot = open_part[a]
            n = min(rows, counts[cell] - rank + 1)
            plan.append((cell, rank, rank + n - 1, shard, slot))
            rank += n
            open_part[a] = (rows - n, shard, slot + n) if rows > n else next(queues[a], None)
    return pd.DataFrame(plan, columns=["cell", "first", "last", "shard", "base"], dtype="int64")


def sharded(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0) -> DataFrame:
    """(doc_id, text_hash, size, text_crc32, shard, slot) per row of ``docs``; slots count from 0 in a shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(CELLS), "doc_id").alias("place"),
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("cell", F.shiftrightunsigned("place", 64 - CELLS.bit_length() + 1).cast("int"))
    found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"]] = found["n"]
    schema = "cell int, first long, last long, shard int, base long"
    plan = docs.sparkSession.createDataFrame(flow(counts, shards, slack=slack), schema)
    ranked = ordinal_positions(rows, ["cell"], ["place", "doc_id", "text_hash", "row"])
    inside = (ranked["cell"] == plan["cell"]) & F.col("position").between(F.col("first"), F.col("last"))
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id", "text_hash", "size", "text_crc32", "shard", (F.col("base") + F.col("position") - F.col("first")).alias("slot")
    )


def with_shards(docs: DataFrame, shards: int = SHARDS, order: DataFrame | None = None) -> DataFrame:
    """``docs`` with all their columns, ``shard`` and ``slot``.

    ``order`` has (doc_id, text_hash, position) per row of ``docs``; the slots of a shard then follow position.
    """
    places = sharded(docs.select("doc_id", "text"), shards).select("doc_id", "text_hash", "shard", "slot")
    turn = Window.partitionBy("doc_id", "text_hash").orderBy("shard", "slot")
    places = places.withColumn("turn", F.row_number().over(turn))
    if order is not None:
        by_position = Window.partitionBy("doc_id", "text_hash").orderBy("position")
        order = order.select("doc_id", "text_hash", "position").withColumn("turn", F.row_number().over(by_position)).alias("o")
        left = places.alias("p")
        same = F.col("p.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("p.text_hash") == F.col("o.text_hash")) & (F.col("p.turn") == F.col("o.turn"))
        placed = left.join(order, same).select("p.doc_id", "p.text_hash", "p.turn", "p.shard", F.col("o.position").alias("place"))
        places = ordinal_positions(placed, ["shard"], ["place"]).select("doc_id", "text_hash", "turn", "shard", (F.col("position") - 1).alias("slot"))
    places = places.alias("p")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))).alias("r")
    same = F.col("r._id").eqNullSafe(F.col("p.doc_id")) & (F.col("r._hash") == F.col("p.text_hash")) & (F.col("r._turn") == F.col("p.turn"))
    columns = [F.col(f"r._row.{c}") for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(places, same).select(*columns, "p.shard", "p.slot")
