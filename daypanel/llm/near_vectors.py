"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has a codebook of its own, so k + k centres make
a grid of k x k cells. A vector lives in the cell of its nearest centres. To find its partners, cells are
visited in the order of how much farther they are than its own (the excess of squared distance, added over
both halves: the multi-sequence order) until the excess passes a limit. The limit is the one under which the
wanted share of partners would be found if they lay right at the similarity threshold in random directions;
closer partners are found more often. Every visited pair is verified with the exact cosine.

Only vectors of one label are compared. Equal vectors of a label are one class with a size. A cell of a label
is dealt out in chunks of members and of visitors, so no task holds more than ``MEMBERS`` + ``VISITORS``
vectors at a time; a task returns counts per vector and a spanning set of links, not the pairs.

Codebooks and the limit are fitted on a bounded sample of ``SAMPLE_VALUES`` numbers, first in the order of a
hash; all vectors are indexed and all are searched. Vectors that are null, empty or zero, hold null or
non-finite components or have no label link with nothing, as do vectors of different lengths. Rows that repeat
are vectors of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import cut
from .components import components

SIMILARITY = 0.93
RECALL = 0.9995
SAMPLE_VALUES = 1 << 20
PER_CELL = 800  # vectors per cell, over all labels, that the size of the codebooks aims at
MEMBERS, VISITORS = 1024, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. A power of two is taken out first, so that no square is lost or infinite and no digit changes."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Grid:
    """Codebooks of the two halves and the limit of the traversal."""

    def __init__(self, sample: np.ndarray, size: int, similarity: float, recall: float):
        draw = np.random.default_rng(3)
        sample = _unit(sample)
        self.dim, self.cut = sample.shape[1], (sample.shape[1] + 1) // 2
        self.books = [_centres(h, size, draw) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        self.size = size
        away = draw.standard_normal(sample.shape)
        away -= (away * sample).sum(1, keepdims=True) * sample
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        there = similarity * sample + np.sqrt(1 - similarity**2) * away
        row = np.arange(len(sample))
        needed = np.zeros(len(sample))
        for mine, other in zip(self.excess(sample), self.excess(there)):
            needed += mine[row, other.argmin(1)]
        self.limit = float(np.quantile(needed, recall)) + 1e-9

    def excess(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per half, squared distance to each centre beyond that to the nearest one."""
        out = []
        for half, book in zip((unit[:, : self.cut], unit[:, self.cut :]), self.books):
            far = (book * book).sum(1) - 2 * half @ book.T
            out.append(far - far.min(1, keepdims=True))
        return out

    def placed(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell of each vector, and the cells of higher number that its traversal reaches.

        Of two cells, the vectors of the lower one do the visiting, so each pair is met once.
        """
        one, two = self.excess(unit)
        home = one.argmin(1) * self.size + two.argmin(1)
        first, second = np.argsort(one, axis=1), np.argsort(two, axis=1)
        visits = []
        for r in range(len(unit)):
            a, b = one[r][first[r]], two[r][second[r]]
            # Row by row of the sorted grid: how far the second half may go beside each centre of the first.
            steps = np.searchsorted(b, self.limit - a[a <= self.limit], side="right")
            cells = np.concatenate([first[r][i] * self.size + second[r][:n] for i, n in enumerate(steps)])
            visits.append(cells[cells > home[r]])
        return home, visits


def _centres(points: np.ndarray, size: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means centres."""
    out = points[draw.choice(len(points), size, replace=len(points) < size)].copy()
    for _ in range(rounds):
        near = ((out * out).sum(1) - 2 * points @ out.T).argmin(1)
        for k in np.unique(near):
            out[k] = points[near == k].mean(0)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _placer(grid: Grid):
    kind = T.StructType().add("cell", T.IntegerType()).add("visits", T.ArrayType(T.IntegerType()))

    @F.arrow_udf(kind)
    def place(vectors: pa.Array) -> pa.Array:
        x = _unit(_matrix(vectors, grid.dim))
        home, visits = grid.placed(x)
        ends = np.concatenate([[0], np.cumsum([len(v) for v in visits])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *visits])
        return pa.StructArray.from_arrays(
            [pa.array(home, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["cell", "visits"]
        )

    return place


def _verifier(dim: int, similarity: float):
    """Links inside one chunk and between it and its visitors, as counts (a, null, n) and spanning links (a, b, null)."""

    def verify(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table.column("embedding"), dim))
        ids = table.column("rep").to_numpy()
        size = table.column("n").to_numpy().astype(np.int64)
        sizes = table.column("dim").to_numpy()
        guest = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        first = table.column("v_chunk").to_numpy()[0] == 0
        home = np.flatnonzero(~guest)
        others = np.arange(len(ids)) if first else np.flatnonzero(guest)
        linked = (x[others] @ x[home].T >= similarity) & (sizes[others][:, None] == sizes[home][None, :])
        if first:
            place = np.full(len(ids), -1)
            place[home] = np.arange(len(home))
            inside = ~guest[others]
            linked[np.flatnonzero(inside), place[others[inside]]] = False
        count = np.zeros(len(ids), np.int64)
        count[others] += linked @ size[home]
        out = linked & guest[others][:, None]  # links between members are in both triangles already
        count[home] += size[others] @ out
        label = ids.copy()
        while True:
            old = label.copy()
            best = np.where(linked, label[home][None, :], np.iinfo(np.int64).max)
            if best.size:
                label[others] = np.minimum(label[others], best.min(1))
                best = np.where(linked, label[others][:, None], np.iinfo(np.int64).max)
                label[home] = np.minimum(label[home], best.min(0))
            if (label == old).all():
                break
        counted, tied = np.flatnonzero(count), np.flatnonzero(label != ids)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(ids[counted], pa.int64()), pa.array(ids[tied], pa.int64())]),
                "b": pa.concat_arrays([none(len(counted)), pa.array(label[tied], pa.int64())]),
                "n": pa.concat_arrays([pa.array(count[counted], pa.int64()), none(len(tied))]),
            }
        )

    return verify


def _usable() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def linked(vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    key = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit("second"), "label", "embedding").alias("k2")]
    good = vectors.filter(_usable()).select("vec_id", "label", "embedding", *key)
    classes = good.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = cut(classes.withColumn("dim", F.size("embedding")))
    total = classes.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    rows = vectors.select("vec_id", *[F.when(_usable(), k).alias(n) for k, n in zip(key, ("k1", "k2"))])
    if total["n"] == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    dim = total["dim"]
    taken = classes.orderBy(F.xxhash64("k1"), "k1").limit(max(100, SAMPLE_VALUES // dim)).select("embedding").toArrow()
    size = int(np.clip(round((total["n"] / PER_CELL) ** 0.5), 4, 256))
    grid = Grid(_matrix(taken.column("embedding"), dim), size, similarity, recall)
    placed = cut(classes.withColumn("at", _placer(grid)("embedding")).select("rep", "n", "label", "dim", "embedding", "at.*"))

    cells = ["label", "cell"]
    chunks = cut(placed.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    members = placed.join(chunks, cells).withColumn("chunk", chunk)
    # Members of a cell of several chunks visit the chunks of higher number.
    late = F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1))
    own = members.filter(F.col("chunk") + 1 < F.col("chunks")).select("rep", "n", "dim", "embedding", *cells, late.alias("chunk"))
    away = placed.select("rep", "n", "dim", "embedding", "label", F.explode("visits").alias("cell")).join(chunks, cells)
    away = away.select("rep", "n", "dim", "embedding", *cells, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    guests = own.union(away)
    crowd = guests.groupBy(*cells, "chunk").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("turns"))
    turns = cut(crowd)
    guests = guests.join(turns, [*cells, "chunk"]).withColumn("v_chunk", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("turns")).cast("int"))
    hosts = members.join(turns, [*cells, "chunk"], "left").withColumn("v_chunk", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1)))
    columns = [*cells, "chunk", "v_chunk", "rep", "n", "dim", "embedding"]
    together = hosts.select(*columns, F.lit(False).alias("guest")).union(guests.select(*columns, F.lit(True).alias("guest")))
    verified = together.groupBy(*cells, "chunk", "v_chunk").applyInArrow(_verifier(dim, similarity), "a bigint, b bigint, n bigint")
    verified = cut(verified)

    counts = verified.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    roots = components(verified.filter("b is not null").select("a", "b")).withColumnsRenamed({"id": "rep"})
    known = classes.select("k1", "k2", "rep", "n").join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root")
    )
    out = rows.join(known, ["k1", "k2"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
