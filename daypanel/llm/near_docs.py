"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles, each labelled with how often it came before, so that
no label repeats. The Order MinHash sketch has ``SKETCHES`` keys; key i takes the ``PICKED`` labels that are
least under the i-th permutation and keeps them in text order. Two documents of similarity s share a key with
probability about s^PICKED as long as the order agrees: at 0.8 all 24 keys differ in 3 of a million pairs.

A candidate pair is verified by alignment. Labels do not repeat, so the longest common subsequence is the
longest increasing run of matched positions; only matches inside the band that the threshold leaves are used.
Similarity is common / (n + m - common), the ordered form of the Jaccard index of shingles.

Documents of equal words are one vertex. Pairs come from key buckets, in two steps: every vertex is first
compared with the leaders of its buckets (the members whose buckets hold most documents, so the middle of a
crowd), which merges most groups with a few comparisons per document. Then, in every bucket that still holds
several components, all pairs across components are compared. Buckets of more than ``LIGHT`` members, where
that would be quadratic, draw a few new leaders per round instead, until a round links nothing. What still
shares such a bucket across components is then filed under the rarest of its labels: two sequences of the
threshold share a label among the rarest fifth of each, at ranks and positions that leave room for the rest.
All pairs across components that do are compared, so no partner is left to the draw.

Rows without words (null, empty, only punctuation) are alike to nothing and stay. Rows that repeat wholly are
equal texts, of which one stays. Empty tables give empty results. Other columns are passed through untouched.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import cut
from .components import components, packed
from .words import Words, mixed, parts

SIMILARITY = 0.8
SKETCHES = 24
PICKED = 4
LIGHT = 32
PARTNERS = 2  # leaders a vertex is compared with per round, those it shares most buckets with
FEW = 1 << 20  # ids and hashes of 16 bytes that may go to all executors
SLOTS = 1 << 20  # slots of label hashes whose counts, 16 bytes each, go to all executors
CELL = 1 << 16  # comparisons of one label that a task makes for one key of the join

_FACTORS = np.random.default_rng(5).integers(0, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = T.StructType().add("digest", T.BinaryType()).add("n", T.IntegerType()).add("keys", T.ArrayType(T.LongType()))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes mixed with the number of equal ones before them."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(ranked))
    earlier = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(shingles)
    out[order] = mixed(ranked + earlier.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def order_keys(labels: np.ndarray) -> np.ndarray:
    """The sketch: per permutation the least labels, in text order, as one hash."""
    keys = np.empty(SKETCHES, np.uint64)
    picked = min(PICKED, len(labels))
    step = max(1, (1 << 21) // max(1, len(labels)))
    for a in range(0, SKETCHES, step):
        values = labels[None, :] * _FACTORS[a : a + step, None]
        if picked < len(labels):
            at = np.sort(np.argpartition(values, picked - 1, axis=1)[:, :picked], axis=1)
        else:
            at = np.broadcast_to(np.arange(picked), (len(values), picked))
        folded = np.arange(a, a + len(values), dtype=np.uint64)
        for j in range(picked):
            folded = mixed(folded + labels[at[:, j]])
        keys[a : a + step] = folded
    return keys


@F.arrow_udf(_SKETCH)
def _sketched(texts: pa.Array) -> pa.Array:
    digests, sizes, keys, count = [], [], [], []
    for a, b in parts(texts):
        words = Words(texts.slice(a, b - a))
        h, ptr = words.shingles()
        digests += words.digests()
        sizes.append(np.diff(ptr))
        for s, e in zip(ptr[:-1], ptr[1:]):
            count.append(SKETCHES if e > s else 0)
            if e > s:
                keys.append(order_keys(labelled(h[s:e])))
    flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.StructArray.from_arrays(
        [
            pa.array(digests, pa.binary()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
        ],
        ["digest", "n", "keys"],
    )


@F.arrow_udf(T.ArrayType(T.LongType()))
def _labels(texts: pa.Array) -> pa.Array:
    flat, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in parts(texts):
        h, ptr = Words(texts.slice(a, b - a)).shingles()
        sizes.append(np.diff(ptr))
        flat += [labelled(h[s:e]) for s, e in zip(ptr[:-1], ptr[1:])]
    ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).view(np.int64), pa.int64()))


def ordered_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """common / (n + m - common) for the longest common subsequence of two label sequences.

    Below ``least`` the value is only an upper bound's refusal: it is then some number below ``least``.
    """
    total = len(a) + len(b)
    if total == 0:
        return 0.0
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == len(b)] = 0
    same = b[order][at] == a if len(b) else np.zeros(len(a), bool)
    i, j = np.flatnonzero(same), order[at[same]] if len(b) else np.zeros(0, int)
    needed = least * total / (1 + least)
    if len(i) < needed - 1e-9:
        return len(i) / (total - len(i))
    band = max(len(a), len(b)) - needed + 1
    j = j[np.abs(i - j) <= band]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    else:
        common = len(j)
    return common / (total - common)


@F.arrow_udf(T.DoubleType())
def _aligned(left: pa.Array, right: pa.Array) -> pa.Array:
    (p, h), (q, g) = ((x.offsets.to_numpy(), x.values.to_numpy().view(np.uint64)) for x in (left, right))
    return pa.array([ordered_similarity(h[p[r] : p[r + 1]], g[q[r] : q[r + 1]]) for r in range(len(left))], pa.float64())


def first_labels(often: np.ndarray, main: np.ndarray):
    """A column function of (labels, root): those of the rarest labels that a partner in another component may share first.

    ``often`` counts the labels of a slot, 0 where one component holds them all; ``main`` is the component holding most.
    Per label: its place in the text, how many are not rarer (itself included), and whether ``root`` is the slot's main one.
    """
    found = T.StructType().add("label", T.LongType()).add("pos", T.IntegerType()).add("behind", T.IntegerType()).add("main", T.BooleanType())

    @F.arrow_udf(T.ArrayType(found))
    def first(labels: pa.Array, roots: pa.Array) -> pa.Array:
        ptr = labels.offsets.to_numpy().astype(np.int64)
        flat = labels.values.to_numpy()[ptr[0] : ptr[-1]]
        ptr = ptr - ptr[0]
        size = np.diff(ptr)
        row = np.repeat(np.arange(len(size)), size)
        slot = flat % len(often)
        order = np.lexsort((flat, often[slot], row))
        behind = ptr[1:][row] - np.arange(len(flat))
        kept = (often[slot[order]] > 0) & (behind >= size[row] * SIMILARITY - 1e-6)
        order, row, behind = order[kept], row[kept], behind[kept]
        columns = [flat[order], (order - ptr[row]).astype(np.int32), behind.astype(np.int32), roots.to_numpy()[row] == main[slot[order]]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(c) for c in columns], found.names)
        return pa.ListArray.from_arrays(pa.array(ends), structs)

    return first


def _slot_tables(slots: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(slot, often, main) as arrays over all slots, 0 for those not listed: 16 bytes a slot."""
    often, main = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    listed = slots.select("slot", "often", "main").toArrow()
    at = listed["slot"].to_numpy()
    often[at], main[at] = listed["often"].to_numpy(), listed["main"].to_numpy()
    return often, main


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _alike_length(n: str, m: str) -> Column:
    """The shorter has enough shingles for the threshold to be reached."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(SIMILARITY - 1e-9)


def chosen(rows: DataFrame, keys: DataFrame, on: Column, how: str) -> DataFrame:
    """``rows`` joined with narrow ``keys``, which go to all executors if there are few of them."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on, how)


class _Search:
    """Verified links between vertices: documents of distinct word sequences."""

    def __init__(self, docs: DataFrame, vertices: DataFrame):
        self.vertices = vertices
        filed = vertices.select("v", "n", F.explode("keys").alias("key"))
        shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        filed = cut(filed.join(shared, "key"))
        crowd = filed.groupBy("v").agg(F.sum("members").alias("crowd"))
        self.filed = cut(filed.join(crowd, "v"))
        self.labels = cut(self.read(docs))
        self.tested: DataFrame | None = None
        self.n_tested = 0
        self.links: DataFrame | None = None
        self.known: DataFrame | None = None

    def read(self, docs: DataFrame) -> DataFrame:
        """(v, labels) of the vertices that share a bucket, whose texts alone are read."""
        wanted = self.filed.select("v").distinct().join(self.vertices.select("v", "doc_id", "text_hash"), "v")
        wanted = cut(wanted).alias("w")
        d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("d")
        same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
        read = chosen(d, wanted, same, "inner").select("w.v", "d.text")
        # Rows that repeat wholly have the same labels, of which one copy is kept.
        return read.select("v", _labels("text").alias("labels")).groupBy("v").agg(F.first("labels").alias("labels"))

    def verify(self, pairs: DataFrame) -> int:
        """Align the pairs (a, b) that were not aligned before; the number of new links."""
        pairs = pairs.select("a", "b").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        n = pairs.count()
        if n == 0:
            return 0
        self.n_tested += n
        self.tested = packed(pairs if self.tested is None else cut(self.tested.union(pairs)), self.n_tested)
        left = self.labels.select(F.col("v").alias("a"), F.col("labels").alias("x"))
        right = self.labels.select(F.col("v").alias("b"), F.col("labels").alias("y"))
        scored = pairs.join(left, "a").join(right, "b").select("a", "b", _aligned("x", "y").alias("similarity"))
        links = cut(scored.filter(F.col("similarity") >= SIMILARITY - 1e-9).select("a", "b"))
        found = links.count()
        if found:
            links = packed(links, found)
            self.links = links if self.links is None else self.links.union(links)
            self.known = None
        return found

    def groups(self) -> DataFrame:
        """(id, root) of the vertices linked so far; worked out again only after new links."""
        if self.known is None:
            none = self.vertices.limit(0).select(F.col("v").alias("a"), F.col("v").alias("b"))
            self.known = cut(components(none if self.links is None else self.links))
        return self.known

    def placed(self, filed: DataFrame) -> DataFrame:
        """Filed keys with the component of each vertex, without the buckets of one component."""
        roots = self.groups().withColumnsRenamed({"id": "v"})
        placed = filed.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        mixed_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        return cut(placed.join(mixed_keys.select("key"), "key", "left_semi"))

    def with_leaders(self, filed: DataFrame, leaders: DataFrame, across: bool) -> DataFrame:
        """Per vertex the ``PARTNERS`` leaders of its buckets that it meets most often."""
        met = filed.join(leaders, "key").filter((F.col("v") != F.col("leader")) & _alike_length("n", "leader_n"))
        if across:
            met = met.filter(F.col("root") != F.col("leader_root"))
        met = met.groupBy("v", "leader").agg(F.count(F.lit(1)).alias("times"))
        best = Window.partitionBy("v").orderBy(F.desc("times"), "leader")
        return met.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= PARTNERS).select(*_pair("v", "leader"))

    def within_reach(self, members: DataFrame) -> DataFrame:
        """All pairs (a, b) of ``members`` (v, n, root) in different components that may reach the threshold.

        In the order of rarity, labels of one component before all others, the first label of a common
        subsequence has all of it behind it on both sides. So the shorter text holds it among its first
        n - 2 s / (1 + s) n labels and the longer one among its first n - s n. Any order that all texts keep to
        will do, so rarity is counted per slot of label hashes in a table of bounded size, and each text finds
        its first labels by itself.
        """
        members = cut(members.join(self.labels, "v").select("v", "n", "root", "labels"))
        slots = members.select("root", F.explode("labels").alias("label")).groupBy(F.pmod("label", F.lit(SLOTS)).alias("slot"), "root").agg(F.count(F.lit(1)).alias("held"))
        slots = slots.groupBy("slot").agg(F.sum("held").alias("often"), F.max(F.struct("held", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"))
        rare = first_labels(*_slot_tables(slots.filter("roots > 1").drop("roots")))
        first = cut(members.select("v", "n", "root", F.explode(rare("labels", "root")).alias("f")).select("v", "n", "root", "f.*"))

        # The largest component of a slot is compared with the others only, so that it is never paired with itself.
        side = lambda alone, others: F.explode(F.when(F.col("main"), F.array(F.lit(alone))).otherwise(F.array(F.lit(0), F.lit(others))))
        short = first.filter(F.col("behind") >= F.col("n") * F.lit(2 * SIMILARITY / (1 + SIMILARITY)) - 1e-6)
        x, y = cut(short.withColumn("side", side(2, 1)).drop("main")), cut(first.withColumn("side", side(1, 2)).drop("main"))
        key = ["label", "side"]
        sizes = x.groupBy(*key).agg(F.count(F.lit(1)).alias("nx")).join(y.groupBy(*key).agg(F.count(F.lit(1)).alias("ny")), key)
        sizes = cut(sizes.select(*key, (F.col("nx") >= F.col("ny")).alias("x_dealt"), F.ceil(F.col("nx") * F.col("ny") / CELL).alias("cells")))
        one, each = F.array(F.pmod(F.xxhash64("v"), F.col("cells"))), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
        x = x.join(sizes, key).withColumn("cell", F.explode(F.when(F.col("x_dealt"), one).otherwise(each))).alias("x")
        y = y.join(sizes, key).withColumn("cell", F.explode(F.when(F.col("x_dealt"), each).otherwise(one))).alias("y")
        c = F.col
        needed = (c("x.n") + c("y.n")) * F.lit(SIMILARITY / (1 + SIMILARITY)) - 1e-6
        before, after = F.least("x.pos", "y.pos"), F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos"))
        fits = (
            (c("x.root") != c("y.root")) & (F.struct("x.n", "x.v") < F.struct("y.n", "y.v")) & _alike_length("x.n", "y.n")
            & (F.least("x.behind", "y.behind") >= needed) & (before + after >= needed)
        )
        same = (c("x.label") == c("y.label")) & (c("x.side") == c("y.side")) & (c("x.cell") == c("y.cell"))
        return x.join(y, same & fits).select(*_pair("x.v", "y.v")).distinct()

    def finish(self, rest: DataFrame) -> None:
        """Compare what still shares a bucket across components: a pair of each two components, then all pairs left."""
        pairs = cut(self.within_reach(cut(rest.select("v", "n", "root").distinct())))
        for all_pairs in (False, True):
            roots = self.groups()
            for end in ("a", "b"):
                pairs = pairs.drop(f"root_{end}").join(roots.withColumnsRenamed({"id": end, "root": f"root_{end}"}), end, "left")
                pairs = pairs.withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
            pairs = cut(pairs.filter("root_a != root_b"))
            if all_pairs:
                self.verify(pairs)
            else:
                ends = [f("root_a", "root_b").alias(n) for f, n in ((F.least, "lo"), (F.greatest, "hi"))]
                one = F.min(F.struct(F.xxhash64("a", "b"), "a", "b")).alias("p")
                self.verify(pairs.select("a", "b", *ends).groupBy("lo", "hi").agg(one).select("p.a", "p.b"))

    def run(self) -> None:
        middle = F.max(F.struct("crowd", F.expr("-v").alias("order"), "v", "n")).alias("top")
        leaders = self.filed.groupBy("key").agg(middle).select("key", F.col("top.v").alias("leader"), F.col("top.n").alias("leader_n"))
        self.verify(self.with_leaders(self.filed, leaders, across=False))

        rest = self.placed(self.filed)
        light = rest.filter(F.col("members") <= LIGHT)
        x, y = light.alias("x"), light.alias("y")
        apart = (F.col("x.v") < F.col("y.v")) & (F.col("x.root") != F.col("y.root")) & _alike_length("x.n", "y.n")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & apart).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
        self.verify(pairs)

        turn, rest = 0, rest.filter(F.col("members") > LIGHT)
        while not rest.isEmpty():
            rest = self.placed(rest.drop("root"))
            drawn = F.xxhash64(F.lit(turn), "v")
            leaders = (
                rest.groupBy("key").agg(F.max(F.struct(drawn, "v", "n", "root")).alias("p"), F.min(F.struct(drawn, "v", "n", "root")).alias("q"))
                .select("key", F.explode(F.array("p", "q")).alias("e"))
                .select("key", F.col("e.v").alias("leader"), F.col("e.n").alias("leader_n"), F.col("e.root").alias("leader_root"))
            )
            if self.verify(self.with_leaders(rest, leaders, across=True)) == 0:
                break
            turn += 1
        if not rest.isEmpty():
            self.finish(rest)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, kept): one row per row of ``docs``.

    ``class_id`` is the least doc_id of the group; ``kept`` is true for one row of each group.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    read = docs.select("doc_id", text_hash, _sketched("text").alias("s")).select("doc_id", "text_hash", "s.*")
    read = cut(read.withColumn("row", F.monotonically_increasing_id()))
    firsts = read.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("row", "doc_id", "text_hash", "n", "keys")).alias("m"))
    firsts = cut(firsts.select("digest", F.col("m.row").alias("v"), "m.doc_id", "m.text_hash", "m.n", "m.keys"))
    search = _Search(docs, firsts.drop("digest"))
    search.run()
    roots = firsts.select("digest", "v").join(search.groups().withColumnsRenamed({"id": "v"}), "v", "left")
    roots = roots.select("digest", F.coalesce("root", "v").alias("root"))
    rooted = cut(read.drop("keys").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "row")))
    # Written out, so that the join below deals both sides anew and can split the rows of a large group.
    heads = cut(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("h")))
    return rooted.join(heads, "root").select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("h.doc_id").alias("class_id"), (F.col("row") == F.col("h.row")).alias("kept")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns; rows without words stay.

    Rows that go are taken out by their id and text; where equal ones repeat, one of them comes back.
    """
    found = classes(docs.select("doc_id", "text")).groupBy("doc_id", "text_hash")
    gone = cut(found.agg(F.max("kept").alias("back"), F.min("kept").alias("all")).filter(~F.col("all")).drop("all"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_hash)
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    back = chosen(rows, gone.filter("back").drop("back"), same, "left_semi").groupBy("_id", "_hash").agg(F.first("_row").alias("_row"))
    return chosen(rows, gone.drop("back"), same, "left_anti").select("_row.*").union(back.select("_row.*"))
