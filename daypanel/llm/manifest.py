"""A Merkle manifest of a document table, rolled up from nested structs.

Every row is a leaf: the digest of its fields. The leaves of a language, ordered by doc_id, are ranked over
range partitions. The low ``BITS`` binary digits of the rank become columns, the rest names a block of at
most ``2^BITS`` leaves. Inside a block the digit columns are grouped away one after the other, each time
nesting the structs of the children in that of their parent, so a block ends as one row that holds its whole
subtree. The grouping needs the one shuffle that brings a block together; blocks are small whatever the size
of a language. The roots of the blocks are leaves of the next round, until a language has one root, and the
roots of the languages make the last tree.

Proofs come back down the same way: a block row and the siblings above it meet in a grouping by block, and a
transform over the nested structs followed by an explode writes one row per child. No join takes place.

Rows of a language with equal doc_id are ordered by their leaf; equal rows are leaves of their own. A null
field is written as ``-``, so it differs from an empty one; rows without a language form a tree of their own,
which comes first. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ordinal_positions
from ..functions.session import cut

BITS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """Digest of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def folded(start: Column | str, steps: Column | str) -> Column:
    """The root that a leaf and its siblings give."""
    start = F.col(start) if isinstance(start, str) else start

    def up(digest: Column, step: Column) -> Column:
        other = F.coalesce(step["sibling"], F.lit(""))
        return F.sha2(F.when(step["right"], F.concat(other, digest)).otherwise(F.concat(digest, other)), 256)

    return F.aggregate(steps, start, up)


def siblings(steps: Column | str) -> Column:
    """Digests of the siblings from the leaf to the root."""
    return F.filter(F.transform(steps, lambda s: s["sibling"]), lambda d: d.isNotNull())


def rolled_up(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, block, size, digest, kids) per block of nodes (tree, rank, size, digest, of).

    ``size`` counts the tree's nodes on this level, ranks count from 0, and ``of`` says what a node stands for.
    A level is hashed only as long as the tree has more than one node on it.
    """
    digit = [F.shiftright("rank", j).bitwiseAND(1).cast("int").alias(f"d{j}") for j in range(bits)]
    rows = nodes.select("tree", F.shiftright("rank", bits).alias("block"), "size", *digit, "digest", F.col("of").alias("kids"))
    rows = rows.repartition("tree", "block")
    for j in range(bits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), "digest", "kids"))).alias("kids")
        rows = rows.groupBy("tree", "block", "size", *[f"d{k}" for k in range(j + 1, bits)]).agg(kids)
        joined = F.sha2(F.array_join(F.transform("kids", lambda c: c["digest"]), ""), 256)
        rows = rows.withColumn("digest", F.when(F.col("size") > 2**j, joined).otherwise(F.col("kids")[0]["digest"]))
    return rows.select("tree", "block", "size", "digest", "kids")


def _with_steps(kids: Column, level: int, above: Column) -> Column:
    """Per node below a nested struct: what it stands for and its steps up to the root."""

    def child(c: Column, i: Column) -> Column:
        other = F.when(F.size(kids) > 1, kids[1 - i]["digest"])
        step = F.array(F.struct(other.alias("sibling"), (i == 1).alias("right")))
        steps = F.concat(F.when(F.col("size") > 2**level, step).otherwise(F.slice(step, 1, 0)), above)
        if level == 0:
            return F.struct(c["kids"].alias("of"), steps.alias("steps"))
        return _with_steps(c["kids"], level - 1, steps)

    found = F.transform(kids, child)
    return found if level == 0 else F.flatten(found)


class Tree:
    """Trees over the nodes (tree, rank, size, digest, of); ``tops`` has (tree, digest) of their roots."""

    def __init__(self, nodes: DataFrame, bits: int):
        self.bits, self.rounds = bits, []
        size = nodes.agg(F.max("size")).first()[0] or 0
        while True:
            self.rounds.append(cut(rolled_up(nodes, bits)))
            self.tops, size = self.rounds[-1].select("tree", "digest"), -(-size // 2**bits)
            if size <= 1:
                break
            up = F.ceil(F.col("size") / 2**bits).cast("long").alias("size")
            nodes = self.rounds[-1].select("tree", F.col("block").alias("rank"), up, "digest", F.struct(F.col("block").alias("rank")).alias("of"))

    def proofs(self, above: DataFrame) -> DataFrame:
        """(of, steps, roots) per node; ``above`` has (tree, steps, roots) for the root of each tree."""
        known = above.select("tree", F.lit(0).cast("long").alias("block"), "steps", "roots")
        for blocks in reversed(self.rounds):
            both = blocks.select("tree", "block", "size", "kids").unionByName(known, allowMissingColumns=True)
            met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "kids", "steps", "roots")])
            below = _with_steps(F.col("kids"), self.bits - 1, F.col("steps"))
            rows = met.select("tree", "roots", F.explode(below).alias("n"))
            if blocks is not self.rounds[0]:
                known = rows.select("tree", F.col("n.of.rank").alias("block"), F.col("n.steps").alias("steps"), "roots")
        return rows.select("n.of", "n.steps", "roots")


def manifest(docs: DataFrame, bits: int = BITS, **carried: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, *carried) per row of ``docs``.

    ``subroot`` is the root of the row's language. ``steps`` lead from the leaf to the root: the sibling, null
    where a node is alone, and whether the node itself stands to its right. ``carried`` are columns over ``docs``.
    """
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf().alias("digest"), *[c.alias(n) for n, c in carried.items()])
    ranked = ordinal_positions(rows, ["tree"], ["doc_id", "digest"])
    of = F.struct("doc_id", F.col("digest").alias("leaf"), *carried)
    leaves = Tree(ranked.select("tree", (F.col("position") - 1).alias("rank"), F.col("group_size").alias("size"), "digest", of.alias("of")), bits)

    ranked = ordinal_positions(leaves.tops, [], ["tree"])
    of = F.struct("tree", F.col("digest").alias("subroot"))
    langs = Tree(ranked.select(F.lit("").alias("tree"), (F.col("position") - 1).alias("rank"), F.col("group_size").alias("size"), "digest", of.alias("of")), bits)
    none = F.array().cast("array<struct<sibling:string,right:boolean>>")
    subroots = langs.proofs(langs.tops.select("tree", none.alias("steps"), F.struct(F.col("digest").alias("root")).alias("roots")))
    above = subroots.select("of.tree", "steps", F.struct("roots.root", "of.subroot").alias("roots"))
    return leaves.proofs(above).select("of.doc_id", "of.leaf", "roots.subroot", "roots.root", "steps", *[f"of.{n}" for n in carried])
