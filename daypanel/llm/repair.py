"""Cheapest repair of conversations, by a cost DP and prefix-doubling ranks of its optimal arcs.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Rows may be kept, given the role user
or assistant, or deleted, and empty rows of these two roles may be inserted anywhere. Blank rows (no
character but white space) and duplicates (role and text seen earlier) must go; a truncated row (last
character not ``.``, ``!`` or ``?``) that stays costs extra. Of the cheapest repairs the one whose audit, the
initials of its edits (Delete, Insert, Keep, Rerole), is least in ASCII order is made.

Rows are ranked in their conversation over range partitions and cut into blocks of ``BLOCK`` rows, so no
task ever holds a conversation, however long. A block is a min-plus matrix over the four states of the
pattern; where a conversation has more blocks, matrices are multiplied in rounds of ``FAN`` and the costs to
go come back down. Then every (row, state) is a node, and an arc is optimal if it loses no cost. The labels of
a node's arcs differ, so the least one leads on. Ranks for audits of 1, 2, 4, ... edits follow by pairing a
node's rank with that of its pointer, and pointers double. In the end nodes of equal rank have the same least
edits, which are read off the doubled pointers once per rank. The maps from entered to left states of
blocks are composed in rounds like the matrices.

Rows of a conversation are ordered by turn, nulls first, then role and digest of the text; equal rows are
interchangeable. A null conversation id is one conversation, null roles and texts are one space. Empty texts are
blank. An empty table gives an empty result. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import ordinal_positions
from ..functions.session import cut

BLOCK = 1024
FAN = 256
NODES = 1 << 20  # nodes whose pointers are doubled together

SPACES = r"[\x20\x09-\x0D]"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs
MUST_GO, CUT_OFF = 4, 8  # added to the kind of a row: 0 system, 1 user, 2 assistant, 3 other

# States of the pattern: nothing yet, system, open user, complete pair.
_ANSWER = np.array([2, 2, 3, 2])  # the state after the user or assistant row that is next
_ROLE = np.array([1, 1, 2, 1])  # which of them it is: 1 user, 2 assistant
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by kind and state
_CLOSING = np.array([0, 2 * INSERT, INSERT, 0])
_NO_WAY = 1 << 40
_LABELS = np.array(list(" DIKR"))
_EDITS = T.StructType().add("cost", T.LongType()).add("audit", T.StringType()).add("row", T.ArrayType(T.IntegerType())).add("role", T.ArrayType(T.IntegerType()))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that the hash of their id and turn stands for; nulls are one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return rows.drop("_copy")


def _key() -> Column:
    """The conversation as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


# -- blocks of rows: costs, optimal arcs, ranks ------------------------------------------------------------

def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all blocks as a matrix, short blocks filled up, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _groups(column: pa.Array) -> Iterator[np.ndarray]:
    """Numbers of blocks of like length, few enough for ``NODES`` nodes."""
    sizes = np.diff(column.offsets.to_numpy())
    order, begin = np.argsort(sizes, kind="stable"), 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * 4 * (sizes[order[end]] + 1) <= NODES:
            end += 1
        yield order[begin:end]
        begin = end


def _arcs(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and giving a role from each state, ``after`` being the costs to go behind the row."""
    blocks = np.arange(len(code))[:, None]
    extra = np.where(code & CUT_OFF, TRUNCATED, 0).reshape(-1, *[1] * (after.ndim - 1))
    stays = (code & MUST_GO == 0).reshape(extra.shape)
    target = _KEPT[code & 3]
    kept = after[blocks, np.maximum(target, 0)] + extra
    kept = np.where((target >= 0).reshape(*target.shape, *[1] * (after.ndim - 2)) & stays, kept, _NO_WAY)
    return after + DELETE, kept, np.where(stays, after[:, _ANSWER] + extra + REROLE, _NO_WAY)


def costs_to_go(codes: np.ndarray, sizes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least costs from every row and state of each block, given those behind the block: [row, block, state, ...]."""
    out = np.broadcast_to(after, (codes.shape[1] + 1, *after.shape)).copy()
    for i in range(codes.shape[1] - 1, -1, -1):
        here = i < sizes
        best = np.minimum.reduce(_arcs(codes[here, i], out[i + 1][here]))
        user, pair = best[:, 2], best[:, 3]
        best[:, 2], best[:, 3] = np.minimum(user, pair + INSERT), np.minimum(pair, user + INSERT)
        best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + INSERT)
        out[i][here] = np.minimum(best, _NO_WAY)
    return out


class LeastPaths:
    """The least edits of all nodes (block, row, state), ranked by label and then role, by doubling."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, after: np.ndarray):
        self.cost = cost = costs_to_go(codes, sizes, after)
        rows, n = codes.shape[1], len(codes)
        self.node = np.arange((rows + 1) * n * 4).reshape(rows + 1, n, 4)
        label, role = np.zeros(self.node.shape, np.int64), np.zeros(self.node.shape, np.int64)
        step = self.node.copy()  # nodes behind the last row stay where they are
        for i in range(rows):
            here = np.flatnonzero(i < sizes)
            now, behind = cost[i][here], self.node[i + 1][here]
            deleted, kept, changed = _arcs(codes[here, i], cost[i + 1][here])
            inserted = now[:, _ANSWER] + INSERT
            target = _KEPT[codes[here, i] & 3]
            # From the largest label to the least, so that the least optimal one is what stays.
            for name, price, to, emits in (
                (4, changed, behind[:, _ANSWER], _ROLE), (3, kept, np.take_along_axis(behind, np.maximum(target, 0), 1), 0),
                (2, inserted, self.node[i][here][:, _ANSWER], _ROLE), (1, deleted, behind, -1),
            ):
                take = price == now
                label[i][here] = np.where(take, name, label[i][here])
                role[i][here] = np.where(take, emits, role[i][here])
                step[i][here] = np.where(take, to, step[i][here])
        self.label, self.role = label.ravel(), role.ravel()
        self.pointers = [step.ravel()]
        self.edits = (self.label > 0).astype(np.int64)
        self.rank = self.label * 4 + self.role + 1
        while True:
            to = self.pointers[-1]
            if not self.label[to].any():
                break
            self.rank = np.unique(self.rank * (self.rank.max() + 1) + self.rank[to], return_inverse=True)[1]
            self.edits = self.edits + self.edits[to]
            self.pointers.append(to[to])

    def left(self) -> np.ndarray:
        """The state in which each block is left, by the state it is entered in."""
        return self.pointers[-1][self.node[0].ravel()].reshape(-1, 4) % 4

    def read(self, entry: np.ndarray) -> list[tuple[str, list[int], list[int]]]:
        """Audit, rows and roles of the edits from ``entry`` states on, read once per rank."""
        start = self.node[0][np.arange(len(entry)), entry]
        ranks, first, which = np.unique(self.rank[start], return_index=True, return_inverse=True)
        paths, blocks = [], self.node.shape[1]
        for s in start[first].tolist():
            turn = np.arange(self.edits[s])
            at = np.full(len(turn), s)
            for k, to in enumerate(self.pointers):
                at = np.where(turn >> k & 1, to[at], at)
            paths.append(("".join(_LABELS[self.label[at]]), (at // (4 * blocks)).tolist(), self.role[at].tolist()))
        return [paths[w] for w in which.tolist()]


def _lists(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values, np.int64).reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _matrix(column: pa.Array, n: int = 4) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _price(codes: pa.Array) -> pa.Array:
    """The min-plus matrix of each block: from the state it is entered in to that it is left in."""
    out = np.zeros((len(codes), 16), np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, _NO_WAY)
    for some in _groups(codes):
        matrix, sizes = _codes(codes.take(pa.array(some)))
        out[some] = costs_to_go(matrix, sizes, np.broadcast_to(unit, (len(some), 4, 4)))[0].reshape(-1, 16)
    return _lists(out)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _passage(codes: pa.Array, after: pa.Array) -> pa.Array:
    """The state each block is left in on its least path, by the state it is entered in."""
    out, behind = np.zeros((len(codes), 4), np.int64), _matrix(after)
    for some in _groups(codes):
        out[some] = LeastPaths(*_codes(codes.take(pa.array(some))), behind[some]).left()
    return _lists(out)


@F.arrow_udf(_EDITS)
def _edited(codes: pa.Array, after: pa.Array, entry: pa.Array, is_last: pa.Array) -> pa.Array:
    """Least edits of each block from the state it is entered in; behind the last one the pattern is completed."""
    out, behind = [None] * len(codes), _matrix(after)
    entered, last = entry.to_numpy(zero_copy_only=False).astype(np.int64), is_last.to_numpy(zero_copy_only=False).astype(bool)
    for some in _groups(codes):
        matrix, sizes = _codes(codes.take(pa.array(some)))
        paths = LeastPaths(matrix, sizes, behind[some])
        state = paths.left()[np.arange(len(some)), entered[some]]
        for j, (block, (audit, row, role)) in enumerate(zip(some.tolist(), paths.read(entered[some]))):
            tail = ([[], [1, 2], [2], []][state[j]]) if last[block] else []
            out[block] = {
                "cost": int(paths.cost[0][j, entered[block]]), "audit": audit + "I" * len(tail),
                "row": row + [int(sizes[j])] * len(tail), "role": role + tail,
            }
    return pa.array(out, pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("row", pa.list_(pa.int32())), ("role", pa.list_(pa.int32()))]))


# -- chains of blocks --------------------------------------------------------------------------------------

def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), _NO_WAY)


def _listed(column: pa.Array) -> Iterator[np.ndarray]:
    for group in column:
        yield np.array(group.as_py(), np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _joint_price(prices: pa.Array) -> pa.Array:
    out = []
    for matrices in _listed(prices):
        whole = matrices[-1].reshape(4, 4)
        for m in matrices[-2::-1]:
            whole = _min_plus(m.reshape(4, 4), whole)
        out.append(whole.ravel())
    return _lists(np.array(out).reshape(-1, 16))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _behind_each(prices: pa.Array, after: pa.Array) -> pa.Array:
    """Costs to go behind each block of a chain, given those behind the chain."""
    out = []
    for matrices, cost in zip(_listed(prices), _matrix(after)):
        back = [cost]
        for m in matrices[:0:-1]:
            back.append(np.minimum((m.reshape(4, 4) + back[-1]).min(1), _NO_WAY))
        out.append([b.tolist() for b in back[::-1]])
    return pa.array(out, pa.list_(pa.list_(pa.int64())))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _joint_passage(passages: pa.Array) -> pa.Array:
    out = []
    for maps in _listed(passages):
        whole = np.arange(4)
        for m in maps:
            whole = m[whole]
        out.append(whole)
    return _lists(np.array(out).reshape(-1, 4))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _entry_of_each(passages: pa.Array, entry: pa.Array) -> pa.Array:
    """The state each block of a chain is entered in, given that of the chain."""
    out = []
    for maps, state in zip(_listed(passages), _matrix(entry, 1)[:, 0].tolist()):
        states = [state]
        for m in maps[:-1]:
            states.append(int(m[states[-1]]))
        out.append([[s] for s in states])
    return pa.array(out, pa.list_(pa.list_(pa.int64())))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(int(x)).cast("long") for x in values])


def _along(blocks: DataFrame, join: Callable, hand_down: Callable, outside: list[int], longest: int, fan: int) -> DataFrame:
    """(conv, block, given): what reaches each block (conv, block, v) from those on one side of it.

    Chains of ``fan`` blocks become one, round by round, until a conversation is one; then what comes from
    outside is handed down again.
    """
    level, chains = blocks.select("conv", "block", "v"), []
    while longest > 1:
        links = F.array_sort(F.collect_list(F.struct("block", "v"))).alias("links")
        chained = level.groupBy("conv", F.floor(F.col("block") / fan).alias("chain")).agg(links)
        chained = cut(chained.select("conv", "chain", F.col("links.block").alias("blocks"), F.col("links.v").alias("vs")))
        chains.append(chained)
        level, longest = chained.select("conv", F.col("chain").alias("block"), join("vs").alias("v")), -(-longest // fan)
    given = level.select("conv", "block", _longs(outside).alias("given"))
    for chained in reversed(chains):
        met = chained.join(given.withColumnRenamed("block", "chain"), ["conv", "chain"])
        each = F.explode(F.arrays_zip("blocks", F.col("handed").alias("given")))
        met = met.withColumn("handed", hand_down("vs", "given")).select("conv", each.alias("e"))
        given = cut(met.select("conv", F.col("e.blocks").alias("block"), F.col("e.given").alias("given")))
    return given


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per conversation of lines that come in order; only a running hash is kept."""
    at, running = None, None
    for batch in batches:
        convs, digests = [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if conv != at:
                if at is not None:
                    convs.append(at)
                    digests.append(running.hexdigest())
                at, running = conv, hashlib.sha256(line.encode())
            else:
                running.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(digests, pa.string())], ["conv", "repaired_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([running.hexdigest()])], ["conv", "repaired_sha256"])


class Repair:
    """The repair of conversations given as (conv_id, turn, role, text): ``summary`` and ``lines``."""

    def __init__(self, conversations: DataFrame, block: int = BLOCK, fan: int = FAN):
        one = F.lit(" ")
        rows = conversations.select(
            "conv_id", "turn", F.coalesce(F.col("role").cast("string"), one).alias("role"), F.coalesce(F.col("text").cast("string"), one).alias("text")
        )
        rows = rows.select(_key().alias("conv"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")
        ranked = ordinal_positions(rows, ["conv"], ["turn", "role", "digest"])
        self.rows = ranked.withColumn("pos", F.col("position") - 1)

        bare = F.regexp_replace("text", f"{SPACES}+$", "")
        initial = F.substring("role", 1, 1)
        kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        marks = self.rows.select(
            "conv", "pos", "group_size", "turn", "role", "digest", kind.alias("kind"), (F.length(bare) == 0).alias("is_blank"),
            (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"),
        )
        marks = cut(marks)
        firsts = marks.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
        marks = marks.join(firsts.filter("n > 1").drop("n"), ["conv", "role", "digest"], "left")
        again = F.col("pos") > F.coalesce("first", "pos")
        fault = F.when(F.col("is_blank"), "blank").when(again, "duplicate").when(F.col("is_cut"), "truncated")
        marks = cut(marks.select("conv", "pos", "group_size", "turn", "kind", fault.alias("fault")))

        n = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
        span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        self.counts = marks.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *map(n, ("blank", "duplicate", "truncated")))

        goes = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(0)
        code = (F.col("kind") + goes + F.when(F.col("fault") == "truncated", CUT_OFF).otherwise(0)).alias("code")
        # The last row of a block is shown to the next one too, which counts the pair they make.
        home = F.floor(F.col("pos") / block)
        shown = F.when((F.col("pos") + 1) % block == 0, F.array(home, home + 1)).otherwise(F.array(home))
        placed = marks.select("conv", "pos", F.ceil(F.col("group_size") / block).alias("n_blocks"), "kind", code, F.explode(shown).alias("block"))
        blocks = placed.filter("block < n_blocks").groupBy("conv", "block", "n_blocks").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "code"))).alias("r"))
        pair = F.zip_with(F.col("r.kind"), F.slice("r.kind", 2, block), lambda x, y: F.when(y.isNull(), 0).when((x * 10 + y).isin(1, 12, 21), 0).otherwise(1))
        own = F.filter("r", lambda x: x["pos"] >= F.col("block") * block)
        blocks = blocks.select("conv", "block", "n_blocks", F.aggregate(pair, F.lit(0), lambda a, x: a + x).alias("illegal"), F.transform(own, lambda x: x["code"]).alias("codes"))
        blocks = cut(blocks)

        longest = blocks.agg(F.max("n_blocks")).first()[0] or 0
        if longest > 1:
            after = _along(blocks.withColumn("v", _price("codes")), _joint_price, _behind_each, _CLOSING.tolist(), longest, fan)
            blocks = cut(blocks.join(after.withColumnRenamed("given", "after"), ["conv", "block"]))
            entry = _along(blocks.withColumn("v", _passage("codes", "after")), _joint_passage, _entry_of_each, [0], longest, fan)
            blocks = blocks.join(entry.select("conv", "block", F.col("given")[0].alias("entry")), ["conv", "block"])
        else:  # every conversation is one block
            blocks = blocks.withColumns({"after": _longs(_CLOSING.tolist()), "entry": F.lit(0).cast("long")})
        is_last = F.col("block") == F.col("n_blocks") - 1
        blocks = blocks.withColumn("e", _edited("codes", "after", "entry", is_last))
        self.blocks = cut(blocks.select("conv", "block", "illegal", (F.col("block") * block).alias("begin"), "e.*"))

    def lines(self) -> DataFrame:
        """(conv, block, turn, line): the rows of the repaired conversations, in the order of block and turn."""
        edits = self.blocks.select("conv", "block", "begin", "audit", F.posexplode(F.arrays_zip("row", "role")).alias("turn", "x")).filter("x.role >= 0")
        role = F.when(F.col("x.role") == 1, "user").when(F.col("x.role") == 2, "assistant")
        edits = edits.select("conv", "block", "turn", (F.col("begin") + F.col("x.row")).alias("pos"), role.alias("new"), (F.substr("audit", F.col("turn") + 1, F.lit(1)) == "I").alias("added"))
        empty = edits.filter("added").select("conv", "block", "turn", F.concat("new", F.lit(":")).alias("line"))
        kept = edits.filter("NOT added").join(self.rows.select("conv", "pos", "role", "text"), ["conv", "pos"])
        return empty.unionByName(kept.select("conv", "block", "turn", F.concat(F.coalesce("new", "role"), F.lit(":"), "text").alias("line")))

    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation with rows."""
        parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
        whole = self.blocks.groupBy("conv").agg(
            F.sum("illegal").alias("illegal"), F.sum(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"), F.array_join(parts["audit"], "").alias("audit")
        )
        ordered = self.lines().repartition("conv").sortWithinPartitions("conv", "block", "turn").select("conv", "line")
        digests = ordered.mapInArrow(_digests, "conv string, repaired_sha256 string")
        both = self.counts.unionByName(whole, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
        return both.groupBy("conv").agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c != "conv"])


def repaired(conversations: DataFrame, rows: DataFrame | None = None, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The repair of ``rows`` (``conversations`` themselves unless given), one row per conv_id of ``conversations``."""
    found = Repair(conversations if rows is None else rows, block, fan).summary()
    ids = conversations.select("conv_id").distinct().select(_key().alias("conv"), F.struct("conv_id").alias("id"))
    both = ids.unionByName(found, allowMissingColumns=True).groupBy("conv").agg(
        F.first("id", ignorenulls=True).alias("id"), *[F.first(c, ignorenulls=True).alias(c) for c in found.columns if c != "conv"]
    )
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    zero = F.lit(0).cast("long")
    return both.select("id.conv_id", *[F.coalesce(c, none.get(c, zero)).alias(c) for c in found.columns if c != "conv"])
