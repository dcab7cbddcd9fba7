"""Mixing sources to target weights by Pfair scheduling.

Weights are whole numbers of slots in a period of ``PERIOD`` slots, at least one each. A source's documents are
shuffled by a hash and cut into blocks of ``BLOCK``. Block j of a source with q slots a period is released at
floor(j * PERIOD / q) and due at ceil((j + 1) * PERIOD / q); in every slot the released block with the earliest
deadline goes, ties by source. One slot serves one block and the weights fill the period, so every block is
served between release and deadline and each source is always less than one block off its target. All sources
are exactly on target when a period ends, so one period is scheduled and repeated. Its size is a parameter, or
twice the number of sources if that is more; one task schedules it, so sources should be few (hundreds). A
source that runs dry leaves its slots empty and the others go on in proportion: every document gets one
position, and ``on_target`` marks the part before the first source ran dry.

Without weights, a source's target is proportional to the square root of its number of documents. A source
that the given weights do not name gets one slot. A null source is the source ''. Of texts only a hash is read,
which orders rows with equal ids. Rows that repeat are scheduled as rows of their own. An empty table gives an
empty result. Only DataFrame functions are used; ranks inside a source come from range partitions, so one
source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ordinal_positions
from ..functions.session import cut

PERIOD = 1000
BLOCK = 16


def slots_per_period(sizes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """(source, q) from (source, n): slots in proportion to the weights by largest remainders, one at least.

    Works on one row per source. A period has at least two slots per source.
    """
    if weights is None:
        weight = F.round(1000 * F.sqrt("n")).cast("long")
    else:
        given = [F.when(F.col("source") == s, F.lit(round(1000 * w))) for s, w in weights.items()]
        weight = F.coalesce(*given, F.lit(0)).cast("long")
    everything = Window.partitionBy()
    shared = sizes.select("source", weight.alias("w"), F.count(F.lit(1)).over(everything).alias("s"))
    free = F.greatest(F.lit(period), 2 * F.col("s")) - F.col("s")
    parts = shared.select("source", "s", free.alias("free"), "w", F.greatest(F.sum("w").over(everything), F.lit(1)).alias("whole"))
    floors = parts.select("source", "s", "free", F.expr("free * w div whole").alias("base"), F.expr("free * w % whole").alias("rest"))
    spare = F.col("free") - F.sum("base").over(everything)
    turn = F.row_number().over(Window.orderBy(F.desc("rest"), "source"))
    # Largest remainders first; when no source has a weight, all is spare and dealt out evenly.
    extra = F.floor(spare / F.col("s")) + F.when(turn <= spare % F.col("s"), 1).otherwise(0)
    return floors.select("source", (1 + F.col("base") + extra).cast("int").alias("q"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def schedule(slots: DataFrame) -> DataFrame:
    """(source, k, t, q, period): the slot t of the k-th block of each source in a period, earliest deadline first.

    The state of the fold is one counter per source; the number of steps is the period.
    """
    listed = slots.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "q"))).alias("sources"))
    listed = listed.filter(F.size("sources") > 0).withColumn("period", F.aggregate("sources", F.lit(0), lambda n, s: n + s["q"]))
    period = F.col("period").cast("long")
    start = F.struct(
        F.transform("sources", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picks")
    )

    def step(state: Column, t: Column) -> Column:
        def due(done: Column, i: Column) -> Column:
            q = F.col("sources")[i]["q"]
            released = F.floor(done * period / q) <= t
            return F.when(released, F.struct(F.ceil((done + 1) * period / q).alias("deadline"), i.cast("int").alias("i")))

        first = F.array_min(F.transform(state["done"], due))["i"]
        return _let(
            first,
            lambda p: F.struct(
                F.transform(state["done"], lambda d, i: d + F.when(i == p, 1).otherwise(0)).alias("done"),
                F.concat(state["picks"], F.array(p)).alias("picks"),
            ),
        )

    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda s: s["picks"])
    dealt = listed.select("sources", "period", F.posexplode(picks).alias("t", "i"))
    dealt = dealt.select(F.col("sources")[F.col("i")].alias("s"), "t", "period").select("s.*", "t", "period")
    k = F.row_number().over(Window.partitionBy("source").orderBy("t")) - 1
    return dealt.withColumn("k", k)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, source, block, slot, position, on_target) per row of ``docs``.

    Documents in order of ``position`` are the mix; ``slot`` is the block's place in the schedule.
    """
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    plan = cut(schedule(slots_per_period(sizes, weights)))
    ranked = ordinal_positions(rows, ["source"], ["draw", "doc_id", "text_hash", "row"])
    j = F.floor((F.col("position") - 1) / block)
    blocks = ranked.select("doc_id", "source", "text_hash", "group_size", j.alias("block"), ((F.col("position") - 1) % block).alias("inside"))
    q = plan.groupBy("source").agg(F.max("q").alias("q"))
    turns = plan.select("source", "k", "t", "period")
    slot = (F.expr("block div q") * F.col("period") + F.col("t")).cast("long")
    # The slot in which each source has no block left for the first time.
    dry = sizes.join(q, "source").withColumn("block", F.ceil(F.col("n") / block)).withColumn("k", F.expr("cast(block % q as int)"))
    dry = dry.join(turns, ["source", "k"]).select("source", "q", F.min(slot).over(Window.partitionBy()).alias("horizon"))
    # One row per source, and one per slot of a period.
    keyed = blocks.join(F.broadcast(dry), "source").withColumn("k", F.expr("cast(block % q as int)"))
    placed = keyed.join(F.broadcast(turns), ["source", "k"]).withColumn("slot", slot)
    return placed.select(
        "doc_id", "text_hash", "source", F.col("block").cast("long").alias("block"), "slot",
        (F.col("slot") * block + F.col("inside")).cast("long").alias("position"), (F.col("slot") < F.col("horizon")).alias("on_target"),
    )


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with all their columns, in the order of the mix: files and the rows in them follow it."""
    places = mixed(docs.select("doc_id", "text", "source"), weights).select("doc_id", "text_hash", "position")
    turn = Window.partitionBy("doc_id", "text_hash").orderBy("position")
    places = places.withColumn("turn", F.row_number().over(turn)).alias("p")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))).alias("r")
    same = F.col("r._id").eqNullSafe(F.col("p.doc_id")) & (F.col("r._hash") == F.col("p.text_hash")) & (F.col("r._turn") == F.col("p.turn"))
    ordered = rows.join(places, same).select("r._row", "p.position").repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select("_row.*")
