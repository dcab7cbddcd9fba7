"""Benchmark decontamination by a prefix-filtered join of word shingles.

An item is cut into windows of ``WINDOW`` consecutive words; an item of fewer words, but not none, is one
window. A window occurs in a document when all its words stand there in a row, so every shingle of the
window must occur: the rarest one is a sufficient prefix. Documents are read once. Whatever shares a
shingle with some item is kept with its position and the words around it; the corpus frequency of each
shingle is counted from these, each window is joined on its rarest shingle, the start that follows from the
shingle's offset must leave room for the whole window, and the words themselves are compared.

Null and empty texts have no words: they are returned with zeros, and such items have no windows. Rows
that repeat are judged one by one. Empty tables give no hits. Other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from .words import _LOWER, SHINGLE, Words, parts

WINDOW = 13
FILTER_SLOTS = 1 << 24  # size of the membership filter that tasks get: 2 MB, whatever the benchmark's size

_WINDOWS = "array<struct<words:string,n:int,shingles:array<bigint>>>"
_FOUND = "struct<n_words:int,hits:array<struct<shingle:bigint,pos:int,lead:int,context:string>>>"


def _spelled(words: Words, begin: int, end: int) -> str:
    """Words ``begin`` up to ``end``, lower-cased and joined by spaces."""
    return b" ".join(
        _LOWER[words.data[s:e]].tobytes() for s, e in zip(words.starts[begin:end], words.ends[begin:end])
    ).decode("utf-8", "replace")


def _windows(size: int):
    @F.arrow_udf(_WINDOWS)
    def cut_windows(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            words = Words(pa.array([text.as_py()], pa.string()))
            n = min(size, len(words.h))
            k = min(SHINGLE, n)
            rows = []
            if n:
                h = words.runs(k)[0].view(np.int64)
                for at in range(len(words.h) - n + 1):
                    rows.append({"words": _spelled(words, at, at + n), "n": n, "shingles": h[at : at + n - k + 1].tolist()})
            out.append(rows)
        kind = pa.list_(pa.struct([("words", pa.string()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))]))
        return pa.array(out, kind)

    return cut_windows


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words, n, shingles): every window of every item with its shingles in order."""
    return items.select("item_id", F.explode(_windows(size)("text")).alias("w")).select("item_id", "w.*")


def _finder(present, slots: int, lengths: list[int], size: int):
    """UDF: word count, and the runs that the filter lets through with the words a window could span."""
    before, after = size - SHINGLE, size

    def found(words: Words, table: np.ndarray):
        rows, pos, h = [], [], []
        for k in lengths:
            hashes, where, _ = words.runs(k)
            at = np.flatnonzero(table[hashes & np.uint64(slots - 1)])
            row = np.searchsorted(words.ptr, where[at], side="right") - 1
            rows.append(row), pos.append(where[at]), h.append(hashes[at])
        row, pos, h = np.concatenate(rows), np.concatenate(pos), np.concatenate(h)
        order = np.argsort(row, kind="stable")
        row, pos, h = row[order], pos[order], h[order]
        low = np.maximum(words.ptr[row], pos - before)
        high = np.minimum(words.ptr[row + 1], pos + after)
        context = [_spelled(words, a, b) for a, b in zip(low, high)]
        return np.bincount(row, minlength=words.rows), h.view(np.int64), pos - words.ptr[row], pos - low, context

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        table = np.unpackbits(np.frombuffer(present.value, np.uint8)).view(bool)
        counts, sizes, got = [], [], ([], [], [], [])
        for a, b in parts(texts):
            words = Words(texts.slice(a, b - a))
            n, *columns = found(words, table)
            counts.append(np.diff(words.ptr)), sizes.append(n)
            for column, values in zip(got, columns):
                column.extend(values)
        ends = np.concatenate([[0], *sizes]).cumsum()
        hits = pa.StructArray.from_arrays(
            [pa.array(got[0], pa.int64()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.int32()), pa.array(got[3], pa.string())],
            ["shingle", "pos", "lead", "context"],
        )
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)],
            ["n_words", "hits"],
        )

    return find


def _filter(shingles: DataFrame, slots: int):
    """Bit per slot that some shingle falls into; at most ``slots`` numbers reach the driver."""
    spark = shingles.sparkSession
    used = shingles.select(F.col("shingle").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")).distinct()
    table = np.zeros(slots, bool)
    table[used.toPandas()["slot"].to_numpy(dtype=np.int64)] = True
    return spark.sparkContext.broadcast(np.packbits(table).tobytes())


def _covered(spans: Column) -> Column:
    """Number of positions inside any of the (start, n) spans, which are in order."""
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def add(state, span):
        end = span["start"] + span["n"]
        new = F.greatest(F.lit(0), end - F.greatest(span["start"], state["reach"]))
        return F.struct((state["covered"] + new).alias("covered"), F.greatest(end, state["reach"]).alias("reach"))

    return F.aggregate(spans, zero, add, lambda s: s["covered"])


def contamination(docs: DataFrame, items: DataFrame, key: list[str], size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (text and the columns ``key``): the key, n_words, n_hit and the sorted ids ``items``.

    ``n_hit`` counts document words inside any occurrence of any window, ``items`` lists as text the items
    that own such a window.
    """
    windows = cut(item_windows(items, size))
    tokens = windows.select("words", "n", F.posexplode("shingles").alias("offset", "shingle")).distinct()
    lengths = sorted({SHINGLE} | {min(SHINGLE, r.n) for r in windows.select("n").distinct().collect()})
    find = _finder(_filter(tokens, FILTER_SLOTS), FILTER_SLOTS, lengths, size)
    named = [F.col(c).alias(f"_{i}") for i, c in enumerate(key)]
    read = cut(docs.select(*named, find("text").alias("f")).select("*", "f.*", F.monotonically_increasing_id().alias("_row")).drop("f"))

    seen = read.select("_row", "n_words", F.explode("hits").alias("h")).select("_row", "n_words", "h.*")
    rarity = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    # A window whose rarest shingle occurs nowhere cannot occur; the inner join leaves such shingles out, so
    # windows are only kept when every shingle of theirs was seen.
    ranked = tokens.join(rarity, "shingle", "left")
    prefix = (
        ranked.groupBy("words", "n")
        .agg(
            F.min(F.coalesce("often", F.lit(0))).alias("least"),
            F.min(F.struct("often", "offset", "shingle")).alias("rarest"),
        )
        .filter("least > 0")
        .select("words", "n", "rarest.offset", "rarest.shingle")
    )
    start = F.col("pos") - F.col("offset")
    spelled = F.array_join(F.slice(F.split("context", " "), F.col("lead") - F.col("offset") + 1, F.col("n")), " ")
    occurs = (
        seen.join(prefix, "shingle")
        .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .filter(spelled == F.col("words"))
        .select("_row", "words", start.alias("start"), "n")
    )
    occurs = cut(occurs)
    spans = occurs.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))
    spans = spans.select("_row", _covered(F.col("spans")).alias("n_hit"))
    owners = (
        occurs.select("_row", "words").distinct()
        .join(windows.select("words", "item_id").filter("item_id is not null").distinct(), "words")
        .groupBy("_row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        read.drop("hits").join(spans, "_row", "left").join(owners, "_row", "left")
        .select(
            *[F.col(f"_{i}").alias(c) for i, c in enumerate(key)],
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", none).alias("items"),
        )
    )


def contaminated(one_in: int = 20) -> Column:
    """Verdict on a row of :func:`contamination`: some word is hit, and at least one in ``one_in`` of them."""
    return (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with all their columns."""
    text = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")
    bad = contamination(docs.select("text", text), items, ["_text"]).filter(contaminated()).select("_text").distinct()
    return docs.select(F.struct("*").alias("_row"), text).join(bad, "_text", "left_anti").select("_row.*")
