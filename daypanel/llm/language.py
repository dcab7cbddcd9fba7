"""Language of pages by fused evidence.

For each language, four sources are multiplied: the likelihood of the page's text under byte trigrams of
labelled documents; the chance that a page of the language declares what the page's markup declares; the
chance that its address ends as it does; and the prior of its host. The last three are learnt from the pages
themselves by grouped sums of the text's posteriors, so a wrong but consistent declaration loses its weight.
Host priors are smoothed along the domain tree: a domain with n pages keeps n / (n + ``PRIOR_PAGES``) of its own
counts and takes the rest from its parent domain, up to all pages; a page does not count towards its own prior.

The trigram table is fitted on about ``LANGUAGE_DOCS`` different texts of labelled documents per language, drawn by a
hash of the text; copies count once, so neither a text of most rows nor a language of few texts tips the draw. All
other counts cover all pages and the whole of their text. A long text's likelihood is that of ``EVIDENCE``
trigrams at most, at the mean of all, because neighbouring trigrams are not independent.

Null html is an empty text that declares nothing; a null url has an empty host. Empty texts are decided by the
other evidence. Labels that are null or empty are left out; without labelled documents the language is ''. Rows
that repeat are judged one by one. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import cut
from .url_filter import domains as domains_of
from .url_filter import host_of
from .words import parts, utf8

LANGUAGE_DOCS = 1000
SLOTS = 1 << 14
EVIDENCE = 60
PRIOR_PAGES = 20.0
SMOOTHING = 0.5

_HTML_LANG = r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"

# Bytes as they enter a trigram: A-Z as a-z, everything that is no letter as a space.
_CODE = np.full(256, 32, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")


def declared_language(html: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(html, _HTML_LANG, 1), F.lit("")))


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each byte trigram with a letter in it, and the row bounds."""
    at, data = utf8(texts)
    code = _CODE[data]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    slot = ((a * 0x9E3779B1 + b) * 0x85EBCA77 + c) * 0xC2B2AE3D
    slot = (slot >> 13) & (SLOTS - 1)
    row_end = np.repeat(at[1:], np.diff(at))[:-2]
    fits = (np.arange(len(slot)) + 3 <= row_end) & ((a != 32) | (b != 32) | (c != 32))
    where = np.flatnonzero(fits)
    return slot[where], np.searchsorted(where, at)


def trigram_table(docs: DataFrame, languages: dict[str, int]) -> np.ndarray:
    """Log probability of each slot per language, from a hashed draw of the different texts of documents (text, lang).

    ``languages`` holds each language's number of different texts, which may be an estimate.
    """
    names = list(languages)
    chance = F.coalesce(*[F.when(F.col("lang") == n, F.lit(min(1.0, LANGUAGE_DOCS / max(1, k)))) for n, k in languages.items()])
    drawn = docs.filter(F.col("lang").isin(names)).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 50)) < chance * (1 << 50))
    drawn = drawn.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))  # copies fold before the shuffle

    def counted(batches):
        total = np.zeros((len(names), SLOTS), np.int64)
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for a, b in parts(texts):
                slot, ptr = trigrams(texts.slice(a, b - a))
                for r in range(b - a):
                    np.add.at(total[names.index(langs[a + r])], slot[ptr[r] : ptr[r + 1]], 1)
        row, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[row, slot], pa.int64())], ["lang", "slot", "n"]
        )

    rows = drawn.select("text", "lang").mapInArrow(counted, "lang int, slot int, n bigint")
    found = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages x slots at most
    total = np.full((len(names), SLOTS), SMOOTHING)
    total[found["lang"], found["slot"]] += found["n"]
    return np.log(total / total.sum(axis=1, keepdims=True)).T.astype(np.float32)


def text_evidence(table: np.ndarray):
    """Column function: log likelihood of a text per language, the highest being 0."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def evidence(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, table.shape[1]))]
        for a, b in parts(texts):
            slot, ptr = trigrams(texts.slice(a, b - a))
            run = np.zeros((len(slot) + 1, table.shape[1]))
            np.cumsum(table[slot], axis=0, out=run[1:])
            n = np.diff(ptr)[:, None]
            mean = (run[ptr[1:]] - run[ptr[:-1]]) / np.maximum(n, 1)
            value = mean * np.minimum(n, EVIDENCE)
            out.append(value - value.max(axis=1, keepdims=True))
        values = np.concatenate(out)
        ends = pa.array(np.arange(len(values) + 1) * table.shape[1], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), pa.float64()))

    return evidence


def _sums(languages: list[str], by: str = "p") -> list[Column]:
    return [F.sum(F.col(by)[i]).alias(f"n{i}") for i in range(len(languages))]


def _array(names: list[str]) -> Column:
    return F.array(*map(F.col, names))


def _likelihood(read: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """(column, log chance per language) of each value of a column, given the language."""
    k = range(len(languages))
    counts = cut(read.groupBy(column).agg(*_sums(languages)))
    whole = counts.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in k], F.count(F.lit(1)).alias("kinds")).first()
    if whole is None or whole["t0"] is None:
        return counts.select(column, _array([f"n{i}" for i in k]).alias(f"{column}_chance"))
    chance = [F.log((F.col(f"n{i}") + SMOOTHING) / F.lit(whole[f"t{i}"] + SMOOTHING * whole["kinds"])) for i in k]
    return counts.select(column, F.array(*chance).alias(f"{column}_chance"))


def _mixed(own: Column, upper: Column, size: Column, languages: list[str]) -> Column:
    """Prior from a domain's sums per language and the prior above it."""
    return F.array(*[(own[i] + PRIOR_PAGES * upper[i]) / (size + PRIOR_PAGES) for i in range(len(languages))])


def host_priors(read: DataFrame, languages: list[str]) -> DataFrame:
    """(host, own, n, above): posterior sums and pages of each host, and the prior of the domains above it."""
    k = range(len(languages))
    hosts = cut(read.groupBy("host").agg(*_sums(languages), F.count(F.lit(1)).cast("double").alias("n")))
    line = domains_of(F.col("host"))
    domains = hosts.select(F.explode(line).alias("domain"), *[f"n{i}" for i in k], "n").groupBy("domain").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in k], F.sum("n").alias("n")
    )
    domains = cut(domains.select("domain", _array([f"n{i}" for i in k]).alias("own"), "n"))
    everything = hosts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in k], F.sum("n").alias("n")).first()
    n = everything["n"] or 0.0
    base = F.array(*[F.lit(((everything[f"n{i}"] or 0.0) + SMOOTHING) / (n + SMOOTHING * len(languages))) for i in k])
    # From the last label inwards, each domain smooths the one above; the host's own sums come last, per page.
    steps = hosts.select("host", F.posexplode(F.slice(F.reverse(line), 1, F.size(line) - 1)).alias("at", "domain"))
    steps = steps.join(domains, "domain").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "own", "n"))).alias("steps"))
    above = F.aggregate("steps", base, lambda up, s: _mixed(s["own"], up, s["n"], languages))
    joined = hosts.select("host", _array([f"n{i}" for i in k]).alias("own"), "n").join(steps, "host", "left")
    return joined.select("host", "own", "n", F.when(F.col("steps").isNull(), base).otherwise(above).alias("above"))


def identified(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, probability) per row of ``pages``."""
    counted = docs.filter("lang is not null and lang != ''").groupBy("lang").agg(F.approx_count_distinct("text").alias("n"))
    languages = {r["lang"]: r["n"] for r in counted.orderBy("lang").collect()}
    host = host_of(F.col("url"))
    plain = pages.select("page_id", host.alias("host"), declared_language(F.col("html")).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), "html")
    if not languages:
        none = [F.lit("").alias("text_lang"), F.lit("").alias("lang"), F.lit(0.0).alias("probability")]
        return plain.select("page_id", "host", "declared", "suffix", *none)
    names = list(languages)
    evidence = text_evidence(trigram_table(docs.select("text", "lang").filter("text is not null"), languages))
    read = plain.select("page_id", "host", "declared", "suffix", evidence(visible_text(F.col("html"))).alias("text"))

    def normal(logs: Column) -> Column:
        top = F.array_max(logs)
        total = F.aggregate(logs, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.transform(logs, lambda x: F.exp(x - top) / total)

    read = cut(read.withColumn("p", normal(F.col("text"))))
    joined = read
    for column in ("declared", "suffix"):
        joined = joined.join(_likelihood(read, column, names), column)
    joined = joined.join(host_priors(read, names), "host")
    others = F.array(*[F.greatest(F.col("own")[i] - F.col("p")[i], F.lit(0.0)) for i in range(len(names))])
    prior = _mixed(others, F.col("above"), F.col("n") - 1, names)
    joined = joined.withColumn("prior", prior)
    logs = F.array(
        *[F.col("text")[i] + F.col("declared_chance")[i] + F.col("suffix_chance")[i] + F.log(F.col("prior")[i]) for i in range(len(names))]
    )
    joined = joined.withColumn("posterior", normal(logs))
    pick = lambda c: F.array(*map(F.lit, names))[F.array_position(c, F.array_max(c)).cast("int") - 1]
    return joined.select(
        "page_id", "host", "declared", "suffix", pick(F.col("p")).alias("text_lang"), pick(F.col("posterior")).alias("lang"),
        F.array_max("posterior").alias("probability"),
    )
