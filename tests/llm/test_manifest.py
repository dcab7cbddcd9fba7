"""Merkle manifests against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from daypanel.llm import manifest, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string, size int, of string, steps int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, n_chars):
    return H(*map(field, (row[0], row[3], row[2], n_chars, row[1])))


def climb(nodes):
    """Root and, per node, its steps (sibling or None, stands right)."""
    steps, level, under = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, above = [], []
        for k in range(0, len(level), 2):
            run = level[k : k + 2]
            for side, i in enumerate(range(k, k + len(run))):
                for n in under[i]:
                    steps[n].append((run[1 - side] if len(run) > 1 else None, side == 1))
            up.append(H(*run))
            above.append([n for i in range(k, k + len(run)) for n in under[i]])
        level, under = up, above
    return level[0], steps


def wanted(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: b"" if x is None else b"=" + x.encode())
    trees = {}
    for lang in order:
        ranked = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = ranked, *climb([leaf(r, r[4]) for r in ranked])
    root, tops = climb([trees[x][1] for x in order])
    out = []
    for k, lang in enumerate(order):
        ranked, subroot, steps = trees[lang]
        for r, own in zip(ranked, steps):
            path = own + tops[k]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            fold = leaf(r, r[4] + 1 if touched else r[4])
            for other, right in path:
                fold = H(other, fold) if right else H(fold, other or "")
            proof = H(*[s for s, _ in path if s])
            out.append((r[0], leaf(r, r[4]), subroot, root, proof, fold, fold == root))
    return sorted(out, key=str)


def rows_of(n):
    text = "Ünïcode line\n" * 3
    rows = [(i, f"{text}{i}", ["en", "de", "fr"][i % 3] if i % 11 else "en", f"s{i % 4}", i) for i in range(n)]
    rows += [(900, None, "en", None, None), (901, "", "", "", 0), (None, "x", None, "s", 3), (902, "y", None, None, None)]
    rows += [(7, "same", "de", "s", 4)] * 5 + [(903, "z" * 500_000, "ж", "s", 500_000), (None, "q", "de", "s", 1), (None, "p", "de", "s", 1)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "o", 2) for r in rows], SCHEMA).repartition(5)


def through_query(spark, tmp_path, monkeypatch, rows, bits):
    table(spark, rows).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    made = manifest.manifest
    monkeypatch.setattr(manifest, "manifest", lambda docs, **k: made(docs, bits, **k))
    return sorted(map(tuple, queries.QUERIES["op12_nested_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("n, bits", [(60, 2), (200, 3), (0, 6)])
def test_manifest(spark, tmp_path, monkeypatch, n, bits):
    rows = rows_of(n)
    got = through_query(spark, tmp_path, monkeypatch, rows, bits)
    assert got == wanted(rows)
    assert n == 0 or 0 < sum(not r[-1] for r in got) < len(got)


def test_one_leaf_and_none(spark, tmp_path, monkeypatch):
    only = [(5, "t", "en", "s", 1)]
    assert through_query(spark, tmp_path, monkeypatch, only, 6) == wanted(only)
    empty = manifest.manifest(table(spark, only).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "steps"]


def test_a_proof_holds_for_its_row_only(spark):
    rows = manifest.manifest(table(spark, rows_of(40)), bits=2)
    other = F.when(F.col("doc_id") == 3, F.sha2(F.lit("forged"), 256)).otherwise(F.col("leaf"))
    bad = rows.filter(manifest.folded(other, "steps") != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [3]


def test_no_join_and_one_shuffle_a_round(spark):
    nodes = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("tree"), F.col("id").alias("rank"), F.lit(100).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("digest"),
        F.struct("id").alias("of"),
    )
    plan = manifest.rolled_up(nodes, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
