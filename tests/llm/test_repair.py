"""Conversation repair against plain Python."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from daypanel.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, block string, position int"
BLANK = re.compile(r"^[\x20\x09-\x0D]*$")
STOPPED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}
INSERTED = {"": ("u", "user"), "s": ("u", "user"), "u": ("p", "assistant"), "p": ("u", "user")}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def mended(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        faults.append("blank" if BLANK.match(text) else "duplicate" if (role, text) in seen else "" if STOPPED.search(text) else "truncated")
        seen.add((role, text))
    pairs = [x[2][:1] + y[2][:1] for x, y in zip(rows, rows[1:])]

    @cache
    def best(i, state, inserts=2):
        found = []
        if i == len(rows) and state in ("", "p"):
            found.append((0, "", ()))
        if inserts:
            to, role = INSERTED[state]
            c, a, t = best(i, to, inserts - 1)
            found.append((c + 2, "I" + a, (f"{role}:", *t)))
        if i < len(rows):
            _, _, role, text = rows[i]
            extra = int(faults[i] == "truncated")
            c, a, t = best(i + 1, state)
            found.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] in NEXT[state]:
                    c, a, t = best(i + 1, NEXT[state][role[:1]])
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
                to, new = INSERTED[state]
                c, a, t = best(i + 1, to)
                found.append((c + 2 + extra, "R" + a, (f"{new}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    for i in range(len(rows), -1, -1):  # fill the cache from the end: long conversations do not recurse deeply
        for s in NEXT:
            for k in (0, 1, 2):
                best(i, s, k)
    cost, audit, lines = best(0, "")
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def wanted(rows, damaged=None):
    groups = {r[0]: [] for r in rows}
    for r in rows if damaged is None else damaged:
        groups[r[0]].append(r)
    return sorted([(c, *mended(g)) for c, g in groups.items()], key=str)


def talk(seed, n, conv):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "a"]
    texts = ["Yes.", "no", "", " \t", None, "Why?  ", "Ünd so!\n", "x. y", "user:"]
    return [(conv, int(t) if rng.random() > 0.1 else None, roles[rng.choice(7, p=[0.35, 0.3, 0.1, 0.1, 0.05, 0.05, 0.05])], texts[rng.integers(9)] if rng.random() < 0.5 else f"{rng.integers(1e6)}.") for t in rng.integers(0, 2 * n + 1, n)]


def odd_rows():
    rows = [r for k in range(60) for r in talk(k, k % 9, k)]
    rows += talk(99, 30, None) + talk(98, 150, 1000) + [(1001, 0, "system", "s."), (1002, None, None, None), (1003, 1, "user", "a. " * 200_000)]
    rows += [(1004, k, "user", "same.") for k in range(40)] + [(1005, 3, "assistant", "twice.")] * 6
    return [(c, t, r, " " if x is None else x) for c, t, r, x in rows]


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "b", 2) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("block, fan", [(1024, 256), (3, 2), (1, 3)])
def test_repairs(spark, block, fan):
    rows = odd_rows()
    plain = [(c, t, " " if r is None else r, x) for c, t, r, x in rows]
    got = sorted(map(tuple, repair.repaired(table(spark, rows), block=block, fan=fan).collect()), key=str)
    assert got == wanted(plain)


def test_query_damages_first(spark, tmp_path):
    rows = odd_rows() + [(k, k % 7, None, None) for k in range(2000, 2060)]
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op11_doubling_repair"](spark, str(tmp_path)).collect()), key=str)
    want = wanted(rows, damage(rows))
    assert got == want
    assert any(w[7] == "" and w[6] == 0 for w in want)  # a conversation that lost all rows


def test_empty(spark):
    assert repair.repaired(table(spark, odd_rows()).limit(0)).count() == 0


def test_ranks_order_edits():
    """Nodes of one batch are ranked as their whole rows of edits (label, then role) are."""
    rng = np.random.default_rng(4)
    codes = rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 10], (50, 12))
    paths = repair.LeastPaths(codes, rng.integers(0, 13, 50), np.broadcast_to(repair._CLOSING, (50, 4)))
    ranks = paths.rank[paths.node[0][:, 0]]
    edits = [list(zip((" DIKR".index(x) for x in audit), roles)) for audit, _, roles in paths.read(np.zeros(50, int))]
    for i in range(50):
        for j in range(50):
            assert (ranks[i] < ranks[j]) == (edits[i] < edits[j])
    assert len(set(ranks)) > 10
