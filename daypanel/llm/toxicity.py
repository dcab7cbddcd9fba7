"""Toxicity by a subsequence string-kernel SVM on Nyström landmarks.

Texts are cut into sentences and these into units: lower-cased tokens without the marks inside them, where a
run of single letters makes one unit, so that ``i.d.i.o.t`` and ``i d i o t`` read as written together. Units
are compared by the gap-weighted subsequence kernel: all common subsequences of ``ORDER`` letters count, damped
by ``DECAY`` per letter they span, so inserted or changed letters lower the value a little only. Kernel values
against ``LANDMARKS`` strings, whitened by the landmarks' own kernel, are the features of a linear SVM.

A sentence scores as its highest unit. Only documents carry labels, so the SVM is trained on the witness
sentences of toxic documents and all sentences of clean ones, and witnesses are chosen anew in each round. A
document's score is a logistic function of its highest sentences and its length, fitted on the same documents.

Training reads a bounded sample: the first ``TRAIN_DOCS`` labelled documents of each class in the order of a
hash, those of at most ``TRAIN_BYTES``. Scoring reads every whole text. Null and empty texts have no
units and get the score of an empty text. With no labels of both classes every score is the share of toxic
labels, or 0. Repeated labels of a document count as toxic if any is. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_DOCS = 1200
TRAIN_BYTES = 20_000
ORDER = 3
DECAY = 0.7
LANDMARKS = 96
ROUNDS = 3
HIDDEN = 0.01  # weight of a toxic document whose insults were changed, against the one as it is
VARIANTS = 2  # copies with an inserted letter that the SVM sees of each witness
SPAN = 24  # letters of a unit compared at once; longer units are read in overlapping spans
TOP = 3  # sentences whose scores make a document's
REMEMBERED = 300_000  # unit scores that a task keeps

_MARKS = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]\s")


def sentence_units(sentence: str) -> set[str]:
    """Units of a sentence in lower case."""
    out, letters = set(), []
    for token in sentence.split():
        bare = token if token.isalnum() else _MARKS.sub("", token)
        if len(bare) == 1:
            letters.append(bare)
            continue
        if len(letters) > 2:
            out.add("".join(letters))
        letters = []
        if len(bare) >= ORDER:
            out.add(bare)
    if len(letters) > 2:
        out.add("".join(letters))
    return out


def sentences(text: str | None) -> list[str]:
    return _SENTENCE.split((text or "").lower())


def _spans(unit: str) -> list[str]:
    if len(unit) <= SPAN:
        return [unit]
    return [unit[a : a + SPAN] for a in range(0, len(unit) - SPAN // 2, SPAN // 2)]


def _codes(units: list[str]) -> np.ndarray:
    """Letters of units of one length."""
    joined = "".join(units).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.int32).reshape(len(units), -1)


_placed: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of three letters of n, and their weights by the span they cover."""
    if n not in _placed:
        at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
        _placed[n] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1.0)).astype(np.float32)
    return _placed[n]


def _own(letters: np.ndarray) -> np.ndarray:
    """Kernel of each unit with itself, by the usual recursion over both copies."""
    b, n = letters.shape
    total = np.zeros(b, np.float32)
    # open_[q][j]: weight of the pairs of q letters from the first copy so far and j letters of the second
    open_ = [np.ones((n + 1, b), np.float32)] + [np.zeros((n + 1, b), np.float32) for _ in range(ORDER - 1)]
    square = np.float32(DECAY * DECAY)
    for i in range(n):
        same = (letters[:, i : i + 1] == letters).T * square
        total += (same * open_[-1][:-1]).sum(0)
        for q in range(ORDER - 1, 0, -1):
            closing = np.zeros(b, np.float32)
            for j in range(n):
                closing = DECAY * closing + same[j] * open_[q - 1][j]
                open_[q][j + 1] = DECAY * open_[q][j + 1] + closing
    return total


class Landmarks:
    """Strings that units are compared with, as weights of their three-letter subsequences.

    The kernel is the inner product of these weights, so a weighted sum over landmarks is one table.
    """

    def __init__(self, strings: list[str]):
        self.strings = strings
        letters = sorted({ord(c) for s in strings for c in s})
        self.size = len(letters) + 1  # letter 0 stands for all that no landmark has
        self.letters = np.array(letters, np.int32)
        self.table = np.zeros((self.size**ORDER, len(strings)), np.float32)
        for column, s in enumerate(strings):
            at, weight = _triples(len(s))
            np.add.at(self.table[:, column], self._numbers(_codes([s]), at)[0], weight)
        norm = np.sqrt(np.einsum("tm,tm->m", self.table, self.table))
        self.table /= np.maximum(norm, np.float32(1e-6))

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """The table of the weighted sum; the single columns are dropped."""
        out = self.table @ weights[:, None].astype(np.float32)
        self.table = np.zeros((0, 0), np.float32)
        return out

    def _numbers(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.letters, codes)
        place[place == len(self.letters)] = 0
        known = np.where(self.letters[place] == codes, place + 1, 0) if len(self.letters) else np.zeros_like(codes)
        return (known[:, at[:, 0]] * self.size + known[:, at[:, 1]]) * self.size + known[:, at[:, 2]]

    def values(self, units: list[str], table: np.ndarray | None = None) -> np.ndarray:
        """Normalised kernel of units with the columns of ``table``; a long unit has the highest of its spans."""
        table = self.table if table is None else table
        out = np.full((len(units), table.shape[1]), -np.inf, np.float32)
        by_length: dict[int, list[tuple[int, str]]] = {}
        for row, unit in enumerate(units):
            for span in _spans(unit):
                by_length.setdefault(len(span), []).append((row, span))
        for n, all_spans in by_length.items():
            at, weight = _triples(n)
            step = max(16, (1 << 21) // max(1, len(at)))
            for a in range(0, len(all_spans), step):
                rows = [r for r, _ in all_spans[a : a + step]]
                codes = _codes([s for _, s in all_spans[a : a + step]])
                numbers = self._numbers(codes, at)
                value = np.zeros((len(rows), table.shape[1]), np.float32)
                for k in range(len(at)):
                    value += weight[k] * table[numbers[:, k]]
                value /= np.sqrt(np.maximum(_own(codes), 1e-12))[:, None]
                np.maximum.at(out, rows, value)
        return out


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    return Landmarks(landmarks).values(units)


@dataclass
class Model:
    landmarks: Landmarks | None
    table: np.ndarray  # the SVM's weights folded into one column of subsequence weights
    offset: float
    document: np.ndarray  # logistic weights of the document features

    def unit_scores(self, units: list[str]) -> np.ndarray:
        if self.landmarks is None or not units:
            return np.full(len(units), -2.0)
        return self.landmarks.values(units, self.table)[:, 0] + self.offset

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.document, -500, 500)))



class Scorer:
    """Unit scores of a model with the ones seen before remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Feature rows: one, the ``TOP`` highest sentence scores, log length."""
        cut = [[sentence_units(s) for s in sentences(t)] for t in texts]
        known = self.known
        new = sorted({u for doc in cut for s in doc for u in s if u not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = sorted({u for doc in cut for s in doc for u in s})
        known.update(zip(new, np.clip(self.model.unit_scores(new), -2, 2).tolist()))
        out = np.full((len(cut), TOP + 2), -2.0)
        for row, doc in zip(out, cut):
            scores = sorted((max(map(known.__getitem__, s)) for s in doc if s), reverse=True)
            row[0] = 1
            row[1 : 1 + min(TOP, len(scores))] = scores[:TOP]
            row[TOP + 1] = np.log1p(len(scores))
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; ``weight`` sums to one."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-9
    for _ in range(40):
        gap = 1 - y * (x @ w)
        on = gap > 0
        xa, wa = x[on], weight[on]
        slope = keep * w - xa.T @ (wa * y[on] * gap[on])
        step = np.linalg.solve(xa.T @ (xa * wa[:, None]) + np.diag(keep), slope)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (weight * (p - y)) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _spread(units: list[str], count: int) -> list[str]:
    """Up to ``count`` units, each the one least like those taken before, the first ones first."""
    if len(units) <= count:
        return list(units)
    taken, near = [0], kernel(units, [units[0]])[:, 0]
    while len(taken) < count:
        nxt = int(np.argmin(near))
        if near[nxt] > 0.999:
            break
        taken.append(nxt)
        near = np.maximum(near, kernel(units, [units[nxt]])[:, 0])
    return [units[i] for i in taken]


def fitted(texts: list[str], toxic: list[int], toxic_share: float) -> Model:
    """Model of labelled documents; ``toxic_share`` is the share of toxic ones among all labelled rows."""
    y = np.asarray(toxic)
    bias = np.zeros(TOP + 2)
    bias[0] = np.log(max(toxic_share, 1e-9) / max(1 - toxic_share, 1e-9))
    if len(set(toxic)) < 2:
        return Model(None, np.zeros((0, 1)), -2.0, bias)
    one: dict[str, str] = {}  # each unit once in memory
    docs = [[tuple(one.setdefault(u, u) for u in s) for s in map(sentence_units, sentences(t)) if s] for t in texts]
    counts: dict[str, list[int]] = {}
    for doc, label in zip(docs, toxic):
        for unit in set().union(*doc):
            counts.setdefault(unit, [0, 0])[label] += 1
    total = np.bincount(y, minlength=2)
    score = {u: np.log((c[1] + 0.1) / total[1]) - np.log((c[0] + 0.5) / total[0]) for u, c in counts.items()}
    model = Model(None, np.zeros((0, 1)), 0.0, bias)
    for turn in range(ROUNDS):
        top = lambda s: max(s, key=lambda u: (score[u], u))
        bad: dict[str, int] = {}
        for doc, label in zip(docs, toxic):
            if label:
                for u in sorted({top(s) for s in doc}, key=lambda u: -score[u])[:2]:
                    bad[u] = bad.get(u, 0) + 1
        good: dict[str, int] = {}
        for doc, label in zip(docs, toxic):
            if not label:
                for s in doc:
                    u = top(s)
                    good[u] = good.get(u, 0) + 1
        bad = {u: n for u, n in bad.items() if u not in good or turn == 0}
        hard = sorted(good, key=lambda u: -score[u])[:400]
        wicked = sorted(bad, key=lambda u: (-bad[u], u))[:600]
        marks = _spread(wicked, LANDMARKS * 2 // 3) + _spread([u for u in hard if u not in bad], LANDMARKS // 3)
        landmarks = Landmarks(marks)
        value, vector = np.linalg.eigh(landmarks.values(marks).astype(float))
        whiten = vector @ np.diag(np.where(value > 1e-4, 1 / np.sqrt(np.maximum(value, 1e-4)), 0)) @ vector.T
        changed = [_inserted(u, k) for u in wicked for k in range(VARIANTS) if len(u) > ORDER + 1]
        units = list(bad) + changed + list(good)
        x = landmarks.values(units) @ whiten.astype(np.float32)
        side = np.r_[np.ones(len(bad) + len(changed)), -np.ones(len(good))]
        weight = np.r_[np.sqrt(list(bad.values())), np.full(len(changed), 0.2), np.sqrt(list(good.values()))]
        for label in (1, -1):
            weight[side == label] /= 2 * max(1e-9, weight[side == label].sum())
        w, offset = _svm(x, side, weight)
        model = Model(landmarks, landmarks.folded(whiten @ w), offset, bias)
        every = list(counts)
        score = dict(zip(every, model.unit_scores(every).tolist()))
    # Toxic documents count again, with less weight, with a letter put into every insult.
    hidden = []
    for text, doc, label in zip(texts, docs, toxic):
        if label:
            text = text.lower()
            for u in {u for s in doc for u in s if score[u] > 0}:
                text = text.replace(u, _inserted(u, VARIANTS))
            hidden.append(text)
    scorer_ = Scorer(model)
    both = texts + hidden
    features = np.vstack([scorer_.documents(both[a : a + 200]) for a in range(0, len(both), 200)])
    share = np.where(y == 1, toxic_share / total[1], (1 - toxic_share) / total[0]) * len(y)
    share = np.r_[share, np.full(len(hidden), HIDDEN * toxic_share / total[1] * len(y))]
    model.document = _logistic(features, np.r_[y, np.ones(len(hidden))], share)
    return model


def _inserted(unit: str, turn: int) -> str:
    """The unit with one letter or digit put in somewhere inside, by a fixed draw."""
    draw = np.random.default_rng([turn, *unit.encode()])
    at = int(draw.integers(1, len(unit)))
    return unit[:at] + "abcdefghijklmnopqrstuvwxyz0123456789"[int(draw.integers(36))] + unit[at:]


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Model fitted on the bounded sample of labelled rows that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    # Drawn among the ids whose text fits; texts meet the drawn ids only, so none is sorted or sent before it is chosen.
    short = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, TRAIN_BYTES))
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    drawn = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for c in (0, 1)]
    met = short.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")  # at most 2 * TRAIN_DOCS ids
    rows = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return fitted([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def scorer(model: Model):
    """Column function: the probability that a text is toxic."""
    sent: dict[str, object] = {}

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if "scorer" not in sent:
            sent["scorer"] = Scorer(model)
        out = []
        values = texts.to_pylist()
        for a in range(0, len(values), 200):
            out.append(model.probability(sent["scorer"].documents(values[a : a + 200])))
        return pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    score = scorer(trained(docs, labels))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = scorer(trained(docs, labels))
    rows = docs.select(F.struct("*").alias("_row"), score(F.coalesce("text", F.lit(""))).alias("_score"))
    return rows.filter(F.col("_score") < 0.5).select("_row.*")
