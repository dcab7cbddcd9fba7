"""Token counts by a compiled transducer of a byte-level BPE vocabulary.

A text's tokens are counted without making them. The tokenizer file is compiled into two transducers:

* The scanner marks where pre-tokens start. Its rule (contractions, runs of letters, digits, other signs or
  white space, with one leading space) looks at three characters to the left and right at most, so all
  places of a batch are decided at once. Character classes are the tokenizer library's own.
* The counter reads the bytes of a pre-token. Its state holds the vocabulary prefixes that end at this byte;
  each knows the last token before it and how many tokens fewer there were then. Reading a byte finishes the
  one token that may follow the one before it, so the transition is annotated with the change of the number
  of tokens. Two tokens may follow each other if no merge across their border comes before those that made
  them. States are found by subset construction the first time a byte leads to them; the table of a worker
  is emptied when it holds ``TRANSITIONS``.

Texts are cut into chunks of ``CHUNK`` bytes that all run at the same time. A chunk is a map from the state
it is entered in to the state it is left in and the tokens counted. Behind the first start of a pre-token the
entry does not matter. Maps hold the entries that occur: those the chunk before leads to and, inside a very
long pre-token, the start as a guess. They are composed by pointer doubling, a parallel prefix scan.

Strings of the tokenizer's special tokens count one token and cut the text, as the library does by default.
Null counts as empty: no bytes, no tokens. Rows that repeat count each. An empty table gives an empty
result. Columns other than the text are passed through; ``n_bytes`` and ``n_tokens`` replace columns of that
name.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import parts, utf8

CHUNK = 256
TRANSITIONS = 1 << 19  # a worker's table holds no more at a time
PART = 4 << 20  # bytes of text that are counted together

_SPACE, _LETTER, _DIGIT, _OTHER, _UNSEEN = range(5)
_NEVER = 1 << 30
_SPREAD = 0x9E3779B97F4A7C15 - (1 << 64)


def _byte_signs() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict:
    """Tokens as bytes, merges as triples of ids, and special strings of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    odd = [a["content"] for a in spec["added_tokens"] if a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or not a["content"]]
    if model["type"] != "BPE" or not plain or not level or spec["normalizer"] or odd:
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    signs, ids = _byte_signs(), model["vocab"]
    tokens = {i: bytes(signs[c] for c in token) for token, i in ids.items() if all(c in signs for c in token)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    made = {c for _, _, c in merges}
    if len(made) < len(merges) or any(len(t) != 1 for i, t in tokens.items() if i not in made) or len({*tokens.values()}) != len(made) + 256:
        raise ValueError("every token must be a byte or made by one merge")
    return {"tokens": tokens, "merges": merges, "special": [a["content"].encode() for a in spec["added_tokens"]]}


class Merges:
    """Which tokens stand as they are, and which may follow each other."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.made = {c: (a, b, r) for r, (a, b, c) in enumerate(merges)}
        self.known: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one end of a token, largest first, and the rank at which each was merged away."""
        out = self.edges.get((token, side))
        if out is None:
            out = [(token, _NEVER)]
            while out[-1][0] in self.made:
                *ends, until = self.made[out[-1][0]]
                out.append((ends[side], until))
            self.edges[token, side] = out
        return out

    def _crossing(self, a: int, b: int, until: int) -> bool:
        """A merge across the border of a and b happens before rank ``until``; of equal ranks the left one is first."""
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                r = self.rank.get((x, y), _NEVER)
                if r < min(x_until, until) and r <= y_until:
                    return True
        return False

    def follows(self, a: int, b: int) -> bool:
        """The bytes of a and b together are encoded as a, b; a is -1 at the start of a pre-token."""
        if a < 0:
            return True
        if (a, b) not in self.known:
            self.known[a, b] = not self._crossing(a, b, _NEVER)
        return self.known[a, b]

    def stands(self, token: int) -> bool:
        """The bytes of the token are encoded as that token."""
        if token not in self.whole:
            a, b, r = self.made.get(token, (-1, -1, 0))
            self.whole[token] = a < 0 or (self.stands(a) and self.stands(b) and not self._crossing(a, b, r))
        return self.whole[token]


class Counter:
    """The byte transducer; state 0 starts a pre-token.

    Its transitions lie in one open hash table: state and byte, the state after it, the change of the count.
    A state is a row of triples (vocabulary prefix, last token before it, tokens then less tokens now).
    """

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], transitions: int = TRANSITIONS):
        self.merges = Merges(merges)
        self.limit = transitions
        self.slots = 1 << (2 * transitions - 1).bit_length()
        self.child: dict[int, int] = {}  # vocabulary prefix and byte -> longer prefix
        self.token = [-1]
        inner = {0}
        for i, token in sorted(tokens.items()):
            if not self.merges.stands(i):
                continue
            at = 0
            for b in token:
                inner.add(at)
                nxt = self.child.setdefault(at << 8 | b, len(self.token))
                if nxt == len(self.token):
                    self.token.append(-1)
                at = nxt
            self.token[at] = i
        self.inner = [n in inner for n in range(len(self.token))]
        self.held: list[np.ndarray] = []  # arrays of state numbers, which are renumbered when the table is emptied
        self._empty()

    def _empty(self) -> None:
        self.keys: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.merges.known.clear()
        self.known = 0
        self.at = np.full(self.slots, -1, np.int64)
        self.after = np.zeros(self.slots, np.int32)
        self.change = np.zeros(self.slots, np.int16)
        self._state(array("i", (0, -1, 0)))

    def _state(self, key: array) -> int:
        packed = key.tobytes()
        found = self.number.setdefault(packed, len(self.keys))
        if found == len(self.keys):
            self.keys.append(packed)
        return found

    def _look_up(self, wanted: np.ndarray) -> np.ndarray:
        """Where the transitions are, or the free slots that end the search for them."""
        slot = (wanted * _SPREAD) & (self.slots - 1)
        other = np.flatnonzero((found := self.at[slot]) != wanted)
        other = other[found[other] >= 0]
        while len(other):
            slot[other] = (slot[other] + 1) & (self.slots - 1)
            found = self.at[slot[other]]
            other = other[(found != wanted[other]) & (found >= 0)]
        return slot

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte and the change of the count."""
        key = iter(array("i", self.keys[state]))
        live, done = [], None
        for node, last, less in zip(key, key, key):
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if token >= 0 and done is None and self.merges.follows(last, token):
                done = token, less + 1
            if self.inner[node]:
                live += (node, last, less)
        token, change = done
        for i in range(2, len(live), 3):
            live[i] -= change
        live += (0, token, 0)
        return self._state(array("i", live)), change

    def _learn(self, wanted: np.ndarray) -> None:
        """Work out transitions that are not in the table."""
        found = [self._transition(w >> 8, w & 255) for w in wanted.tolist()]
        after, change = (np.array(x, np.int64) for x in zip(*found))
        self.known += len(wanted)
        while len(wanted):
            slot = self._look_up(wanted)
            put = np.zeros(len(wanted), bool)
            put[np.unique(slot, return_index=True)[1]] = True
            self.at[slot[put]], self.after[slot[put]], self.change[slot[put]] = wanted[put], after[put], change[put]
            wanted, after, change = wanted[~put], after[~put], change[~put]

    def _make_room(self) -> None:
        """Empty the table, but for the states that somebody still holds."""
        used = np.unique(np.concatenate(self.held))
        keys = [self.keys[s] for s in used]
        self._empty()
        fresh = np.array([self._state(array("i", k)) for k in keys], np.int64)
        for held in self.held:
            held[:] = fresh[np.searchsorted(used, held)]

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Slots of the transitions, which are learnt where they are not known; ``state`` may be renumbered meanwhile."""
        while True:
            wanted = state << 8 | byte
            slot = self._look_up(wanted)
            missing = np.unique(wanted[self.at[slot] < 0])
            if not len(missing):
                return slot
            if self.known + len(missing) > self.limit and self.known:
                self._make_room()
            else:
                self._learn(missing)

    def run(self, data: np.ndarray, fresh: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens counted of the byte runs ``start`` .. ``start + size``; at ``fresh`` bytes a pre-token starts."""
        order = np.argsort(-size, kind="stable")
        start, state = start[order], entry[order].astype(np.int64)
        active = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
        counted = np.zeros(len(order), np.int64)
        self.held.append(state)
        for k, n in enumerate(active.tolist()):
            at = start[:n] + k
            state[:n][fresh[at]] = 0
            slot = self._step(state[:n], data[at])
            counted[:n] += self.change[slot]
            state[:n] = self.after[slot]
        self.held.pop()
        exits, counts = np.empty_like(state), np.empty_like(counted)
        exits[order], counts[order] = state, counted
        return exits, counts


class Classes:
    """Letter, digit, white space or other per code point, asked from the tokenizer library when first seen."""

    def __init__(self):
        self.of = np.full(0x110000, _UNSEEN, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.of[points]
        if (found == _UNSEEN).any():
            self._learn(np.unique(points[found == _UNSEEN]).tolist())
            found = self.of[points]
        return found

    def _learn(self, points: list[int]) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.of[points] = _SPACE
        for before, kind in (("x", _LETTER), ("1", _DIGIT), ("!", _OTHER)):
            starts = {a for _, (a, _) in split("".join(f"\n\n{before}{chr(c)}" for c in points))}
            self.of[[c for i, c in enumerate(points) if 4 * i + 3 not in starts]] = kind


def pretoken_starts(data: np.ndarray, first: np.ndarray, classes: Classes) -> np.ndarray:
    """Per byte whether a pre-token starts there; ``first`` marks the first byte of each text."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    n, c = len(at), data[at].astype(np.int64)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
    one, two, three = padded[at + 1], padded[at + 2], padded[at + 3]
    point = np.where(
        c < 0x80, c,
        np.where(c < 0xE0, (c & 0x1F) << 6 | one, np.where(c < 0xF0, (c & 0x0F) << 12 | one << 6 | two, (c & 0x07) << 18 | one << 12 | two << 6 | three)),
    )
    kind, opens = classes(point), first[at]
    ends = np.append(opens[1:], True)[:n]  # the last character of a text
    space = kind == _SPACE
    before, after = np.roll(kind, 1), np.append(kind[1:], _SPACE)[:n]
    blank = np.append(False, point == 32)[:n]
    starts = np.where(space, (before != _SPACE) | (~ends & (after != _SPACE)), ~blank & (before != kind))
    starts |= opens
    # A contraction is a pre-token of its own, if its apostrophe starts one.
    ticks = np.flatnonzero((point == 39) & starts & ~ends)
    for tails in (("s", "t", "m", "d"), ("re", "ve", "ll")):
        size = len(tails[0])
        inside = ticks[ticks + size < n]
        for j in range(1, size):
            inside = inside[~ends[inside + j]]
        match = np.zeros(len(inside), bool)
        for tail in tails:
            match |= np.logical_and.reduce([point[inside + 1 + j] == ord(x) for j, x in enumerate(tail)])
        inside = inside[match]
        for j in range(1, size + 1):
            starts[inside + j] = False
        behind = inside[inside + size + 1 < n] + size + 1
        starts[behind] = True
    out = np.zeros(len(data), bool)
    out[at] = starts
    return out


def _without_special(at: np.ndarray, data: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds and bytes without special strings, the first bytes of the pieces left, and specials per row."""
    rows = len(at) - 1
    found = np.zeros(rows, np.int64)
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    raw = data.tobytes()
    if not any(s in raw for s in special):
        return at, data, first, found
    pattern = re.compile(b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
    keep = np.ones(len(data), bool)
    for row in range(rows):
        for m in pattern.finditer(raw, at[row], at[row + 1]):
            found[row] += 1
            keep[m.start() : m.end()] = False
            if m.end() < at[row + 1]:
                first[m.end()] = True
    for i in np.flatnonzero(first & ~keep):  # a special string right behind another or at the start of its text
        j = i
        while j < len(keep) and not keep[j]:
            j += 1
        if j < len(keep):
            first[j] = True
    return np.concatenate([[0], np.cumsum(keep)])[at], data[keep], first[keep], found


def count_tokens(texts: pa.Array, counter: Counter, classes: Classes, special: list[bytes], chunk: int = CHUNK) -> np.ndarray:
    """Tokens per text."""
    at, data, first, total = _without_special(*utf8(texts), special)
    fresh = pretoken_starts(data, first, classes)
    n_chunks = -(-np.diff(at) // chunk)
    row = np.repeat(np.arange(len(at) - 1), n_chunks)
    opening = np.concatenate([[0], np.cumsum(n_chunks)])
    start = at[row] + (np.arange(len(row)) - opening[row]) * chunk
    size = np.minimum(chunk, at[row + 1] - start)
    more = np.append(row[1:] == row[:-1], False)[: len(row)]  # another chunk of the same text follows

    # A chunk's head is what comes before its first start of a pre-token; from there on the entry plays no part.
    next_start = np.append(np.flatnonzero(fresh), len(data))
    head = np.minimum(next_start[np.searchsorted(next_start, start)] - start, size)
    exits, body = counter.run(data, fresh, start + head, size - head, np.zeros(len(start), np.int64))
    long = head == size  # no pre-token starts here

    # The maps: (chunk, entry) -> (exit, tokens), for all entries that occur.
    chunks = np.flatnonzero((head == 0) | long)
    pairs = [np.empty(0, np.int64) for _ in range(4)]  # chunk, entry, exit, tokens
    new_chunk, new_entry = chunks, np.zeros(len(chunks), np.int64)
    before = np.flatnonzero(more & ~long)
    before = before[head[before + 1] > 0]
    new_chunk, new_entry = np.append(new_chunk, before + 1), np.append(new_entry, exits[before])
    while len(new_chunk):
        counter.held = [exits, pairs[1], pairs[2], new_entry]
        left, counted = counter.run(data, fresh, start[new_chunk], head[new_chunk], new_entry)
        counter.held = []
        is_long = long[new_chunk]
        left = np.where(is_long, left, exits[new_chunk])
        pairs = [np.append(p, x) for p, x in zip(pairs, (new_chunk, new_entry, left, counted + np.where(is_long, 0, body[new_chunk])))]
        onward = is_long & more[new_chunk]
        new_chunk, new_entry = new_chunk[onward] + 1, left[onward]
        new_entry = np.where(head[new_chunk] > 0, new_entry, 0)
        ask = np.unique(new_chunk << 32 | new_entry)
        ask = ask[~np.isin(ask, pairs[0] << 32 | pairs[1])]
        new_chunk, new_entry = ask >> 32, ask & 0xFFFFFFFF

    at_chunk, entry, left, counted = pairs
    key = at_chunk << 32 | entry
    order = np.argsort(key)
    key, at_chunk, left, counted = key[order], at_chunk[order], left[order], counted[order]
    # Compose: each map points to the one its exit enters; the last of a text points to itself and adds nothing more.
    goes_on = more[at_chunk]
    follower = np.where(goes_on, at_chunk + 1, at_chunk)
    enters = np.where(head[np.minimum(follower, len(head) - 1)] > 0, left, 0) if len(head) else left
    pointer = np.where(goes_on, np.searchsorted(key, follower << 32 | enters), len(key))
    pointer, counted = np.append(pointer, len(key)), np.append(counted, 0)
    while (pointer[:-1] < len(key)).any():
        counted = counted + counted[pointer]
        pointer = pointer[pointer]
    filled = np.flatnonzero(n_chunks)
    total[filled] += counted[np.searchsorted(key, opening[filled] << 32)]
    return total


def counter(spark: SparkSession, path: str) -> Callable[[Column | str], Column]:
    """A column function: tokens of a text column under the tokenizer file at ``path``.

    Only the vocabulary is sent to the tasks. A worker compiles it once and keeps its tables from task to task.
    """
    sent = spark.sparkContext.broadcast(vocabulary(path))

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        spec = sent.value
        if "machine" not in spec:
            spec["machine"] = Counter(spec["tokens"], spec["merges"]), Classes()
        done = [count_tokens(texts.slice(a, b - a), *spec["machine"], spec["special"]) for a, b in parts(texts, PART)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *done]), pa.int64())

    return count


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of the text column."""
    count = counter(docs.sparkSession, path)
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    return docs.select(*kept, n_bytes.alias("n_bytes"), count(text).alias("n_tokens"))
