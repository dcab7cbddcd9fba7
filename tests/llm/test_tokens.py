"""Token counts against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from daypanel.llm import queries, tokens, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", " ", "  ", "\n", "'", "'s", "'re", "'ll", "'v", "''", "é", "1", "23", "!", "<|endoftext|>", "<|endof", "=", "-", "　", "日本", "🙂", "don't", "the", "ing", "\t", "\x00", "\x85", "Ᲊ"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    spec = tokens.vocabulary(PATH)
    return tokens.Counter(spec["tokens"], spec["merges"]), tokens.Classes(), spec["special"]


def counted(machine, texts, chunk=tokens.CHUNK):
    return tokens.count_tokens(pa.array(texts, pa.string()), *machine, chunk).tolist()


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x <|endoftext|>  "]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [unit * n for unit in ("a", "ab", "=", "-", " ", "é", "\n", "the") for n in (1, 63, 64, 65, 700, 3001)]
    texts.append("".join(rng.choice("abcdefghijklmnop") for _ in range(5000)))
    texts.append("".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(5000)))
    return texts


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_counts_are_the_library_s(machine, library, chunk):
    texts = odd_texts()
    assert counted(machine, texts, chunk) == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=30).map("".join)), max_size=6))
def test_any_text(machine, library, texts):
    assert counted(machine, texts, 5) == library(texts)


def test_a_small_table_is_emptied_and_counts_stay(library):
    spec = tokens.vocabulary(PATH)
    small, texts = tokens.Counter(spec["tokens"], spec["merges"], transitions=3000), odd_texts()
    emptied, empty = [], small._empty
    small._empty = lambda: (emptied.append(1), empty())
    assert counted((small, tokens.Classes(), spec["special"]), texts, 16) == library(texts)
    assert emptied and small.known <= 3000 + len(texts)


def test_merges_alone_decide_what_follows(machine):
    """Every pair of tokens that may follow each other is what merging their bytes gives, and no other pair is."""
    merges, rng = machine[0].merges, random.Random(5)
    spec = tokens.vocabulary(PATH)
    by_bytes = {v: k for k, v in spec["tokens"].items()}
    ids = sorted(spec["tokens"])

    def merged(text):
        out = [by_bytes[bytes([b])] for b in text]
        while len(out) > 1:
            rank, i = min((merges.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(out, out[1:])))
            if rank == 1 << 30:
                break
            out[i : i + 2] = [by_bytes[spec["tokens"][out[i]] + spec["tokens"][out[i + 1]]]]
        return out

    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids[:3000])
        assert merges.follows(a, b) == (merged(spec["tokens"][a] + spec["tokens"][b]) == [a, b])


def test_query_and_frames(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_transducer_token_counts"](spark, folder).collect()
    want = dict(zip(docs, library(list(docs.values()))))
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(docs)
    assert all(r.n_bytes == len((docs[r.doc_id] or "").encode()) and r.over_limit == (want[r.doc_id] > 1024) for r in rows)


def test_nulls_repeats_and_clashing_names(spark, library):
    texts = ["same text", "same text", None, "", "long " * 300_000]
    docs = spark.createDataFrame([(None, t, "x", 5, "k") for t in texts], "doc_id long, text string, n_tokens string, n_bytes int, `a.b` string")
    got = tokens.token_counts(docs, PATH)
    assert got.columns == ["doc_id", "text", "a.b", "n_bytes", "n_tokens"]
    assert sorted((r.n_bytes, r.n_tokens) for r in got.collect()) == sorted((len((t or "").encode()), n) for t, n in zip(texts, library(texts)))
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_parts_keep_their_order(machine, library):
    texts = ["a b c " * k for k in range(200)]
    array = pa.array(texts)
    got = np.concatenate([tokens.count_tokens(array.slice(a, b - a), *machine) for a, b in words.parts(array, 1000)])
    assert got.tolist() == library(texts)


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        tokens.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
