from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "ß", "é", "漢", "1", "½", "²", "!", "<|endoftext|>", "<|endof", "the", "ing", "\xa0", "🙂", "\t", "re", "_",
         "a" * 300, "=" * 700, " " * 400, "ab" * 400, "1" * 500, "\n" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pairs():
    with open(PATH, encoding="utf-8") as f:
        return bpe.parsed(f.read())


def test_same_tokens_as_the_library(library, pairs):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", "word " * 30_000, "x" * 100_000]
    for text, got in zip(texts, pairs.encode_many(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want == list(pairs.encode(text))
        assert "".join(pairs.decode(want)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([p for p in PARTS if "<|" not in p]), max_size=25), st.lists(st.sampled_from([1, 2, 3, 7, 50, 400]), min_size=1))
def test_chunks_do_not_matter(library, pairs, parts, steps):
    text, chunks, at = "".join(parts), [], 0
    while at < len(text):
        step = steps[len(chunks) % len(steps)]
        chunks.append(text[at : at + step])
        at += step
    assert list(pairs.encode(iter(chunks))) == library.encode(text, add_special_tokens=False).ids


def test_tokens_before_the_lookahead_are_stable(pairs):
    """What the transducer emits early is what the whole piece gives, whatever follows."""
    rng = random.Random(3)
    for _ in range(40):
        word = "".join(rng.choice("abe thing") for _ in range(pairs.lookahead + 300)).encode()
        whole, some = pairs.merge(word), list(pairs.stream([word[i : i + 11] for i in range(0, len(word), 11)]))
        assert some == whole


def test_characters_cut_between_tokens(pairs):
    text = "🙂é漢" * 50
    tokens = list(pairs.encode(text))
    assert "".join(pairs.decode(tokens, block=1)) == text
    assert "".join(pairs.decode(tokens[:1])) == "�" or len(tokens) == 1 or pairs.bytes[tokens[0]].decode("utf-8", "replace")


def test_columns(spark, docs, library):
    rows = [(1, "The theory"), (2, None), (3, ""), (4, "long " * 40_000), (5, "<|endoftext|>x"), (None, "The theory")]
    df = bpe.encode_and_decode(docs(rows), PATH)
    apart = bpe.decode(bpe.encode(docs(rows), PATH), PATH)
    assert df.columns == apart.columns and df.select("doc_id", "ids", "decoded").exceptAll(apart.select("doc_id", "ids", "decoded")).isEmpty()
    got = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        hexed = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text or "")]
        assert got[(i, len(ids))] == tuple(hexed)
    assert bpe.encode_and_decode(docs([]), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded is None
