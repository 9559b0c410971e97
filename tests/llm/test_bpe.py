import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe
from brindle.llm.queries import VOCABULARY

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bpe.coder(VOCABULARY, PATTERN)


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", "a", " ", "\n\n  x ", "a" * 3000, "ab" * 900, " " * 700, "日本語のテキスト" * 90, "\x00\x01\x02", "é́" * 400, "x'll've'S 123456789 __--!!", "<|endoftext|>", "😀👩‍👩‍👧", " \x85\xa0 a", "0" * 1000]


def same(own, other, texts):
    ids, counts = own.encode(texts)
    want = [other.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    data, sizes = own.decode(ids)
    assert data.tobytes() == "".join(texts).encode() and len(sizes) == len(ids)


def test_as_the_library(own, other, prose):
    same(own, other, ODD)
    same(own, other, [prose(s, 200) for s in range(30)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_any_text(own, other, texts):
    same(own, other, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_matrix_and_heap_agree(own):
    rng = np.random.default_rng(2)
    for n in (2, 5, 64, 256):
        piece = bytes(rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), n))
        ids, size = own.merge_rows(own.of_byte[np.frombuffer(piece, np.uint8)][None, :])
        assert ids[0, : size[0]].tolist() == own.merge_long(piece).tolist()


def test_decode_refuses_unknown_ids(own):
    with pytest.raises(ValueError):
        own.decode(np.array([10**6]))


def test_tables(documents, other):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "x"), (0, "again"), (0, "again")]
    ids = bpe.encode(documents(rows), VOCABULARY, PATTERN)
    out = bpe.decode(ids, VOCABULARY, PATTERN, keep=("n_tokens", "ids")).collect()
    got = sorted((str(r.doc_id), bytes(r.decoded).decode(), bytes(r.ids), r.n_tokens) for r in out)
    want = sorted((str(i), t or "", np.array(other.encode_ordinary(t or ""), "<u4").tobytes(), len(other.encode_ordinary(t or ""))) for i, t in rows)
    assert got == want
    checked = bpe.encode(documents(rows), VOCABULARY, PATTERN, keep=("lang",), check=True).collect()
    assert sorted(bytes(r.decoded).decode() for r in checked) == sorted(t or "" for _, t in rows)
    assert bpe.encode(documents([]), VOCABULARY, PATTERN).collect() == []
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
