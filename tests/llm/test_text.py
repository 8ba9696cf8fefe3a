"""Byte spans, hashes and pieces against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import pretokens
from caselight.llm import text as T

MIXED = [None, "", " ", "\n\n", "a", "a b", "  a\t\tb\x0bc ", "é ß\xa0x", "日本 語", "x" * 5000, "a\nb\n\nb"]


def test_words_are_split_as_bytes_split():
    data, bounds = T.buffer(pa.array(MIXED))
    starts, ends = T.words(data, bounds)
    raw = data.tobytes()
    found = [raw[a:b] for a, b in zip(starts, ends)]
    assert found == [w for x in MIXED for w in (x or "").encode().split()]
    limits = T.per_text(starts, bounds)
    assert np.diff(limits).tolist() == [len((x or "").encode().split()) for x in MIXED]


def test_sliced_columns_keep_their_texts():
    data, bounds = T.buffer(pa.array(MIXED).slice(4, 3))
    assert data.tobytes() == "".join(x or "" for x in MIXED[4:7]).encode()
    assert bounds[0] == 0 and len(bounds) == 4


def test_equal_spans_have_equal_hashes_anywhere():
    data, bounds = T.buffer(pa.array(["one two one", "two\none"]))
    starts, ends = T.words(data, bounds)
    h = T.span_hashes(data, starts, ends).tolist()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    assert T.span_hashes(data, np.array([0]), np.array([0]))[0] != h[0]


def test_parts_cover_the_batch_in_order():
    batch = pa.record_batch({"t": ["a" * n for n in (5, 90, 3, 200, 0, 0, 7)]})
    parts = list(T.parts(batch, "t", 100))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert len(parts) > 1


@pytest.mark.parametrize("seed", range(5))
def test_pieces_are_those_of_the_pattern(seed):
    rng = random.Random(seed)
    signs = list("abz  \n\t'strvemld09!?") + ["é", "×", "÷", "日", "\x1c", "\x85", "'ll", "'re", " '", "\xa0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    pieces, limits = pretokens.cut(*T.buffer(pa.array(texts)))
    for k, x in enumerate(texts):
        assert pieces[limits[k] : limits[k + 1]] == [p.encode() for p in pretokens._PATTERN.findall(x)]


def test_numbers_start_again_past_their_bound():
    seen = []
    numbered = pretokens.Numbered(seen.extend, seen.clear, most=3)
    assert numbered([b"a", b"b", b"a"]).tolist()[0] == numbered([b"a"]).tolist()[0]
    numbered([b"c", b"d"])
    numbered([b"e"])
    assert seen == [b"e"]
