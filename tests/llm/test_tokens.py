"""BPE against the tokenizers library, word pieces against greedy matching."""

import hashlib
import itertools
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from caselight.llm import bpe, pretokens, token_counts
from caselight.llm.queries import VOCABULARY

EDGES = [None, "", " ", "\n", "a", "it's", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "ß÷日😀\x00", "aa" * 4000]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary.read(VOCABULARY))


@pytest.mark.parametrize("seed", range(3))
def test_ids_and_decoded_text(codec, library, seed):
    rng = random.Random(seed)
    signs = list("abz  \n\t'strvemld09!?") + ["é", "×", "日", "'ll", "<|endoftext|>", "the ", "ing", "😀", "aaaaaaaa"]
    texts = EDGES + ["".join(rng.choice(signs) for _ in range(rng.choice([1, 3, 30, 300]))) for _ in range(150)]
    ids, bounds, told = codec.encode(pa.array(texts))
    back = codec.decode(ids, bounds)
    for k, x in enumerate(texts):
        want = library.encode(x or "", add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want
        assert told[k] == ",".join(map(str, want))
        assert back[k].decode() == library.decode(want, skip_special_tokens=False) == (x or "")


def test_bytes_that_are_no_text_are_replaced(codec):
    lone = codec.words.byte_ids[[0xE6, 0x41]]
    import numpy as np

    assert codec.decode(lone, np.array([0, 1, 2])) == ["�".encode(), b"A"]


def test_digests_and_round_trip(spark, library):
    rows = [(i, x, "clash") for i, x in enumerate(EDGES)] + [(None, "no key", "clash"), (0, EDGES[0], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r["doc_id"], r["decoded_sha256"]): r for r in bpe.digests(docs, VOCABULARY).collect()}
    for key, x, _ in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        r = got[(key, hashlib.sha256((x or "").encode()).hexdigest())]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY, out="again").collect()
    assert len(back) == len(rows) and all(r["again"] == (r["text"] or "") and r["n_tokens"] == "clash" for r in back)
    assert bpe.digests(docs.limit(0), VOCABULARY).count() == 0


def greedy(piece: bytes, entries: set[bytes]) -> int:
    count = at = 0
    while at < len(piece):
        at = next(k for k in range(len(piece), at, -1) if piece[at:k] in entries)
        count += 1
    return count


@pytest.mark.parametrize("seed", range(4))
def test_automaton_counts_greedy_pieces(seed):
    rng = random.Random(seed)
    words = [bytes(w) for n in range(2, 6) for w in itertools.product(b"ab", repeat=n)]
    entries = {b"a", b"b"} | set(rng.sample(words, 12))
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 25))) for _ in range(500)]
    got = token_counts.Automaton.build(entries).counts(pieces)
    assert got.tolist() == [greedy(p, entries) for p in pieces]


def test_automaton_needs_every_byte():
    with pytest.raises(ValueError):
        token_counts.Automaton.build({b"abc", b"a"})
    with pytest.raises(ValueError):
        token_counts.Automaton.build({b"a"}).counts([b"x"])


def test_token_counts(spark):
    entries = token_counts.vocabulary_of(VOCABULARY)
    rows = [(i, x, 1) for i, x in enumerate([*EDGES, "government of the people's \n\n 1999"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = token_counts.token_counts(docs, VOCABULARY)
    assert got.columns == ["doc_id", "text", "n_pieces"]
    for r in got.collect():
        pieces = [p.encode() for p in pretokens._PATTERN.findall(r["text"] or "")]
        assert r["n_pieces"] == sum(greedy(p, entries) for p in pieces)
    assert token_counts.token_counts(docs.limit(0), VOCABULARY).count() == 0
