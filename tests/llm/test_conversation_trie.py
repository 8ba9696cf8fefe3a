"""Every node of the trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from caselight.llm import conversation_trie as trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(said):
    """``said``: the turns of each conversation."""
    members, children = {}, {}
    for c, turns in said.items():
        for k in range(len(turns) + 1):
            members.setdefault(tuple(turns[:k]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        mine = children.get(p, [])
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below[p] = (sum(below[c][0] for c in mine) or 1, saved + sum(below[c][1] for c in mine))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(said[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children.get(p, [])), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, p string").repartition(3)


def nodes(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def rows_of(said):
    return [(c, k, r, x) for c, turns in said.items() for k, (r, x) in enumerate(turns)]


def test_shapes(spark):
    a, b, c, d = (("user", x) for x in ("aé", "b", "", "dddd"))
    said = {
        9: [a, b, c, d], 3: [a, b, c, d], 4: [a, b], 7: [a, b, c], 2: [a, b, d, d, d], 5: [a], 1: [b], 6: [b, a],
        8: [a, b, c, d, a, b, c], 11: [a, b, c, d, a, b, d], 12: [("assistant", "aé")], 13: [a, a, a, a], 14: [a, a],
        -3: [a, a, a, b], 20: [a, a], 21: [a, a],
    }
    assert nodes(trie.trie(trie.turns_of(table(spark, rows_of(said))))) == plain(said)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tries(spark, seed):
    rng = random.Random(seed)
    said = {}
    for c in rng.sample(range(-50, 500), 150):
        base = said[rng.choice(list(said))] if said and rng.random() < 0.7 else []
        keep = base[: rng.randint(0, len(base))]
        said[c] = keep + [(rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
    said[777] = said[rng.choice(list(said))] + [("user", "on")] * 300
    turns = trie.turns_of(table(spark, rows_of(said)))
    convs = spark.createDataFrame([(c,) for c in said], "conv long")
    assert nodes(trie.trie(turns, convs)) == plain(said)


def test_a_group_of_thousands_of_copies(spark):
    said = {c: [("user", "hello"), ("assistant", "hi")] for c in range(3000)} | {5000: [("user", "hello"), ("user", "x")]}
    assert nodes(trie.trie(trie.turns_of(table(spark, rows_of(said))))) == plain(said)


def test_rebuilt(spark):
    rng = random.Random(8)
    rows = []
    for c in [0, 1, 2, 3, 77, 100, 101, 150, 199, 200, 305, 306, 400, 401, 402, 403, 404]:
        rows += [(c, k if k else None, rng.choice(["user", None]), rng.choice(["t%d" % k, None, "é" * k])) for k in range(rng.randint(1, 7))]
    own = {}
    for c, k, r, x in rows:
        own.setdefault(c, []).append((k is not None, k or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    said = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        said[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not x for x in said.values()) or any(len(x) < 2 for x in said.values())
    assert nodes(trie.trie(*trie.rebuilt(trie.turns_of(table(spark, rows))))) == plain(said)


def test_missing_conversations_and_empty_tables(spark):
    rows = [(None, 1, "user", "x"), (1, 1, None, None), (1, 1, None, None)]
    got = nodes(trie.trie(trie.turns_of(table(spark, rows))))
    assert got == plain({1: [("", ""), ("", "")]})
    assert nodes(trie.trie(trie.turns_of(table(spark, []).limit(0)))) == []
    convs = spark.createDataFrame([(5,), (4,)], "conv long")
    assert nodes(trie.trie(trie.turns_of(table(spark, []).limit(0)), convs)) == plain({4: [], 5: []})
