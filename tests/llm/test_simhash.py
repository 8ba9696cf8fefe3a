"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from caselight.llm import simhash
from caselight.llm.components import connected_components


def plain_fingerprint(text, shingle=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    joined = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in joined]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, prints, radius=4):
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(keys)):
        groups.setdefault(find(k), []).append(keys[k])
    return {key: min(g) for g in groups.values() for key in g}


def test_fingerprints():
    texts = [None, "", " \n", "a", "A b", "a  B\tc D", "É a É b \xa0c", "x " * 1000, "a b c d e f g " * 90]
    assert simhash.fingerprints_of(pa.array(texts), 4).tolist() == [plain_fingerprint(x) for x in texts]
    for shingle in (1, 2, 5):
        got = simhash.fingerprints_of(pa.array(texts), shingle).tolist()
        assert got == [plain_fingerprint(x, shingle) for x in texts]


def test_tiles_give_a_spanning_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    near = np.concatenate([base, base ^ np.uint64(3), base ^ np.uint64(1 << 40)])
    a, b = simhash.compare_tiles(near[:70], near[70:], 4)
    assert len(a) <= 120 and (b < a).all()
    both = np.concatenate([near[:70], near[70:]])
    assert plain_components(list(range(120)), both.tolist()) != {}
    joined = {int(x): int(x) for x in range(120)}
    for u, v in zip(a.tolist(), b.tolist()):
        joined[u] = v
    cross = [(i, j) for i in range(70) for j in range(70, 120) if int(both[i] ^ both[j]).bit_count() <= 4]
    assert all(joined[i] == joined[j] for i, j in cross)


@pytest.mark.parametrize("tile", [2, 16, 2048])
def test_near_duplicates(spark, tile):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    texts = [" ".join(b) for b in base] * 3
    for b in base:
        changed = list(b)
        changed[rng.randrange(60)] = "other"
        texts.append(" ".join(changed))
        texts.append(" ".join(b).upper())
    texts += [None, "", "  ", "one", "one", "One"]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, ["x"] * len(texts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(docs, tile=tile).collect()
    prints = [plain_fingerprint(x) for _, x, _ in rows]
    want = plain_components([k for k, _, _ in rows], prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == dict(zip([k for k, _, _ in rows], prints))
    kept = simhash.representatives(docs, tile=tile)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert kept.columns == docs.columns


def test_repeated_rows_missing_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 3 and {r["component_id"] for r in got} == {1}
    assert simhash.representatives(docs).count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_key_are_judged_each_by_itself(spark):
    p, u = "a b c d e f g h", "quite another text that has nothing in common with it"
    rows = [(1, p, "x"), (2, p, "x"), (2, u, "x"), (3, u + " y z", "x"), (3, "so far from all", "x")] + [(4, "thrice told", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(4)
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.representatives(docs).collect())
    assert (1, p) in kept and (2, p) not in kept and (2, u) in kept and (3, "so far from all") in kept
    assert kept.count((4, "thrice told")) == 1
    assert simhash.representatives(docs).columns == docs.columns
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)]
    edges += [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(7, 7), (None, 3), (3, None)]
    got = connected_components(spark.createDataFrame(edges, "u int, v int")).collect()
    root = {r["node"]: r["root"] for r in got}
    assert len(got) == len(root)
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert set(root) == {x for e in real for x in e}
    assert all(root[a] == root[b] for a, b in real)
    assert all(root[root[x]] == root[x] <= x for x in root)
    assert {root[k] for k in range(61)} == {0}
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0
