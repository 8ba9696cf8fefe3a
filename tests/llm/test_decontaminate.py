"""Containment search against all pairs of shingle sets."""

import random

import pytest

from caselight.llm import decontaminate


def shingles(text, size=5):
    words = (text or "").lower().encode().split()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def all_pairs(docs, items, threshold):
    out = {}
    for d, x in docs:
        for i, y in items:
            want = shingles(y)
            shared = len(want & shingles(x))
            if want and shared >= threshold * len(want) - 1e-9:
                out[(d, i)] = (shared, len(want))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 8, 20, 45, 90])))) for i in range(50)]
    items += [(90, None), (91, ""), (92, items[5][1]), (93, "ab " * 30)]
    docs = []
    for d in range(120):
        filler = [rng.choice(words) for _ in range(rng.choice([0, 40, 3000]))]
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(0, 4)):
            if item:
                item[rng.randrange(len(item))] = "changed"
        at = rng.randint(0, len(filler))
        docs.append((d, " ".join(filler[:at]) + "\n" + " ".join(item).upper() + "\t" + " ".join(filler[at:])))
    return docs + [(500, None), (501, ""), (502, "ab ab ab ab ab ab")], items


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_contained_items(spark, tables, threshold, block_bytes):
    docs, items = tables
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.contained_items(left, right, threshold=threshold, block_bytes=block_bytes)
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["item_shingles"]) for r in found.collect()}
    want = all_pairs(docs, items, threshold)
    assert got == want and len(want) > 20
    clean = decontaminate.without_items(left, right, threshold=threshold, block_bytes=block_bytes)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_extra_columns_repeated_rows_and_empty_tables(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text, "a", 2), (1, text, "a", 2), (None, text, "a", 2), (3, "x", "a", 2)],
                                 "doc_id long, text string, item_id string, shared int")
    items = spark.createDataFrame([("k", text)], "item_id string, text string")
    rows = decontaminate.contained_items(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["containment"]) for r in rows) == [(0, "k", 1.0), (1, "k", 1.0), (1, "k", 1.0)]
    left = decontaminate.without_items(docs, items)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [3]
    assert decontaminate.without_items(docs, items.limit(0)).count() == 4
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
