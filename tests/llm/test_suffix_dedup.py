"""Repeated byte strings against brute force over every window."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.llm import anchors, suffix_dedup
from caselight.llm.difference_cover import LENGTH, repeated_starts


def plain(texts):
    """(kept bytes, removed spans) of every text."""
    raw = [(x or "").encode() for x in texts]
    seen = Counter(x[k : k + LENGTH] for x in raw for k in range(len(x) - LENGTH + 1))
    out = []
    for x in raw:
        steps = np.zeros(len(x) + 1, int)
        for k in range(len(x) - LENGTH + 1):
            if seen[x[k : k + LENGTH]] > 1:
                steps[k] += 1
                steps[k + LENGTH] -= 1
        gone = np.cumsum(steps)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((kept, [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]))
    return out


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def cleaned(spark, texts, parts=3):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id int, text string").repartition(parts)
    rows = suffix_dedup.without_repeats(docs).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in rows}


def corpus():
    rng = random.Random(6)
    passage, other = prose(rng, 60), prose(rng, 45)
    texts = [prose(rng, 150) for _ in range(20)]
    texts += [texts[0], texts[0], texts[1] + " end", "begin " + texts[1], None, "", "short", "short", "é" * 99, "é" * 99]
    # Passages between different texts, more than once in one, at a text's ends.
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += [passage, f"{passage} {prose(rng, 9)} {passage}", f"{other} {prose(rng, 50)}", f"{prose(rng, 50)} {other}"]
    # Copies changed in places, and texts that repeat themselves.
    for _ in range(8):
        words = texts[2].split()
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["ab" * 300, "a" * 199, "b" * 200, "c" * 201, "xyz " * 100, "日本語の文 " * 40]
    # One byte short of a repeat, one byte more, and just enough.
    line = prose(rng, 80)[:240]
    texts += [f"A{line[:199]}B", f"C{line[:199]}D", f"E{line[20:220]}F", f"G{line[20:220]}H", f"I{line[30:231]}J"]
    return texts


def test_every_repeated_byte_goes_and_no_other(spark):
    texts = corpus()
    want = plain(texts)
    got = cleaned(spark, texts)
    for k, x in enumerate(want):
        assert got[k] == x, (k, texts[k])
    assert [got[k][0] for k in range(len(texts)) if texts[k] is None or texts[k] == ""] == [b"", b""]


def test_one_changed_copy_among_many_and_a_long_text(spark):
    rng = random.Random(9)
    base = prose(rng, 100)
    long = prose(rng, 60_000, 30_000)  # more than one slice of windows
    texts = [base] * 300 + [base.replace("w1", "v1", 1), long, long[300_000:300_900]]
    assert len(long) > 262_144
    want, got = plain(texts), cleaned(spark, texts)
    assert got == dict(enumerate(want))


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("x" * 250, 1, "a", "b", "c")], "text string, Kept int, mark_1 string, raw string, found string")
    row = suffix_dedup.without_repeats(docs).collect()
    # Strings of one letter start at more than one place of the text.
    assert [(bytes(r["kept"]), r["mark_1"], r["raw"], r["found"]) for r in row] == [(b"", "a", "b", "c")]
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.without_repeats(docs, kept="left").columns == ["text", "Kept", "mark_1", "raw", "found", "left", "spans"]


def test_a_filter_that_is_full_changes_nothing(spark, monkeypatch):
    texts = corpus()[:40]
    full = anchors.Filter(np.full((1 << anchors.BITS) // 8, 255, np.uint8))
    monkeypatch.setattr(anchors, "repeated", lambda *a, **k: full)
    assert cleaned(spark, texts) == dict(enumerate(plain(texts)))


@pytest.mark.parametrize("parts", [1, 5])
def test_sorted_suffixes(spark, parts, monkeypatch):
    from caselight.llm import difference_cover

    monkeypatch.setattr(difference_cover, "BLOCK", 3000)
    monkeypatch.setattr(difference_cover, "PART", 20_000 // parts)
    rng = random.Random(4)
    base = prose(rng, 90).encode()
    texts = {base, base[7:], base[:-9], b"q" * 207, base[5:300] + b"other" + base[300:]}
    texts |= {base[a : a + 230] for a in rng.sample(range(len(base) - 230), 20)}
    rows = [(k.to_bytes(16, "big"), x, 1 + k % 3) for k, x in enumerate(sorted(texts))]
    seen = Counter()
    for _, x, n in rows:
        for k in range(len(x) - LENGTH + 1):
            seen[x[k : k + LENGTH]] += n
    table = spark.createDataFrame(rows, "piece binary, bytes binary, n long")
    got = {}
    for r in repeated_starts(table, sum(len(x) for x in texts)).collect():
        got[bytes(r["piece"])] = {k for a, z in r["runs"] for k in range(a, z + 1)}
    for name, x, _ in rows:
        assert got.get(name, set()) == {k for k in range(len(x) - LENGTH + 1) if seen[x[k : k + LENGTH]] > 1}


@pytest.mark.parametrize("shift", [0, 8, 16, 3])
def test_equal_strings_with_different_ends_meet_in_any_part(spark, shift, monkeypatch):
    """Strings of just 200 bytes at other places of their texts, which go on
    differently: what stands behind them must not decide who compares them."""
    from caselight.llm import difference_cover

    monkeypatch.setattr(difference_cover, "BLOCK", 2000)
    monkeypatch.setattr(difference_cover, "PART", 500)
    rng = random.Random(7)
    shared = [prose(rng, 80)[:LENGTH] for _ in range(20)]
    texts = [f"{k:08d}{x}A{prose(rng, 9)}" for k, x in enumerate(shared)]
    texts += [f"{k:04d}{'z' * (4 + shift)}{x}B{prose(rng, 9)}" for k, x in enumerate(shared)]
    rows = [(k.to_bytes(16, "big"), x.encode(), 1) for k, x in enumerate(texts)]
    table = spark.createDataFrame(rows, "piece binary, bytes binary, n long")
    found = repeated_starts(table, sum(len(x) for x in texts)).collect()
    got = {int.from_bytes(r["piece"], "big"): [tuple(s) for s in r["runs"]] for r in found}
    assert got == {k: [(8, 8)] if k < 20 else [(8 + shift, 8 + shift)] for k in range(40)}


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    again = np.concatenate([rng.integers(97, 101, 333, dtype=np.uint8), data[1000:3000]])
    for width in (16, 64):
        (_, one), (_, two) = (next(anchors.slices(x, np.array([0, len(x)]), LENGTH)) for x in (data, again))
        h1, a1 = one.anchors(width)
        h2, a2 = two.anchors(width)
        first, last = 1000, 3000 - LENGTH
        assert (a1[first:last] - 1000 == a2[333 : 333 + last - first] - 333).all()
        assert (h1[a1[first:last]] == h2[a2[333 : 333 + last - first]]).all()
        assert (np.diff(a1) >= 0).all() and (a1 - np.arange(len(a1)) < width).all()


def test_counted_hashes(spark):
    values = [1 << 60, 5 << 40, 5 << 40, 7 << 50, 7 << 50, 7 << 50]
    rows = spark.createDataFrame([(v,) for v in values], "h long").repartition(3)

    def hashes(batch):
        yield batch.column("h").to_numpy().astype(np.uint64)

    twice = anchors.repeated(rows, hashes, 10)
    assert twice.may_hold(np.array(values, np.uint64)).tolist() == [False] + [True] * 5
    thrice = anchors.repeated(rows, hashes, 10, least=3)
    assert thrice.may_hold(np.array(values, np.uint64)).tolist() == [False] * 3 + [True] * 3
    assert not anchors.repeated(rows.where(F.lit(False)), hashes, 0).bits.any()


@pytest.mark.parametrize("crowded", [False, True])
def test_filters_keep_little_that_is_single(spark, monkeypatch, crowded):
    """Anchors are least hashes, so their first bits are nearly all zero: parts and
    bits dealt by those make one large part and a small filter that is full."""
    if crowded:
        monkeypatch.setattr(anchors, "BITS", 14)
        monkeypatch.setattr(anchors, "MOST_BITS", 14)
    rng = np.random.default_rng(8)
    values = np.unique(rng.integers(1 << 30, 1 << 44, 60_000, dtype=np.uint64))
    rng.shuffle(values)
    twice, once = values[:15_000], values[15_000:]
    held = np.concatenate([twice, twice, once[:5000]]).view(np.int64).tolist()
    rows = spark.createDataFrame([(v,) for v in held], "h long").repartition(3)

    def hashes(batch):
        yield batch.column("h").to_numpy().view(np.uint64)

    found = anchors.repeated(rows, hashes, 10)
    assert found.may_hold(twice).all()
    assert crowded or found.may_hold(once).mean() < 0.001
