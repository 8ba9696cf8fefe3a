"""Line dedup against a brute-force version of its rule."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import line_dedup


def lines_of(text):
    return (text or "").split("\n")


def plain_dedup(rows):
    """Texts after every repeat of a chunk's lines is gone, by (key, text)."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    assert len({k for k, _ in docs}) == len(docs)
    owner, _, first, last = line_dedup.chunks(pa.array([t for _, t in docs], pa.string()))
    ranges = [
        (tuple(x for x in lines_of(docs[o][1])[a : b + 1] if x.split()), o, a, b)
        for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist())
    ]
    earliest = {}
    for content, o, a, _ in ranges:
        earliest[content] = min(earliest.get(content, (o, a)), (o, a))
    gone = collections.defaultdict(set)
    for content, o, a, b in ranges:
        if earliest[content] != (o, a):
            gone[o] |= {k for k in range(a, b + 1) if lines_of(docs[o][1])[k].split()}
    for o, drop in gone.items():
        # Runs of fewer than 30 words stay; blank lines do not end a run.
        told = [(k, k in drop, len(x.split())) for k, x in enumerate(lines_of(docs[o][1])) if x.split()]
        for goes, run in itertools.groupby(told, key=lambda x: x[1]):
            run = list(run)
            if goes and sum(n for _, _, n in run) < 30:
                drop.difference_update(k for k, _, _ in run)
    return {
        docs[o]: None if docs[o][1] is None else "\n".join(x for k, x in enumerate(lines_of(docs[o][1])) if k not in gone[o])
        for o in range(len(docs))
    }


def prose(rng, n_lines, words):
    return [" ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(rng.randint(6, 20))) for _ in range(n_lines)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    passage, long_line = prose(rng, 5, words), [" ".join(f"p{k}" for k in range(55))]
    rows = []
    for key in range(40):
        own = prose(rng, rng.randint(2, 8), words)
        at = rng.randint(0, len(own))
        put = passage if key % 3 == 0 else long_line if key % 3 == 1 else []
        rows.append((key, "\n".join(own[:at] + put + own[at:])))
    rows += [(100, rows[0][1]), (101, rows[2][1]), (102, "a b\n\n c"), (103, ""), (104, None), (105, "\n".join(["short"] * 50))]
    return rows, passage, long_line


def test_removed_lines(spark, corpus):
    rows, passage, long_line = corpus
    docs = spark.createDataFrame([(k, x, "m", 1) for k, x in rows], "doc_id long, text string, mark string, gone int")
    got = line_dedup.line_dedup(docs.repartition(4), removed="n_removed")
    assert got.columns == ["doc_id", "text", "mark", "gone", "n_removed"]
    found = {r["doc_id"]: r for r in got.collect()}
    want = {k: x for (k, _), x in plain_dedup(rows).items()}
    assert {k: r["text"] for k, r in found.items()} == want
    # A passage stays once, to its last line; unlike text stays whole.
    for line in passage + long_line:
        assert sum(line in lines_of(r["text"]) for r in found.values()) == 1
    assert found[2]["text"] == rows[2][1] and found[101]["text"] == "" and found[104]["text"] is None
    assert found[102]["n_removed"] == 0


def test_no_line_is_lost_altogether(corpus):
    rows = corpus[0]
    left = {x for t in plain_dedup(rows).values() for x in lines_of(t)}
    assert {x for _, t in rows for x in lines_of(t) if x.split()} <= left


def test_boundaries_do_not_shift():
    rng = random.Random(9)
    body = prose(rng, 60, ["x", "y"])

    def wide(lines):
        text = "\n".join(lines)
        _, h, a, b = line_dedup.chunks(pa.array([text]), least_words=1)
        return {x for x, size in zip(h.tolist(), (b - a).tolist()) if size > 1}

    moved = wide(["something new", *body])
    assert len(wide(body) - moved) <= 1 and len(moved) > 5


def test_equal_chunks_have_equal_hashes_whatever_lies_between():
    text = "one two three four five six seven eight\nnine ten eleven twelve thirteen fourteen fifteen sixteen"
    _, a, _, _ = line_dedup.chunks(pa.array([text]))
    _, b, first, last = line_dedup.chunks(pa.array(["intro\n\n" + text.replace("\n", "\n \n")]))
    assert set(a.tolist()) <= set(b.tolist())
    assert np.all(last >= first)


def test_short_runs_stay(spark):
    common = ["one two three four five six seven eight nine", "a b c d e f g h i j"]
    longer = [*common, "k l m n o p q r s t u v w"]
    rows = [(k, f"own {k}\n" + "\n".join(longer if k > 5 else common) + f"\nend {k}") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert all(got[k] == x for k, x in rows if k <= 6)
    assert all(got[k] == f"own {k}\nend {k}" for k in (7, 8, 9))


def test_missing_keys_repeated_rows_and_empty_tables(spark):
    passage = "\n".join(" ".join(f"{c}{k}" for k in range(12)) for c in "abcd")
    rows = [(None, passage), (1, passage), (1, passage), (2, "own " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in line_dedup.line_dedup(docs).collect()]
    assert len(got) == 4 and got.count((None, passage)) == 1 and got.count((1, "")) == 2
    assert [x for k, x in got if k == 2][0].startswith("own a0")
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def repeats(rows, floor=30):
    """Texts without what repeats, by comparing lines: each of two neighbouring
    lines, a line of the floor's words or one that is all of a text."""
    seen, seen_lines, out = set(), set(), {}
    for key, text in sorted(rows):
        lines = [x for x in text.split("\n") if x.split()]
        drop = set()
        for k, x in enumerate(lines):
            if x in seen_lines and (len(lines) == 1 or len(x.split()) >= floor):
                drop.add(k)
            seen_lines.add(x)
            pair = tuple(lines[k : k + 2])
            if len(pair) == 2:
                if pair in seen:
                    drop |= {k, k + 1}
                seen.add(pair)
        kept = []
        for goes, run in itertools.groupby(range(len(lines)), key=lambda k: k in drop):
            run = list(run)
            if not goes or len(run) < len(lines) and sum(len(lines[k].split()) for k in run) < floor:
                kept += run
        out[key] = "\n".join(lines[k] for k in kept)
    return out


def sized(name, *sizes):
    return [" ".join(f"{name}-{k}x{i}" for i in range(n)) for k, n in enumerate(sizes)]


def test_short_lines_against_plain_comparison(spark):
    rng = random.Random(3)
    passages = [sized(f"a{k}", *[5] * 11) for k in range(20)] + [sized(f"b{k}", 20, 6, 5, 5, 6, 20) for k in range(20)]
    passages += [sized("c", 35), sized("d", 12), sized("e", 3, 4)]
    rows = []
    for key in range(150):
        own = sized(f"own{key}", *(rng.randint(1, 12) for _ in range(rng.randint(2, 6))))
        at = rng.randint(0, len(own))
        rows.append((key, "\n".join(own[:at] + passages[key % len(passages)] + own[at:])))
    # Copies of whole documents, short last lines and single lines included.
    rows += [(1000 + k, x) for k, x in rows[:60]] + [(2000, "one"), (2001, "one"), (2002, passages[41][0]), (2003, "\n".join(passages[42]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs.repartition(5)).collect()}
    assert got == repeats(rows)
    assert all(got[1000 + k] == "" for k in range(60)) and got[2002] == got[2003] == ""
    left = [x for text in got.values() for x in text.split("\n")]
    assert all(left.count(x) == 1 for p in passages[:41] for x in p)


def test_copies_with_other_empty_lines(spark):
    a, b, c = sized("a", 20, 20, 20)
    texts = [f"{a}\n\n{b}\n{c}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n \n{c}", f"x y\n\n{a}\n\t\n\n{b}\n{c}\nz", f"{a}\n{b}\n{c}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n"]) for r in line_dedup.line_dedup(docs, removed="n").collect()}
    assert got == {0: (texts[0], 0), 1: ("", 3), 2: (" ", 3), 3: ("x y\n\n\t\n\nz", 3), 4: ("", 3)}
