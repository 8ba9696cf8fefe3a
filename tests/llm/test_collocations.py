"""Phrase counts and scores against a count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from caselight.llm import collocations


def plain(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        here = counts.setdefault(lang or "und", Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(words)
            for n in range(1, 5):
                here.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        dropped = {
            p[a : a + n]
            for p, count in often.items()
            for n in range(2, len(p))
            for a in range(len(p) - n + 1)
            if 100 * count >= 80 * f[p[a : a + n]]
        }
        scored = []
        for p, a in often.items():
            if p not in dropped:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        scored.sort()
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(scored[:top])]
    return sorted(out)


def found(spark, rows, least, top, **how):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, word string, n int").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, least=least, top=top, **how).collect())


def corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "Été", "ÉTÉ", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]

    def text(n):
        out = rng.choices(words, weights, k=n)
        return "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!? ", "\x0b"]) for w in out)

    rows = [(rng.choice(["en", "de", None, "und"]), text(rng.randint(0, 120))) for _ in range(150)]
    rows += [("en", "New York City Hall. " * 12), ("en", "a a a a a a a a"), ("de", None), (None, ""), ("fr", ".,;"), ("fr", " \t")]
    rows += [("en", rows[0][1])] * 5
    return rows


@pytest.mark.parametrize("how", [{}, {"budget": 200}, {"budget": 20}])
def test_phrases(spark, how):
    rows = corpus()
    want = plain(rows, 5, 40)
    assert len({r[0] for r in want}) >= 3 and max(r[1] for r in want) == 40
    assert found(spark, rows, 5, 40, **how) == want


def test_a_filter_that_is_full_changes_nothing(spark, monkeypatch):
    full = collocations.Filter(np.full((1 << collocations.BITS) // 8, 255, np.uint8))
    monkeypatch.setattr(collocations, "_filter_of", lambda ids: full)
    rows = corpus()
    assert found(spark, rows, 6, 30) == plain(rows, 6, 30)


def test_another_seed_if_two_words_share_a_hash(spark, monkeypatch):
    words = collocations._Words
    seeds = []

    class Shared(words):
        def __init__(self, batch, seed):
            super().__init__(batch, seed)
            if seed == 0:
                self.ids[:] = 7

    def rows(docs, seed):
        seeds.append(seed)
        return real(docs, seed)

    real = collocations._word_rows
    monkeypatch.setattr(collocations, "_Words", Shared)
    monkeypatch.setattr(collocations, "_word_rows", rows)
    docs = spark.createDataFrame([("en", "one two three")], "lang string, text string")
    collocations.word_counts(docs)
    assert seeds[0] == 0


def test_a_long_text_and_empty_tables(spark):
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdefg") for _ in range(400_000)))]
    assert found(spark, rows, 30, 50) == plain(rows, 30, 50)
    assert found(spark, [("en", "one two")], 30, 50) == []
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).count() == 0


def test_counts_past_64_bits(spark):
    """A count times the factor of the score does not fit a long."""
    from pyspark.sql import functions as F

    big = spark.range(1).selectExpr("9000000000000000000L as a", "9000000000000000001L as l", "9000000000000000003L as r")
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    assert big.select(score).first()[0] == 2000000 * 9000000000000000000 // 18000000000000000004
