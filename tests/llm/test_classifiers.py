"""Language and toxicity: the kernel and the risk by hand, and held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import language_id, samples, toxicity
from caselight.llm import text as T

SYLLABLES = {
    "aa": ["ka", "to", "mi", "ne", "ru", "so"],
    "bb": ["sch", "ein", "ung", "lich", "ver", "zu"],
    "cc": ["tion", "ent", "eau", "que", "oir", "é"],
}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))


def remainder(key):
    return zlib.crc32(str(key).encode()) % 4


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for k in range(400):
        lang = rng.choice(list(SYLLABLES))
        body = [word(rng, lang) for _ in range(rng.randint(3, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            body.insert(rng.randrange(len(body)), rng.choice(["vilest", "grubbywords", "grubbyness"]))
        out.append((k, " ".join(body), lang, toxic))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34!", "bb"), (1003, "日本", None), (None, "kato mine", "aa")]
    return spark.createDataFrame([(k, x, l) for k, x, l, _ in rows] + extra, "doc_id long, text string, lang string")


def test_folds(spark):
    got = spark.createDataFrame([(k,) for k in range(200)] + [(None,)], "k long").select(
        "k", samples.fold("k").alias("f"), samples.held_out("k").alias("h")
    )
    for r in got.collect():
        assert r["f"] == (None if r["k"] is None else remainder(r["k"])) and r["h"] == (r["f"] == 2)


def test_presence_is_of_ngrams():
    data, bounds = T.buffer(pa.array(["abab", "", "ab", "a", "a1b a!b"]))
    held = language_id.presence(data, bounds, 1 << 15)
    # ab, ba; aba, bab; abab.
    assert held.sum(axis=1).tolist()[:4] == [5, 0, 1, 0]
    assert (held[0] * held[2]).sum() == 1
    alone = language_id.presence(*T.buffer(pa.array(["a1b a!b"])), 1 << 15)
    assert (alone[0] == held[4]).all()


def test_kernel_values():
    data, bounds = T.buffer(pa.array(["abab", "ab", "zz"]))
    bits = np.packbits(language_id.presence(data, bounds, 1 << 15) > 0, axis=1)
    values = language_id.Kernel(bits, 1 << 15)(data, bounds)
    assert np.allclose(values, [[1, 1 / 5**0.5, 0], [1 / 5**0.5, 1, 0], [0, 0, 1]], atol=1e-6)


def test_language_held_out(spark, docs, rows):
    model = language_id.Model.fit(docs, landmarks=12, per_language=80)
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == found[1002]["lang_pred"] == "und"
    assert found[1003]["lang_pred"] != "und" and found[None]["lang_pred"] == "aa"
    held = [r for r in rows if remainder(r[0]) == 2]
    assert np.mean([found[k]["lang_pred"] == lang for k, _, lang, _ in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_held_out_languages_teach_nothing(spark, docs):
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(samples.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    a = language_id.Model.fit(docs, landmarks=12, per_language=80)
    b = language_id.Model.fit(spoiled, landmarks=12, per_language=80)
    assert a.languages == b.languages and np.allclose(a.weights, b.weights, atol=1e-4)


def test_nothing_to_learn_from(spark, docs):
    empty = docs.limit(0)
    assert language_id.Model.fit(empty) is None
    got = language_id.identify(docs, None).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert language_id.identify(empty, None).count() == 0
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.Model.fit(docs, labels) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_features_are_words_and_beginnings():
    place, found = toxicity.features(pa.array(["Vilest vilest!", None, "vile vilest"]))
    own = [set(found[place == k].tolist()) for k in range(3)]
    # vilest; vile, viles of it (six bytes are the word itself).
    assert len(own[0]) == 3 and own[1] == set() and own[0] < own[2] and len(own[2]) == 4


def test_risk_separates_hidden_positives():
    rng = np.random.default_rng(0)
    positive = (np.arange(300), rng.integers(0, 2, 300), 300)
    hidden = rng.random(3000) < 0.2
    columns = np.where(hidden, rng.integers(0, 2, 3000), rng.integers(2, 6, 3000))
    weights, offset = toxicity.fit_weights(positive, (np.arange(3000), columns, 3000), 6, 0.19)
    chance = 1 / (1 + np.exp(-(weights + offset)))
    assert chance[:2].min() > 0.7 and chance[2:].max() < 0.1


def test_toxicity_held_out(spark, docs, rows):
    labels = [(k, y) for k, _, _, y in rows if k % 3 or y] + [(5000, 1), (None, 1), (7, None)] + [(rows[0][0], rows[0][3])]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.Model.fit(docs, labels, prior=0.2)
    scored = toxicity.score(docs.withColumn("score", docs["doc_id"]), model, predicted="lang")
    assert scored.columns == ["doc_id", "text", "score", "lang"]
    found = {r["doc_id"]: r for r in scored.collect()}
    held = [r for r in rows if remainder(r[0]) == 2]
    right = [(found[k]["score"] >= 0.3) == bool(y) for k, _, _, y in held]
    assert np.mean(right) > 0.95 and all(r["lang"] == int(r["score"] >= 0.3) for r in found.values())
    # An unseen form of a known stem.
    unseen = spark.createDataFrame([(1, "kato grubbyish mine"), (2, "kato mine")], "doc_id long, text string")
    a, b = [r["score"] for r in toxicity.score(unseen, model).orderBy("doc_id").collect()]
    assert a > b
