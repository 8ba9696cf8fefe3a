"""The stages on a small corpus with known cases, and the registered queries."""

import hashlib
import importlib
import os
import random
import subprocess
import sys

import pytest

import corpus_pipeline
from caselight.llm import oracles, queries
from checks.compare import difference, sql_engine
from test_classifiers import word

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
SF_DIR = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(word(rng, "aa") + str(rng.randrange(99)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    base = str(tmp_path_factory.mktemp("corpus"))
    texts = {k: "\n".join(prose(rng, 30) for _ in range(6)) for k in range(120)}
    toxic = {k for k in range(120) if k % 5 == 0}
    for k in toxic:
        texts[k] += " vilest grubbyness vilest"
    clean = {k: x for k, x in texts.items() if k not in toxic}
    item, passage = prose(rng, 40), "\n".join(prose(rng, 25) for _ in range(3))
    texts |= {200: texts[1], 201: prose(rng, 300), 203: prose(rng, 90) + " " + item, 204: "own\n" + passage, 205: passage + "\nother"}
    texts[202] = texts[201] + " end"
    rows = [(k, x, None, "s", None) for k, x in texts.items()] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        base + "/documents.parquet"
    )
    labels = [(k, None, int(k in toxic)) for k in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(base + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(base + "/benchmark.parquet")
    return base, texts, toxic, clean


def test_stages_in_turn(spark, corpus):
    base, texts, toxic, clean = corpus
    docs = spark.read.parquet(base + "/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, base).collect(), docs.schema)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert not toxic & set(kept[0]) and set(clean) <= set(kept[0]) and 300 in kept[0]
    assert kept[1][200] == "" and kept[1][204] == texts[204] and kept[1][205] == "other"
    assert all(kept[1][k] == x for k, x in clean.items())
    # 201 and 202 are alike; 200 is empty by now and goes with the missing text.
    assert {201, 200} <= set(kept[2]) and not {202, 300} & set(kept[2])
    assert 203 in kept[2] and 203 not in kept[3]
    assert set(clean) <= set(kept[3])
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, base).collect()}
    assert set(got) == set(kept[3])
    for k, r in got.items():
        assert r["decoded_sha256"] == hashlib.sha256((kept[3][k] or "").encode()).hexdigest()


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]


def test_every_operator_has_one_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(oracles.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_on_driver_tables(spark, name):
    sql = oracles.oracle_sql().get(name)
    query = queries.queries()[name]
    if sql:
        assert difference(spark, sql_engine(SF_DIR), SF_DIR, name, query, sql) == ""
    else:
        if name == "op13_conversation_trie":
            assert query(spark, SF_DIR).count() > 0
            return
        source = "pages" if name in ("op8_url_filter", "op9_html_text") else "documents"
        key = "page_id" if source == "pages" else "doc_id"
        want = [r[0] for r in spark.read.parquet(f"{SF_DIR}/{source}.parquet").select(key).collect()]
        assert sorted(r[key] for r in query(spark, SF_DIR).collect()) == sorted(want)


@pytest.mark.parametrize("missing", ["caselight.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_entry_works_without(missing):
    code = (
        "import sys\n"
        f"sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert 'pipeline' not in e.queries() and e.oracle_sql()"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
