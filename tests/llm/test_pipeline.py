"""Every stage on awkward rows, the whole on the driver's smallest tables against a brute-force version, and the queries."""

from pathlib import Path

import numpy as np
import pytest
from compare import connect, differences
from helpers import awkward, documents, empty, prose
from test_decontamination_html_url import plain_find
from test_topk_and_jaccard import plain_join

import __spark_entry__ as entry
import corpus_pipeline
from credence.llm import lang_id, toxicity
from credence.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def like_a_language(text, profiles):
    """The greatest cosine with a prototype, trigram by trigram, is beyond one deviation of chance."""
    s = lang_id.space(profiles.dimensions, profiles.seed)
    codes, n = s.counts(text or "")
    if not len(codes):
        return False
    total = sum(int(k) * s.vectors(np.array([c]))[0].astype(float) for c, k in zip(codes, n))
    cosines = [float(p @ total) / np.linalg.norm(total) for p in profiles.prototypes.astype(float)]
    return max(cosines) >= profiles.dimensions ** -0.5


def test_language_stage_depends_on_its_model(spark):
    """Two profiles keep different rows of the same table."""
    latin, greek = prose(1, 200), "".join(chr(0x3B1 + ord(c) - 97) if c.isalpha() else c for c in prose(2, 200))
    rows = [(1, latin, "en", "a", 1), (2, greek, "el", "a", 1), (3, "1234", "en", "a", 1), (4, None, "en", "a", 1)]
    docs = documents(spark, rows)
    kept = {lang: [r["doc_id"] for r in lang_id.identified(docs, lang_id.learn(docs.where(f"lang = '{lang}'"))).collect()] for lang in ("en", "el")}
    assert kept == {"en": [1], "el": [2]}
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, SF).collect()) == [1, 2]


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES[:4])
def test_stage_keeps_columns_and_clean_rows(spark, name, step):
    docs = documents(spark)
    out = step(spark, docs, SF)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = sorted(str(r["doc_id"]) for r in out.collect())
    texts = {"toxicity": lambda t: True, "language_id": lambda t: like_a_language(t, lang_id.learn(docs)), "benchmark_decontamination": lambda t: True}
    if name in texts:
        assert got == sorted(str(r[0]) for r in awkward() if texts[name](r[1]))
    else:       # of the copies 1, 1, 2, 3 and a null key one row stays; 9 and 10 are copies; rows without words stay
        assert got == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, -15, None]))
    assert step(spark, empty(spark), SF).count() == 0


def test_packing_stage(spark):
    out = corpus_pipeline.STAGES[4][1](spark, documents(spark), SF)
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in awkward()}
    assert corpus_pipeline.STAGES[4][1](spark, empty(spark), SF).count() == 0


def test_toxic_rows_and_benchmark_passages_go(spark):
    items = table(spark, SF, "benchmark").limit(3).collect()
    rows = [(1, prose(1, 50), "en", "a", 1), (2, f"{prose(2, 30)} {items[0]['text']} {prose(3, 30)}", "en", "a", 1)]
    out = corpus_pipeline.benchmark_stage(spark, documents(spark, rows), SF)
    assert [r["doc_id"] for r in out.collect()] == [1]


def test_run_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = toxicity.score(docs, toxicity.learn(docs, table(spark, SF, "labels"))).collect()
    left = {r["doc_id"]: rows[r["doc_id"]] for r in scores if r["score"] < 0.5}
    profiles = lang_id.learn(docs.where(docs["doc_id"].isin(list(left))))
    left = {k: t for k, t in left.items() if like_a_language(t, profiles)}
    found = plain_join(sorted(left.items()), 5, (80, 100))
    left = {k: left[k] for k, _, c in map(eval, found) if k == c}
    bench = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    left = {w[0] for w in plain_find(sorted(left.items()), bench) if not w[5]}
    assert 0 < len(left) < len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == left


def test_models_survive_the_stages():
    assert lang_id.UNKNOWN == "und" and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_copies", "benchmark_decontamination", "packing"]


NAMES = [n for n in entry.queries() if n.startswith("op")]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_query_equals_sql(spark, name):
    assert differences(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name,table_name", [(n, "pages" if n[:4] in ("op4_", "op5_") else "documents") for n in NAMES if n not in entry.oracle_sql()])
def test_query_covers_its_table(spark, name, table_name):
    out = entry.queries()[name](spark, SF)
    key = "page_id" if table_name == "pages" else "doc_id"
    got = out.selectExpr("explode(doc_ids) AS doc_id") if name.startswith("op7") else out
    assert {r[0] for r in got.select(key).collect()} == {r[0] for r in table(spark, SF, table_name).select(key).collect()}
