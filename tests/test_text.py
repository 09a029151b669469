import random
import re

import pytest
from pyspark.sql import functions as F

from credence.functions import text as X

SPACES = [" ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
PIECES = ["http://a.b/C?d", "https://", "www.", "www.x", "HTTP://Q", "<b>", "</i >", "<", ">", "'", "''", "it's", "O'Neil",
          "'quoted'", "é", "ß", "Ω", "_", "a_b", "-", ".", ",", "42", "x", "Word", "K", "İ"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES + SPACES) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def python_clean(text):
    t = (text or "").lower()
    for pattern in (r"https?://\S+|www\.\S+", r"<[^>]+>", r"[^a-z0-9\s']", r"(?<!\w)'|'(?!\w)"):
        t = re.sub(pattern, " ", t)
    return re.sub(r"\s+", " ", t).strip()


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def record(spark, title=None, text=None, **meta):
    row = {"title": title, "text": text, "speaker": None, "party": None, "subject": None, "context": None, "state": None, **meta}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def test_clean_golden(spark):
    raw = "BREAKING!! Visit https://x.com/a <b>now</b> — it's   'huge'"
    assert column(spark, [raw, None, ""], X.clean_text("t")) == ["breaking visit now it's huge", "", ""]


def test_clean_equals_python_on_random_texts(spark):
    texts = random_texts(3000, 1)
    assert column(spark, texts, X.clean_text("t")) == [python_clean(t) for t in texts]


def test_strip_and_word_count_equal_python(spark):
    texts = random_texts(1000, 2)
    assert column(spark, texts, X.strip("t")) == [t.strip() for t in texts]
    assert column(spark, texts, X.word_count("t")) == [len(t.split()) for t in texts]
    assert column(spark, texts, X.has_words("t", 5)) == [len(t.split()) >= 5 for t in texts]


def test_model_input_joins_title(spark):
    df = spark.createDataFrame([("Title", "Body text."), (None, "x y")], "a string, b string")
    assert [r[0] for r in df.select(X.model_input("a", "b")).collect()] == ["title body text", "x y"]


def test_meta_tokens(spark):
    df = record(spark, speaker="Barack Obama", party="democrat", subject="economy,taxes", context="")
    assert df.select(X.meta_tokens()).first()[0] == "spk_barack_obama party_democrat subj_economy subj_taxes"
    df = record(spark, context="Austin, Texas", state=" !!! ,, ")
    assert df.select(X.meta_tokens()).first()[0] == "ctx_austin ctx_texas"
    assert record(spark).select(X.meta_tokens()).first()[0] == ""


def test_has_meta(spark):
    assert record(spark, speaker="!!!").select(X.has_meta()).first()[0]
    assert not record(spark, speaker=" \u2003").select(X.has_meta()).first()[0]


@pytest.mark.parametrize("title,text,meta,route", [
    (None, "Says the governor cut school funding.", {}, "claim"),
    ("Headline", "Says the governor cut school funding.", {}, "article"),
    (None, "word " * 200, {}, "article"),
    (None, "word " * 59, {}, "claim"),
    (None, "word " * 60, {}, "article"),
    ("Headline", "long " * 200, {"speaker": "x"}, "claim"),
    ("\u00a0", None, {}, "claim"),
])
def test_route(spark, title, text, meta, route):
    assert record(spark, title, text, **meta).select(X.route_for()).first()[0] == route


def test_prepare(spark):
    df = record(spark, None, "Taxes went up!", party="republican")
    assert df.select(X.prepare(F.lit("claim"))).first()[0] == "taxes went up party_republican"
    assert df.select(X.prepare(F.lit("article"))).first()[0] == "taxes went up"
    long, capped = record(spark, None, "abc " * 9000, party="p"), ("abc " * 9000)[:10000]           # the cut falls behind a space
    assert long.select(X.prepare(F.lit("article"))).first()[0] == ("abc " * 9000).strip()
    assert long.select(X.prepare(F.lit("claim"))).first()[0] == "abc " * 9000 + "party_p"
    assert long.select(X.prepare(F.lit("article"), max_chars=10_000)).first()[0] == capped
    assert long.select(X.prepare(F.lit("claim"), max_chars=10_000)).first()[0] == capped + " party_p"
    assert record(spark, None, "?", party="p").select(X.prepare(F.lit("claim"))).first()[0] == "party_p"


def test_terms_equal_a_plain_count(spark):
    texts = ["", "a", "ab", "ab ab", "the", "ab the cd it's ab cd", "don't spk_a_b spk_a_b"] + [
        python_clean(t) for t in random_texts(300, 3)]
    stop = ["the", "it"]

    def expected(t):
        words = [w for w in re.findall(r"\b\w\w+\b", t) if w not in stop]
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return {g: grams.count(g) for g in grams}

    got = column(spark, texts, X.term_counts("t", stop))
    assert [{r["term"]: r["tf"] for r in g} for g in got] == [expected(t) for t in texts]


def test_pretty_term(spark):
    terms = ["spk_barack_obama", "tax spk_a_b", "plain words", "st_new_york ctx_rally", "start up"]
    assert column(spark, terms, X.pretty_term("t")) == [
        "speaker: barack obama", "tax · speaker: a b", "plain words", "state: new york · venue: rally", "start up"]
