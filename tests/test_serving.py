import json
import shutil
import threading
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_models import ARTICLE_SCHEMA, training_rows

from credence.operators.annotate import SKIP_WORDS, spans
from credence.plans import registry, report
from credence.plans import train as T
from credence.sources import files, topic
from credence.streaming import jobs


@pytest.fixture(scope="module")
def trained(spark):
    return T.train(spark.createDataFrame(training_rows(), ARTICLE_SCHEMA), {T.NB: T.fit_naive_bayes},
                   min_df={"article": 1, "claim": 1}, now=datetime(2024, 5, 6, 7, 8, 9))


def test_publish_and_load(spark, trained, tmp_path):
    base, other = str(tmp_path / "models"), str(tmp_path / "other")
    assert registry.load_latest(spark, base) is None
    document = registry.metrics_document(trained, "test")
    assert document["version"] == "20240506T070809Z" and document["rows_by_source"] == {"kaggle": 30, "liar": 30}
    assert document["n_train"] + document["n_test"] == 60 and document["n_features"] == sum(document["features_by_route"].values())
    assert len(document["top_terms"]["reliable"]) == 20 and document["models"][T.NB]["overall"]["confusion_matrix"]
    json.dumps(document)
    model = trained.models[T.NB]
    registry.publish(model, base, document)
    loaded = registry.load_latest(spark, other, base)
    assert loaded.origin.endswith("/v20240506T070809Z") and loaded.bias == model.bias and loaded.routes == model.routes
    assert registry.model_info(loaded)["best_model"] == T.NB and registry.model_info(loaded)["loaded_from"] == loaded.origin
    assert sorted(map(tuple, loaded.terms.collect())) == sorted(map(tuple, model.terms.collect()))
    assert registry.reload_if_changed(loaded, spark, base) is loaded
    model.version = "20240507T000000Z"
    registry.publish(model, base, document)
    model.version = "20240506T070809Z"
    assert registry.reload_if_changed(loaded, spark, base).version == "20240507T000000Z"
    flat = registry.metrics_table(spark, document)
    assert flat.where("scope = 'overall' AND metric = 'n'").first()["value"] == 12.0


def test_land_and_score_streams(spark, trained, tmp_path):
    root = str(tmp_path)
    registry.publish(trained.models[T.NB], f"{root}/models", {})
    articles = spark.createDataFrame([(f"a{i}", "live", "", "share this secret now", "") for i in range(40)],
                                     "id string, source string, title string, text string, party string").repartition(4)

    def stream(limit=None):
        return topic.read_topic(spark, "in", format="parquet", path=root, limit=limit)

    def run():
        jobs.land(stream(), f"{root}/raw", f"{root}/c1", until_idle=True).awaitTermination()
        jobs.score_stream(stream(1), [f"{root}/models"], f"{root}/archive", f"{root}/c2", until_idle=True,
                          publish=lambda p: topic.write_records(p, "out", "parquet", root)).awaitTermination()

    topic.write_records(articles, "in", "parquet", root)
    run()
    run()                                     # nothing new: nothing lands twice
    assert files.read_landed(spark, f"{root}/raw").count() == 40
    topic.write_records(articles.limit(5), "in", "parquet", root)
    run()
    landed = files.read_landed(spark, f"{root}/raw")
    assert landed.count() == 45 and landed.where("dt = current_date()").count() == 45
    archive = spark.read.json(f"{root}/archive")
    assert archive.count() == 45 and {r["label"] for r in archive.select("label").collect()} == {"unreliable"}
    assert archive.select("batch").distinct().count() > 1 and "dt" in archive.columns
    assert spark.read.parquet(f"{root}/out").count() == 45


def test_scoring_stream_needs_a_model(spark, tmp_path):
    topic.write_records(spark.createDataFrame([("a", "x")], "id string, text string"), "in", "parquet", str(tmp_path))
    with pytest.raises(LookupError, match="no published model"):
        jobs.score_stream(topic.read_topic(spark, "in", format="parquet", path=str(tmp_path)), [str(tmp_path / "none")],
                          str(tmp_path / "out"), str(tmp_path / "c"), until_idle=True)


def test_scoring_stream_waits_for_a_model(spark, trained, tmp_path):
    base = str(tmp_path / "models")
    publisher = threading.Timer(2, lambda: registry.publish(trained.models[T.NB], base, {}))
    publisher.start()
    assert registry.wait_for_model(spark, base, seconds=60, every=0.5).name == T.NB
    publisher.join()


def test_unreadable_registries_are_passed_over(spark, trained, tmp_path):
    good, torn, broken = (str(tmp_path / n) for n in ("good", "torn", "broken"))
    registry.publish(trained.models[T.NB], good, {})
    registry.publish(trained.models[T.NB], torn, {})
    shutil.rmtree(f"{torn}/v{trained.models[T.NB].version}/terms")            # the pointer's tables are gone
    (tmp_path / "broken" / "latest").mkdir(parents=True)
    (tmp_path / "broken" / "latest" / "part-0.parquet").write_bytes(b"not a table")
    with pytest.warns(UserWarning, match="cannot be read"):
        loaded = registry.load_latest(spark, torn, broken, good)
    assert loaded.name == T.NB and loaded.origin.startswith(good)
    with pytest.warns(UserWarning):
        assert registry.reload_if_changed(loaded, spark, broken) is loaded


def test_repeats_are_dropped(spark, tmp_path):
    now = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", now), ("a", now + timedelta(minutes=1)), ("b", now)], "id string, ingested_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    (jobs.drop_repeats(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


NOW = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def feed(spark):
    ages = [5, 59, 60, 61, 119, 14 * 60 + 59, 15 * 60, -30]
    rows = [(str(i), NOW - timedelta(seconds=a), "unreliable" if i % 2 else "reliable", 0.5 + i / 20) for i, a in enumerate(ages)]
    return spark.createDataFrame(rows + [("none", None, "reliable", 0.5)], "id string, scored_at timestamp, label string, confidence double")


def test_feed_reports(spark, feed):
    now = F.lit(NOW).cast("timestamp")
    buckets = {r["bucket"]: r["n"] for r in report.throughput(feed, now).collect()}
    assert buckets == {**{i: 0 for i in range(15)}, 14: 2, 13: 3, 0: 1}
    assert [r["id"] for r in report.recent(feed, 3).collect()] == ["7", "0", "1"]
    assert report.recent(feed, 300).collect()[-1]["id"] == "none"
    assert report.recent(feed, 10_000).count() == 9
    with pytest.raises(ValueError):
        report.recent(feed, 0)
    assert tuple(report.feed_stats(feed.where("id < '4'")).first()) == (4, 0.5, pytest.approx(0.575))
    assert tuple(report.feed_stats(feed.where("false")).first()) == (0, 0.0, 0.0)
    assert report.freshness(feed, now).first()["is_live"]
    assert not report.freshness(feed.where("id = '2'"), now).first()["is_live"]
    assert not report.freshness(feed.where("false"), now).first()["is_live"]


def test_shown_terms(spark):
    terms = [("spk_a_b", 0.5, "unreliable"), ("x", 0.25, "unreliable"), ("y", -0.1, "reliable")]
    df = spark.createDataFrame([("1", "unreliable", terms)], "id string, label string, top_terms array<struct<term string, weight double, direction string>>")
    assert report.feed_terms(df, 1).first()["feed_terms"] == ["speaker: a b"]
    row = report.verdict_terms(df).first()
    assert [tuple(t) for t in row["terms_unreliable"]] == [("speaker: a b", 0.5, 1.0), ("x", 0.25, 0.5)]
    assert [t["term"] for t in row["terms_reliable"]] == ["y"]


def walk(text, terms):
    """Plain re-statement of the span rule."""
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer("[A-Za-z0-9]+", text)]
    words = [w for w in words if len(w[2]) >= 2 and w[2] not in SKIP_WORDS]
    out, i = [], 0
    while i < len(words):
        s, e, w = words[i]
        pair = i + 1 < len(words) and f"{w} {words[i + 1][2]}"
        if pair in terms:
            out.append((s, words[i + 1][1], pair))
            i += 1
        elif w in terms:
            out.append((s, e, w))
        i += 1
    return out


def test_spans_equal_a_plain_walk(spark):
    rnd = random.Random(9)
    vocabulary = ["aa", "bb", "cc", "the", "x", "Aa", "é", "dd1"]
    names = ["aa", "aa bb", "bb aa", "aa aa", "cc dd1", "bb cc", "spk_x"]
    rows = []
    for i in range(300):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "-", "  "]) for _ in range(rnd.randint(0, 30)))
        rows.append((i, text, [(n, rnd.choice([-1.0, 0.5, 2.0]), "reliable") for n in rnd.sample(names, rnd.randint(0, 6))]))
    df = spark.createDataFrame(rows, "i int, text string, top_terms array<struct<term string, weight double, direction string>>")
    for r in df.select("i", "text", "top_terms", spans("text", "top_terms").alias("s")).collect():
        weights = {t["term"]: t["weight"] for t in r["top_terms"]}
        assert [(m["start"], m["end"], m["term"]) for m in r["s"]] == walk(r["text"], weights), r["text"]
        for m in r["s"]:
            top = max(abs(w) for w in weights.values())
            assert m["alpha"] == pytest.approx(0.35 + 0.65 * abs(weights[m["term"]]) / top, abs=0.0051)
