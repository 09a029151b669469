from credence import session
from credence.plans import registry, run
from credence.sources import files, topic
from test_models import RELIABLE, UNRELIABLE


def raw_files(root):
    (root / "kaggle").mkdir(parents=True)
    (root / "liar").mkdir()
    rows = [f'{i},title {i},x,"{(RELIABLE, UNRELIABLE)[i % 2][i // 2 % 4]}",{i % 2}' for i in range(24)]
    (root / "kaggle" / "train.csv").write_text("id,title,author,text,label\n" + "\n".join(rows) + "\n")
    for split, n in (("train", 20), ("test", 6)):
        lines = [f"{i}.json\t{('true', 'false')[i % 2]}\t{(RELIABLE, UNRELIABLE)[i % 2][i // 2 % 4]}\teconomy\tspeaker {i % 2}" for i in range(n)]
        (root / "liar" / f"{split}.tsv").write_text("\n".join(lines) + "\n")


def test_raw_files_to_verdicts(spark, tmp_path):
    raw_files(tmp_path / "raw")
    where = {"format": "parquet", "path": str(tmp_path / "topics")}
    for _ in range(2):                                       # sent twice: training keeps one record per id
        sent = run.produce(spark, str(tmp_path / "raw"), **where)
        assert {r["source"]: r["sent"] for r in sent.collect()} == {"kaggle": 24, "liar": 26}
    limited = run.produce(spark, str(tmp_path / "raw"), limit=5, topic="other", **where)
    assert {r["source"]: r["sent"] for r in limited.collect()} == {"kaggle": 3, "liar": 2}
    run.sink(spark, str(tmp_path / "landed"), str(tmp_path / "c1"), until_idle=True, **where).awaitTermination()

    base = str(tmp_path / "models")
    best, document = run.train_from_landed(spark, str(tmp_path / "landed"), base, min_df={"article": 1, "claim": 1})
    assert document["n_train"] + document["n_test"] == 50 and document["models"][best.name]["overall"]["accuracy"] > 0.9
    assert registry.load_latest(spark, base).name == best.name

    topic.ingest(spark.createDataFrame([("", UNRELIABLE[1], "speaker 1"), ("", RELIABLE[1], "speaker 0")], "title string, text string, speaker string"), **where)
    run.score_incoming(spark, [base], str(tmp_path / "archive"), str(tmp_path / "c2"), until_idle=True, **where).awaitTermination()
    out = spark.read.json(str(tmp_path / "archive")).collect()
    assert sorted((r["label"], r["route"]) for r in out) == [("reliable", "claim"), ("unreliable", "claim")]
    assert all(r["id"].startswith("live-") and r["submitted_at"] for r in out)


def test_nothing_staged_is_left_after_publishing(spark, tmp_path, monkeypatch):
    raw_files(tmp_path / "raw")
    monkeypatch.setattr(session, "staging_root", lambda spark: str(tmp_path / "staging"))
    rows = files.load_raw(spark, str(tmp_path / "raw"))
    best, _ = run.train_and_publish(rows, str(tmp_path / "models"), "raw", min_df={"article": 1, "claim": 1})
    # What is left belongs to ``rows``, which can be read again: where the CSV's byte ranges start.
    assert {p.name.split("-")[0] for p in (tmp_path / "staging").iterdir()} == {"csv"} and best.terms.count() > 0
