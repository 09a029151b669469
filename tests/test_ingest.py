import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from credence.operators import normalize as N
from credence.plans import run
from credence.schema import ARTICLE
from credence.sources import files, topic


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))
    return str(path)


@pytest.mark.parametrize("grade,label", [
    ("true", 0), ("mostly-true", 0), ("half-true", 0), ("barely-true", 1), ("false", 1), ("pants-fire", 1),
    (" FALSE ", 1), ("unknown", None), ("", None), (None, None)])
def test_grades(spark, grade, label):
    df = spark.createDataFrame([(grade,)], "g string")
    assert df.select(N.grade_label("g")).first()[0] == label


def test_article_csv(spark, tmp_path):
    path = write(tmp_path / "train.csv", 'id,title,author,text,label\n'
                 '7,Hello,,Body,1\n'
                 '8,"a ""quoted"" title",x,"two\nlines, one cell",0\n'
                 '9,t,x,NA,0\n10,t,x,  ,0\n11,t,x,text,\n12,t,x,float,1.7\n13,t,x,bad label,2\n14,None,x,negative,-0.5\n')
    rows = {r["id"]: r for r in N.normalize_articles(files.read_article_csv(spark, path)).collect()}
    assert sorted(rows) == ["kaggle-12", "kaggle-14", "kaggle-7", "kaggle-8"]
    assert rows["kaggle-7"]["author"] == "" and rows["kaggle-7"]["label"] == 1 and rows["kaggle-7"]["source"] == "kaggle"
    assert rows["kaggle-8"]["title"] == 'a "quoted" title' and rows["kaggle-8"]["text"] == "two\nlines, one cell"
    assert rows["kaggle-12"]["label"] == 1 and rows["kaggle-12"]["label_raw"] == "1"
    assert rows["kaggle-14"]["label"] == 0 and rows["kaggle-14"]["title"] == ""


def test_article_csv_checks_its_header(spark, tmp_path):
    good, other = "id,title,author,text,label\n1,t,a,\"x\ny\",0\n", "id,author,title,label,text\n2,au,ti,1,body\n"
    write(tmp_path / "set" / "1.csv", good)
    assert files.read_article_csv(spark, str(tmp_path / "set")).count() == 1
    write(tmp_path / "set" / "2.csv", other)                     # any file of a folder is checked
    for bad in (str(tmp_path / "set"), write(tmp_path / "bad.csv", "id,text\n1,x\n"), write(tmp_path / "order.csv", other)):
        with pytest.raises(Exception, match="(?i)header"):
            files.read_article_csv(spark, bad).select("id").collect()


def test_sources_are_named_exactly(spark, tmp_path):
    write(tmp_path / "kaggle" / "train.csv", "id,title,author,text,label\n1,t,a,x,0\n")
    write(tmp_path / "liar" / "train.tsv", "1.json\ttrue\tsaid so\n")
    with pytest.warns(UserWarning, match="no rows were read"):
        rows = files.load_raw(spark, str(tmp_path), ["kaggle", " liar "])
    assert {r["source"] for r in rows.collect()} == {"kaggle", "liar"}
    with pytest.raises(ValueError, match="unknown sources"):
        files.load_raw(spark, str(tmp_path), ["kaggle", "lair"])


def test_last_of_equal_ids_wins_by_position(spark, tmp_path):
    """Equal texts with other metadata, and a text that sorts before its predecessor's."""
    write(tmp_path / "kaggle" / "train.csv", "id,title,author,text,label\n1,a,x,zz,0\n1,b,y,zz,1\n2,c,x,zz,0\n2,d,x,aa,1\n3,e,x,q,0\n")
    with pytest.warns(UserWarning):
        rows = {r["id"]: (r["title"], r["author"], r["label"]) for r in run.latest_raw(spark, str(tmp_path)).collect()}
    assert rows == {"kaggle-1": ("b", "y", 1), "kaggle-2": ("d", "x", 1), "kaggle-3": ("e", "x", 0)}


def test_non_numeric_label_is_an_error(spark):
    df = spark.createDataFrame([("1", "t", "a", "x", "abc")], "id string, title string, author string, text string, label string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        N.normalize_articles(df).collect()


def test_claim_tsv(spark, tmp_path):
    def line(*cells):
        return "\t".join(cells)
    full = ["123.json", "pants-fire", "A claim.", "taxes", "someone", "job", "Texas", "none", "1", "2", "3", "4", "5", "a rally"]
    path = write(tmp_path / "valid.tsv", "\n".join([
        line(*full), "", line("2.json", "true", 'A lone " quote'), line(*full, "extra"),
        line("3.json", "unknown", "no grade"), line("4.json", "false", "NA"), line("5.json", "False", "x", "", "None")]) + "\n")
    rows = {r["id"]: r for r in N.normalize_claims(files.read_claim_tsv(spark, path, "valid")).collect()}
    assert sorted(rows) == ["liar-valid-123.json", "liar-valid-2.json", "liar-valid-5.json"]
    first = rows["liar-valid-123.json"]
    assert (first["label"], first["label_raw"], first["text"], first["party"], first["state"], first["context"]) == (
        1, "pants-fire", "A claim.", "none", "Texas", "a rally")
    assert rows["liar-valid-2.json"]["text"] == 'A lone " quote' and rows["liar-valid-2.json"]["context"] == ""
    assert rows["liar-valid-5.json"]["speaker"] == "" and rows["liar-valid-5.json"]["label_raw"] == "false"


def test_load_raw_skips_missing_files(spark, tmp_path):
    write(tmp_path / "liar" / "test.tsv", "1.json\ttrue\tstatement\n")
    df = files.load_raw(spark, str(tmp_path))
    assert [r["id"] for r in df.collect()] == ["liar-test-1.json"] and df.schema.names == ARTICLE.names
    assert files.load_raw(spark, str(tmp_path), ["kaggle"]).count() == 0


def test_json_lines_end_at_newline_only(spark, tmp_path):
    text = "one\u2028two\u0085three"
    write(tmp_path / "dt=2024-01-02" / "part-1.jsonl", json.dumps({"id": "a", "text": text}, ensure_ascii=False) + "\n\n")
    write(tmp_path / "dt=2024-01-03" / "part-1.jsonl", json.dumps({"id": "b", "text": "x", "label": 1}) + "\n")
    write(tmp_path / "dt=2024-01-03" / "notes.txt", "not json\n")
    rows = {r["id"]: r for r in files.read_landed(spark, str(tmp_path)).collect()}
    assert rows["a"]["text"] == text and rows["a"]["dt"] == date(2024, 1, 2) and rows["b"]["label"] == 1 and len(rows) == 2
    assert files.read_landed(spark, str(tmp_path / "none")).count() == 0


def test_landed_partitions_are_pruned(spark, tmp_path):
    write(tmp_path / "dt=2024-01-02" / "a.json", '{"id": "a"}\n')
    df = files.read_landed(spark, str(tmp_path)).where("dt = DATE'2024-01-02'")
    assert "PartitionFilters: [isnotnull(dt" in df._jdf.queryExecution().executedPlan().toString()


def test_keep_last_under_a_hot_key(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("seq"))
    out = N.keep_last(df, ["seq"])
    assert out.count() == df.select("id").distinct().count()
    assert out.where("id = 'hot'").first()["seq"] == 19_998


def test_keep_last_of_equal_rows(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("b", None, "y"), (None, 2, "z"), (None, 1, "z"), ("c", 1, "p"), ("c", 1, "q")]
    df = spark.createDataFrame(rows, "id string, seq int, text string")
    got = N.keep_last(df, ["seq"])
    assert sorted(str(r["id"]) for r in got.collect()) == ["None", "a", "b", "c"] and got.where("id IS NULL").first()["seq"] == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortAggregate" in line and "text" in line]


@pytest.mark.parametrize("limit", [0, 7, 1000])
def test_interleave_equals_round_robin(spark, limit):
    queues = {"a": list(range(500)), "b": list(range(1000, 1003)), "c": []}
    df = spark.createDataFrame([(f"{s}{v}", s, v) for s, vs in queues.items() for v in vs], "id string, source string, seq int")
    expected, waiting = [], [[f"{s}{v}" for v in queues[s]] for s in ("b", "a", "c")]
    while any(waiting):
        expected += [q.pop(0) for q in waiting if q]
    got = [r["id"] for r in N.interleave(df, "seq", ["b", "a", "c"], limit).collect()]
    assert got == (expected[:limit] if limit else expected)


def test_validation(spark):
    rows = [("t", "x"), ("t", ""), ("t", None), ("t" * 1001, "x" * 200_001), (None, "x" * 200_000)]
    df = N.with_defaults(spark.createDataFrame(rows, "title string, text string"))
    good, bad = N.split_valid(df)
    assert good.count() == 2
    assert sorted(map(tuple, (r["violations"] for r in bad.collect()))) == [("text",), ("text",), ("title", "text")]


def test_records_round_trip(spark):
    df = spark.createDataFrame([("a", "é \u2028 \"q\"", None)], "id string, text string, speaker string")
    record = topic.to_records(df).first()
    assert record["key"] == "a" and "é" in record["value"] and "speaker" not in record["value"]
    back = topic.from_records(topic.to_records(df)).first()
    assert back["text"] == df.first()["text"] and back["speaker"] is None


def test_live_records(spark):
    df = spark.createDataFrame([(None, "x", "s"), (None, "x", "")], "title string, text string, speaker string")
    rows = [json.loads(r["value"]) for r in topic.to_records(topic.live_records(df)).collect()]
    assert len({r["id"] for r in rows}) == 2 and all(r["id"].startswith("live-") and len(r["id"]) == 17 for r in rows)
    assert [r.get("speaker") for r in rows] == ["s", None] and rows[0]["source"] == "live" and rows[0]["title"] == ""
