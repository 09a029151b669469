"""Compaction of landed days and the table of last records, beside a sink that goes on."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from credence.catalog.queries import QUERIES
from credence.operators import normalize
from credence.operators.normalize import keep_last
from credence.sources import compact, latest
from credence.sources.files import LANDED, read_landed

DAYS = [date(2024, 1, 1), date(2024, 1, 2)]


def land(spark, root, rows, files=4):
    """(id, text, seq, day) as a sink would write them."""
    df = spark.createDataFrame(rows, "id string, text string, seq long, dt date").withColumn("ingested_at", F.lit(datetime(2024, 1, 3)))
    full = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LANDED.fields])
    full.repartition(files).write.mode("append").partitionBy("dt").json(root)


def rows_of(df):
    return sorted((r["id"], r["text"], r["seq"], r["dt"]) for r in df.collect())


def sample(first, n):
    return [(f"i{i % 17}", f"text\n{i}", i, DAYS[i % 2]) for i in range(first, first + n)]


def test_every_record_once_before_during_and_after(spark, tmp_path):
    root = f"{tmp_path}/raw"
    land(spark, root, sample(0, 60))
    opened = compact.read_live(spark, root)
    assert rows_of(opened) == rows_of(read_landed(spark, root))
    assert compact.compact(spark, root, "2024-01-01") == 1
    assert rows_of(compact.read_live(spark, root)) == rows_of(opened) == sorted(sample(0, 60))
    assert len([p for p in compact.read_live(spark, root).inputFiles() if "dt=2024-01-01" in p]) == 1
    land(spark, root, sample(60, 20))
    assert rows_of(compact.read_live(spark, root)) == sorted(sample(0, 80))
    assert compact.compact(spark, root, "2024-01-01") == 2 and compact.compact(spark, root, "2024-01-02") == 3
    last = compact.read_live(spark, root)
    assert rows_of(last) == sorted(sample(0, 80)) and len(last.inputFiles()) == 2
    assert compact.compact(spark, root, "2024-01-02") is None
    assert rows_of(read_landed(spark, root)) == sorted(sample(0, 80))       # the landing zone itself is untouched


def test_files_are_cut_at_their_size(spark, tmp_path):
    root = f"{tmp_path}/raw"
    land(spark, root, [(f"i{i}", "x" * 500, i, DAYS[0]) for i in range(200)], 10)
    compact.compact(spark, root, "2024-01-01", file_bytes=40_000)
    assert 3 <= len(compact.read_live(spark, root).inputFiles()) <= 5


def test_a_day_may_hold_as_many_files_as_its_bytes_need(spark, tmp_path):
    root = f"{tmp_path}/raw"
    land(spark, root, [(f"i{i}", "x" * 500, i, DAYS[0]) for i in range(200)], 10)
    assert compact.scattered_days(spark, compact.read_live(spark, root).inputFiles(), 40_000) == ["dt=2024-01-01"]
    compact.compact(spark, root, "2024-01-01", file_bytes=40_000)
    assert compact.scattered_days(spark, compact.read_live(spark, root).inputFiles(), 40_000) == []


def test_compaction_shuffles_no_row_and_packs_its_files(spark, tmp_path, monkeypatch):
    """Neither the first run nor one that takes compacted files and landed ones together; sizes are those of the lines."""
    root = f"{tmp_path}/raw"
    wide = [(f"i{i}", f"text {i} " * 200, i, DAYS[0]) for i in range(200)]
    land(spark, root, wide[:120])
    first = compact.landed_files(spark, root)
    files = compact.Files(spark, root)
    lines = sum(files.size(p) for p in first)
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda *a: pytest.fail("rows are shuffled"))
    compact.compact(spark, root, "2024-01-01", file_bytes=100_000)
    live = compact.read_live(spark, root).inputFiles()
    assert sum(files.size(p) for p in live) == lines > 3 * sum(files.fs.getFileStatus(files.path(p)).getLen() for p in live)
    monkeypatch.undo()
    land(spark, root, wide[120:])
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda *a: pytest.fail("rows are shuffled"))
    compact.compact(spark, root, "2024-01-01", file_bytes=100_000)
    last = compact.read_live(spark, root)
    assert rows_of(last) == sorted(wide) and len(last.inputFiles()) > 1
    assert compact.scattered_days(spark, last.inputFiles(), 100_000) == []


def test_the_query_compacts_days_of_several_files(spark, tmp_path, monkeypatch):
    """With files of 2 kB a day stays several files after compaction."""
    docs = spark.createDataFrame([(i, "some words " * 20, "en", "web") for i in range(60)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "<title>a</title> page")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 1, "user", "hello")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rewrite = compact.compact
    monkeypatch.setattr(compact, "compact", lambda *a: rewrite(*a, file_bytes=2_000))
    monkeypatch.setattr(compact, "FILE_BYTES", 2_000)
    found = QUERIES["landed_compaction"](spark, str(tmp_path)).where("source = 'article'")
    assert {r["step"]: r["n"] for r in found.collect()} == {"landed": 60, "compacted": 60, "opened first": 60, "landed again": 120, "compacted again": 120}


def test_a_run_without_manifest_is_not_seen_and_one_of_two_fails(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/raw"
    land(spark, root, sample(0, 30))
    create = compact.Files.create
    monkeypatch.setattr(compact.Files, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        compact.compact(spark, root, "2024-01-01")
    monkeypatch.setattr(compact.Files, "create", create)
    assert rows_of(compact.read_live(spark, root)) == sorted(sample(0, 30)) and compact.manifest(spark, root) == (0, {})

    def other_first(self, path, text):
        create(self, path, "{}")
        create(self, path, text)
    monkeypatch.setattr(compact.Files, "create", other_first)
    with pytest.raises(Exception, match="(?i)exist"):
        compact.compact(spark, root, "2024-01-01")
    assert rows_of(compact.read_live(spark, root)) == sorted(sample(0, 30))


def test_last_records_equal_those_of_everything(spark, tmp_path):
    root, base = f"{tmp_path}/raw", f"{tmp_path}/latest"
    assert latest.read_latest(spark, base).collect() == [] and latest.merge_landed(spark, root, base) == []
    land(spark, root, sample(0, 60))
    first = latest.merge_landed(spark, root, base, buckets=8)
    land(spark, root, [("i3", "corrected", 1000, DAYS[1]), ("i4", "older", -5, DAYS[0]), ("new", "n", 1, DAYS[0])])
    paths = latest._state(spark, base)[1]["live"]
    second = latest.merge_landed(spark, root, base)
    assert set(second) <= set(range(8)) and len(second) <= 3 < len(first)
    now = latest._state(spark, base)[1]["live"]
    assert {b for b in now if now[b] != paths.get(b)} == {str(b) for b in second}
    assert latest.merge_landed(spark, root, base) == []
    land(spark, root, sample(60, 10))
    latest.merge_landed(spark, root, base)
    want = keep_last(read_landed(spark, root), ["dt", "ingested_at", "seq"])
    assert rows_of(latest.read_latest(spark, base)) == rows_of(want)


def test_a_merge_compares_only_what_may_have_landed_again(spark, tmp_path, monkeypatch):
    """Of 400 records one is corrected, and one without an id lands again: the others are not staged."""
    root, base = f"{tmp_path}/raw", f"{tmp_path}/latest"
    land(spark, root, [*sample(0, 60), *[(f"k{i}", "x", i, DAYS[0]) for i in range(400)], (None, "first", 1, DAYS[0])])
    latest.merge_landed(spark, root, base, buckets=1)
    land(spark, root, [("k3", "corrected", 1000, DAYS[0]), ("k4", "older", -5, DAYS[0]), (None, "second", 2, DAYS[0])])
    staged, write = {}, latest.stage

    def seen(df, name):
        out = write(df, name)
        staged[name] = out.count()
        return out
    monkeypatch.setattr(latest, "stage", seen)
    assert latest.merge_landed(spark, root, base) == [0] and staged["landed-rows"] == 3 and sum(staged.values()) == 6
    found = latest.read_latest(spark, base)
    texts = {r["id"]: r["text"] for r in found.collect()}
    assert found.count() == 17 + 400 + 1 and texts["k3"] == "corrected" and texts["k4"] == "x" and texts[None] == "second"


def test_numbered_rows_with_and_without_broadcast(spark, monkeypatch):
    rows = spark.range(300).withColumn("_row", F.expr("IF(id < 150, id, -id)"))
    chosen = rows.where("id % 7 = 0").select("_row")
    for words in (1 << 22, 0):
        monkeypatch.setattr(normalize, "KEPT_WORDS", words)
        assert sorted(r["id"] for r in normalize.numbered_rows(rows, chosen).collect()) == [*range(0, 300, 7)]
