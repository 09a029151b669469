"""Quoted CSV in byte ranges against Spark's reader of whole files."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credence.sources import files
from credence.sources.files import strings
from credence.sources.quoted import ends_inside, read_quoted_csv, read_records

COLUMNS = ["id", "title", "author", "text", "label"]


def whole(spark, path):
    options = dict(header=True, multiLine=True, quote='"', escape='"', nullValue="", encoding="UTF-8", enforceSchema=False, columnPruning=False)
    return spark.read.schema(strings(COLUMNS)).options(**options).csv(path)


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range; the reader's own sizes come back afterwards."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    def set_bytes(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield set_bytes
    for k, v in before.items():
        spark.conf.set(k, v)


def invented(seed):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\n", "\r\n"])

    def field():
        k = rng.random()
        if k < 0.4:
            return rng.choice(["", "a", "b c", '5" nail', "None", "é中", "it's", " spaced "])
        body = "".join(rng.choice(["word ", ",", end, '""', "x", end + end, '"",""']) for _ in range(rng.randint(0, 12)))
        return f'"{body}"' + rng.choice([""] * 9 + ["tail"])
    rows = [",".join(COLUMNS)]
    for i in range(rng.randint(0, 60)):
        k = rng.random()
        rows.append("" if k < 0.05 else ",".join(field() for _ in range(rng.choice([2, 6]))) if k < 0.1 else ",".join([str(i), *[field() for _ in range(4)]]))
    return end.join(rows) + rng.choice([end, ""])


@pytest.mark.parametrize("size", [37, 64, 300])
def test_same_rows_as_the_reader_of_whole_files(spark, tmp_path, ranges, size):
    for seed in range(4):
        with open(tmp_path / f"{seed}.csv", "w", newline="", encoding="utf-8") as f:
            f.write(invented(100 * size + seed))
    want = Counter(map(tuple, whole(spark, str(tmp_path)).collect()))
    ranges(size)
    assert Counter(map(tuple, read_quoted_csv(spark, str(tmp_path), COLUMNS).collect())) == want


def test_a_record_over_many_ranges_and_an_open_end(spark, tmp_path, ranges):
    long = '"' + "\n".join(f'line {i}, ""quoted""' for i in range(300)) + '"'
    text = f'id,title,author,text,label\n1,t,a,{long},0\n2,t,a,x,1\n3,t,a,"never closed\n4,t,a,x,0\n'
    with open(tmp_path / "x.csv", "w", newline="") as f:
        f.write(text)
    want = sorted((tuple(v and v.removesuffix("\n") for v in r) for r in whole(spark, str(tmp_path)).collect()), key=repr)
    ranges(100)
    assert sorted(map(tuple, read_quoted_csv(spark, str(tmp_path), COLUMNS).collect()), key=repr) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    rows = [f'{i},"title {i}",a,"text\n{i}\n, ""x"" {"y" * (i % 300)}",{i % 2}' for i in range(6000)]
    with open(tmp_path / "train.csv", "w", newline="") as f:
        f.write("\n".join(["id,title,author,text,label", *rows]) + "\n")
    want = Counter(map(tuple, files.null_na_words(whole(spark, str(tmp_path))).collect()))
    ranges(64 * 1024)
    read = files.read_article_csv(spark, str(tmp_path / "train.csv"))
    parts = [r["n"] for r in read_records(spark, str(tmp_path)).groupBy("start").agg(F.count("*").alias("n")).collect()]
    assert len(parts) >= 10 and max(parts) < 1500
    assert Counter(map(tuple, read.collect())) == want


def test_header_in_any_file_and_byte_order_mark(spark, tmp_path, ranges):
    ranges(16)
    (tmp_path / "1.csv").write_bytes(b"\xef\xbb\xbfid,title,author,text,label\n1,t,a,x,0\n")
    assert read_quoted_csv(spark, str(tmp_path), COLUMNS).count() == 1
    for k, bad in enumerate(["id,title,author,label,text\n", "id,title,author,text\n1,a,b,c\n", "id,title,author,text,label,more\n1,a,b,c,0,x\n"]):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "2.csv").write_text(bad)
        with pytest.raises(Exception, match="header"):
            read_quoted_csv(spark, str(folder), COLUMNS).collect()


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", False, True), (b'a,"b', True, False), (b'a,"b"', False, False), (b'5" nail,"', True, True), (b'"a""', True, False), (b'x"', False, False),
    (b'"",""', False, True), (b'","', False, True), (b'"a"tail"b,c', False, False), (b'"', True, False), (b'a",b', False, False), (b"", False, True)])
def test_state_after_a_line(line, outside, inside):
    assert ends_inside(line, False) is outside
    assert ends_inside(line, True) is inside
