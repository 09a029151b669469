"""CSV with newlines inside quotes, read by as many tasks as the files have byte ranges.

Whether a range starts inside quotes is not visible from its middle. One scan follows every range from both
assumptions and reports how it ends; a prefix over the ranges of a file, a small table, tells how each one starts.
A second scan joins lines into records. A record that runs over the end of its range is put together from the pieces
that the ranges report, of which there are two at most per range. Only then fields are parsed.

A quote opens a field only where the field begins; a quoted field ends at a quote that is not doubled, and
whatever follows up to the next comma belongs to it. A quote that is never closed takes the rest of its file, without the
last line end. Files are UTF-8 with \\n or \\r\\n at line ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.session import stage

OPTIONS = {"quote": '"', "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}
RANGE = "file long, start long, from_outside boolean, from_inside boolean, crlf boolean"
PIECE = "file long, start long, n long, kind int, first boolean, text binary"
RECORD, HEAD, TAIL = range(3)       # a whole record; one whose end is elsewhere; the rest of an earlier one


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line's end is inside quotes."""
    if b'"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside or line[at:at + 1] == b'"':
            at += not inside
            while True:
                close = line.find(b'"', at)
                if close < 0:
                    return True
                if line[close + 1:close + 2] != b'"':
                    break
                at = close + 2
            inside, at = False, close + 1
        comma = line.find(b",", at)
        if comma < 0 or comma + 1 >= n:
            return False
        at = comma + 1


def _rows(batches: Iterator[pa.RecordBatch], slice_rows: int = 1024) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, slice_rows):
            yield from zip(*[c.to_pylist() for c in b.slice(i, slice_rows).columns])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each byte range ends if it starts outside or inside of quotes."""
    now, outside, inside, crlf = None, False, True, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "from_outside": [outside], "from_inside": [inside], "crlf": [crlf]})
    for file, start, line in _rows(batches):
        if now != (file, start):
            if now:
                yield out()
            now, outside, inside, crlf = (file, start), False, True, start == 0 and line.endswith(b"\r")
        outside, inside = ends_inside(line, outside), ends_inside(line, inside) if outside != inside else ends_inside(line, outside)
    if now:
        yield out()


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of records of each byte range, in order."""
    done: list[tuple] = []
    size = 0
    now, open_lines, kind, inside, first, n = None, [], RECORD, False, False, 0

    def flush() -> Iterator[pa.RecordBatch]:
        if done:
            columns = list(zip(*done))
            yield pa.RecordBatch.from_pydict({"file": pa.array(columns[0], pa.int64()), "start": pa.array(columns[1], pa.int64()), "n": pa.array(columns[2], pa.int64()),
                                              "kind": pa.array(columns[3], pa.int32()), "first": pa.array(columns[4], pa.bool_()), "text": pa.array(columns[5], pa.binary())})
            done.clear()

    def close() -> None:
        """At the end of a range: a record that is still open is a piece."""
        if open_lines:
            done.append((*now, n, TAIL if kind == TAIL else HEAD, first, b"\n".join(open_lines)))
            open_lines.clear()
    for file, start, starts_inside, crlf, line in _rows(batches):
        if now != (file, start):
            close()
            now, inside, first, n = (file, start), starts_inside, start == 0, 0
            kind = TAIL if inside else RECORD
        if not open_lines and not inside and line in (b"", b"\r"):
            continue
        inside = ends_inside(line, inside)
        if crlf and line.endswith(b"\r"):
            line = line[:-1]            # also inside quotes, where the reader makes it one newline
        open_lines.append(line)
        if not inside:
            text = b"\n".join(open_lines)
            done.append((*now, n, kind, first, text))
            n += 1
            size += len(text)
            open_lines.clear()
            kind, first = RECORD, False
            if len(done) >= 4096 or size > 1 << 22:
                yield from flush()
                size = 0
    close()
    yield from flush()


def _starts(ranges: DataFrame) -> DataFrame:
    """(file, start, inside, crlf) of the ranges that start inside quotes, and of all ranges of files with \\r\\n.

    A range either ends the same way however it starts, or keeps or turns the state that it finds: the state at its
    start is that after the last one of the first kind, turned as often as later ones turn it.
    """
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)      # ranges of one file
    fixed = F.col("from_outside") == F.col("from_inside")
    turns = (~fixed & F.col("from_outside")).cast("long")
    rows = ranges.withColumn("turns", F.coalesce(F.sum(turns).over(earlier), F.lit(0)))
    last = F.last(F.when(fixed, F.struct(F.col("from_outside").cast("long").alias("state"), "turns")), ignorenulls=True).over(earlier)
    rows = rows.withColumn("last", last).withColumn("all_crlf", F.max("crlf").over(Window.partitionBy("file")))
    state = F.coalesce(F.col("last.state"), F.lit(0)) + F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))
    return rows.select("file", "start", (state % 2 == 1).alias("inside"), F.col("all_crlf").alias("crlf")).where("inside OR crlf")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n, first, text): the records of CSV files; ``n`` counts them in a range, ``first`` marks a file's first one.

    The ranges are scanned once, at once; the table of those that start inside quotes has about 30 bytes per range.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    starts = stage(_starts(lines.mapInArrow(_follow, RANGE)), "csv-starts")
    known = lines.join(F.broadcast(starts), ["file", "start"], "left").select(          # a broadcast join keeps the order of the lines
        "file", "start", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("crlf", F.lit(False)).alias("crlf"), "line")
    pieces = known.mapInArrow(_assemble, PIECE)
    whole = pieces.where(F.col("kind") == RECORD)
    if starts.where("inside").limit(1).count():
        cut = stage(pieces.where(F.col("kind") != RECORD), "csv-pieces")
        order = [F.col("start"), F.when(F.col("kind") == HEAD, 1).otherwise(0)]      # a range's own rest comes before its open end
        number = F.count_if(F.col("kind") == HEAD).over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        parts = F.array_sort(F.collect_list(F.struct("start", (F.col("kind") == HEAD).cast("int").alias("is_head"), "text")))
        joined = cut.withColumn("number", number).groupBy("file", "number").agg(
            F.min(F.when(F.col("kind") == HEAD, F.struct("start", "n"))).alias("at"), F.max("first").alias("first"), parts.alias("parts"))
        text = F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), "\n")
        whole = whole.drop("kind").unionByName(joined.select("file", "at.start", "at.n", "first", text.cast("binary").alias("text")))
    return whole.select("file", "start", "n", "first", F.col("text").cast("string").alias("text"))


def read_quoted_csv(spark: SparkSession, path: str, columns: Sequence[str], place: str | None = None) -> DataFrame:
    """All-string rows of CSV files with a header, which is compared with ``columns``; another one is an error.

    With ``place`` a column of that name says where a row stands: (file, start, n), in the order of the files' names.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    records = read_records(spark, path)
    fields = F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), OPTIONS)
    header = F.from_csv(F.regexp_replace("text", "^﻿", ""), ", ".join(f"_{i} string" for i in range(len(columns) + 1)), OPTIONS)
    expected = F.lit(True)
    for i, c in enumerate(columns):
        expected = expected & header[f"_{i}"].eqNullSafe(F.lit(c))
    expected = expected & header[f"_{len(columns)}"].isNull()
    problem = F.raise_error(F.concat(F.lit("the header of a CSV file is not " + ",".join(columns) + " but "), F.col("text"))).cast("boolean")
    body = records.where(F.when(F.col("first"), F.when(expected, F.lit(False)).otherwise(problem)).otherwise(F.lit(True)))
    if place is None:
        return body.select(fields.alias("r")).select("r.*")
    names = spark.read.format("binaryFile").load(path).select(       # lists the files, reads none
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"))
    return body.join(names, "file").select(fields.alias("r"), F.struct(F.col("name").alias("file"), "start", "n").alias(place)).select("r.*", place)
