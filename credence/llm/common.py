"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


SLICE_ROWS = 256        # of an Arrow batch that are Python objects at a time
_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one object. A task that asks for another one drops it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples of Python objects, made slice by slice."""
    for b in batches:
        for start in range(0, b.num_rows, SLICE_ROWS):
            yield from zip(*[c.to_pylist() for c in b.slice(start, SLICE_ROWS).columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def crc32_mod(key: Column | str, n: int) -> Column:
    """crc32 of the key written as text, modulo ``n``; null keys give null."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


BATCH_ROWS = 1_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batch to ``BATCH_ROWS`` rows: 10,000 whole documents, the default, are held
    several times over in the JVM and in the Python worker of every task."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], out: str | T.StructType,
             batch: int = 2048) -> DataFrame:
    """``rows`` turns the partition's rows, as dicts in their order, into tuples of ``out``.

    Rows come one Arrow batch at a time and leave in batches of ``batch``, so that a task holds
    neither its whole input nor its whole output.
    """
    small_batches(df)
    to = schema(out) if isinstance(out, str) else out
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(to)

        def source() -> Iterator[dict]:
            for values in rows_of(batches):
                yield dict(zip(names, values))

        def pack(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)

        done: list[tuple] = []
        for row in rows(source()):
            done.append(row)
            if len(done) >= batch:
                yield pack(done)
                done = []
        if done:
            yield pack(done)

    return df.mapInArrow(run, to)


def map_texts(df: DataFrame, key: Column, text: Column, work: Callable[[Iterator[tuple[Any, str | None]]], Iterable[tuple]],
              out: str, batch: int = 2048) -> DataFrame:
    """``work`` sees (key, text) pairs of a partition in order; only these two columns reach Python."""
    def rows(source: Iterator[dict]) -> Iterable[tuple]:
        return work((r["k"], r["t"]) for r in source)
    return map_rows(df.select(key.alias("k"), text.alias("t")), rows, out, batch)


def filter_rows(df: DataFrame, text: str, prepare: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """Rows, with all their columns as they are, whose text is accepted by what ``prepare`` returns in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = prepare()
        for b in batches:
            texts = b.column(place)
            mask = [x for start in range(0, len(texts), SLICE_ROWS) for x in keep(texts.slice(start, SLICE_ROWS).to_pylist())]
            yield b.filter(pa.array(mask, pa.bool_()))

    small_batches(df)
    place = df.columns.index(text)
    return df.mapInArrow(run, df.schema)


def batches_by_bytes(pairs: Iterable[tuple[Any, str | None]], limit: int) -> Iterator[list[tuple[Any, str]]]:
    """Runs of pairs whose texts (null: empty) have about ``limit`` characters together; a longer text is a run alone."""
    run: list[tuple[Any, str]] = []
    size = 0
    for key, text in pairs:
        text = text or ""
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append((key, text))
        size += len(text)
    if run:
        yield run
