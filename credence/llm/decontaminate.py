"""Benchmark decontamination: Wu-Manber search for many word patterns at once.

The alphabet is the word. For the patterns of one length m the shift table says, per block of the last
two words looked at, how far the window may move before a pattern can end there; blocks in no pattern
allow a move of m - 1. Where the shift is 0 the block's bucket lists the patterns that end with it, and
comparing them word by word confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import filter_rows, map_rows

WINDOW = 10
BLOCK = 2
BLOCK_BYTES = 32 << 20      # of benchmark texts that are searched for in one pass over the documents

# Word characters of the contract, after A-Z are lower-cased.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Patterns:
    """Tables for the patterns of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[Any]]] = {}

    def add(self, pattern: tuple[bytes, ...], item: Any) -> None:
        n, b = self.length, self.block
        for end in range(b, n + 1):
            part = pattern[end - b:end]
            self.shift[part] = min(self.shift.get(part, self.most), n - end)
        self.buckets.setdefault(pattern[n - b:], {}).setdefault(pattern, set()).add(item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[Any]]]:
        """(start, items) of each occurrence, in order."""
        n, m, most = len(text), self.length, self.most
        shift, buckets = self.shift, self.buckets
        at = m
        if self.block == 2:
            while at <= n:
                part = (text[at - 2], text[at - 1])
                move = shift.get(part, most)
                if move:
                    at += move
                    continue
                items = buckets[part].get(tuple(text[at - m:at]))
                if items:
                    yield at - m, items
                at += 1
        else:
            for i, word in enumerate(text):
                if (word,) in buckets:
                    yield i, buckets[(word,)][(word,)]


def build(items: Iterable[tuple[Any, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Windows of ``window`` consecutive words; an item of fewer words is one window, one of none has none."""
    by_length: dict[int, Patterns] = {}
    for item, text in items:
        found = words(text)
        m = min(window, len(found))
        for start in range(len(found) - m + 1 if m else 0):
            by_length.setdefault(m, Patterns(m)).add(tuple(found[start:start + m]), item)
    return list(by_length.values())


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[Any, str | None]]]:
    """The benchmark in runs of about ``block_bytes``, one at a time: the query set of one pass each. An empty one is one run."""
    run: list[tuple[Any, str | None]] = []
    size = 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len(r["t"] or "") + 64
        if run and size + n > block_bytes:
            yield run
            run, size = [], 0
        run.append((r["i"], r["t"]))
        size += n
    yield run


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: key, n_words, hits (array of [start, end) word ranges, disjoint and in order), items.

    ``items`` are the distinct ids, as text, of the items with a window in the document, sorted. The benchmark
    is a stated query set: it is searched for in blocks of bounded size, each in one pass that takes the
    ranges found so far along, so nothing is shuffled and no document is looked at twice for one block.
    A null or empty text has no words, a null item id counts as the text ``null``; null and repeated keys are
    rows of their own, and an empty benchmark hits nothing. Columns other than the named ones are not read.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    out = f"k {kind}, t string, n bigint, hits array<array<bigint>>, items array<string>"
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    runs = blocks(benchmark, item, item_text, block_bytes)
    run = next(runs, None)
    while run is not None:
        shared = spark.sparkContext.broadcast(run)      # at most block_bytes and one text
        run = next(runs, None)
        last = run is None

        def search(source: Iterator[dict], shared=shared, last=last) -> Iterable[tuple]:
            tables = build(((str(i) if i is not None else "null", t) for i, t in shared.value), window)
            for r in source:
                text_words = words(r["t"])
                ranges = [tuple(x) for x in r.get("hits") or ()]
                items = set(r.get("items") or ())
                for p in tables:
                    for start, these in p.search(text_words):
                        if ranges and ranges[-1][0] <= start <= ranges[-1][1]:
                            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], start + p.length))
                        else:
                            ranges.append((start, start + p.length))
                        items |= these
                yield r["k"], None if last else r["t"], len(text_words), merged(ranges), sorted(items)

        found = map_rows(found, search, out)
    return found.select(F.col("k").alias(key), F.col("n").alias("n_words"), "hits", "items")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows in which no window of the benchmark occurs, as they are."""
    for run in blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(run)

        def prepare(shared=shared) -> Callable[[list[str | None]], list[bool]]:
            tables = build(shared.value, window)
            return lambda texts: [not any(next(p.search(w), None) for p in tables) for w in map(words, texts)]

        docs = filter_rows(docs, text, prepare)
    return docs


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of ``find``: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])
    return found.select(
        found.columns[0], "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
