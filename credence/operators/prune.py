"""Terms that surely occur in too few documents, found before their rows are shuffled.

Tasks count the 64-bit hashes of their documents' terms and send them packed: four bytes of hash and one of count
per distinct term, counts at most as high as the least frequency that is asked for. Sums of packed counts are never too low,
equal hashes can only raise them. What may occur often enough sets its bit in a filter of fixed size; terms
whose bit is not set need not be moved, all others are counted by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.operators.lookup import FILTER_BITS, filter_word, filter_words, passes

TASK_TERMS = 2_000_000       # hashes that a task counts at a time
GROUP_TERMS = 4_000_000      # of all documents per group of hashes that is added up at once


def frequent_words(docs: DataFrame, least: dict[str, int], bits: int = FILTER_BITS) -> DataFrame:
    """A filter over ``xxhash64(route, term)`` of the terms of (route, terms) that may be in ``least[route]`` documents or more.

    A document brings each of its terms once. The groups grow in number with the corpus.
    """
    if bits > 32:
        raise ValueError("hashes are kept in 32 bits")
    wide = max(least.values()) > 255
    chosen = docs.where(F.col("route").isin(list(least)))
    hashed = chosen.select("route", F.transform("terms", lambda t: F.xxhash64("route", t["term"])).alias("ids"))
    # Of the terms, not of their hashes: those would be computed only to be counted.
    total = chosen.agg(F.sum(F.size("terms").cast("long")).alias("n")).first()["n"] or 0
    groups, most = max(1, -(-total // GROUP_TERMS)), TASK_TERMS
    kind = np.uint32 if wide else np.uint8

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for route, parts in waiting.items():
                ids, counts = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
                group = (ids >> np.uint64(32)) % np.uint64(groups)
                order = np.argsort(group, kind="stable")
                ids, counts, group = ids[order].astype(np.uint32), np.minimum(counts[order], least[route]).astype(kind), group[order]
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
                for a, b in zip(starts, [*starts[1:], len(group)]):
                    yield pa.RecordBatch.from_pydict({
                        "route": [route], "g": [int(group[a])], "h": pa.array([ids[a:b].tobytes()], pa.binary()),
                        "c": pa.array([counts[a:b].tobytes()], pa.binary())})
            waiting.clear()
        for b in batches:
            routes, ids = b.column("route").to_numpy(zero_copy_only=False), b.column("ids")
            for route in set(routes):
                found = ids.filter(pa.array(routes == route)).flatten().to_numpy(zero_copy_only=False)
                waiting.setdefault(route, []).append(found)
                size += len(found)
            if size >= most:
                yield from out()
                size = 0
        yield from out()

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("h")])
        c = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column("c")])
        ids, place = np.unique(h, return_inverse=True)
        sums = np.bincount(place, weights=c, minlength=len(ids))
        return pa.table({"_id": ids[sums >= least[key[0].as_py()]].astype(np.int64)})

    found = hashed.mapInArrow(packed, "route string, g long, h binary, c binary").groupBy("route", "g").applyInArrow(add, "_id long")
    return filter_words(found, bits, "frequent-terms")


def only_frequent(terms: DataFrame, words: DataFrame, routes: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """Rows (route, term, ...) whose bit is set, and all rows of other routes than ``routes``."""
    marked = terms.withColumn("_id", F.xxhash64("route", "term")).withColumn("_word", filter_word(bits))
    return marked.join(words, "_word", "left").where(~F.col("route").isin(routes) | F.coalesce(passes(), F.lit(False))).drop("_id", "_word", "_bits")
