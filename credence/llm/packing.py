"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import batches_by_bytes, map_texts, schema
from credence.llm.encoding import MEMO_PIECES, encoder, tokenizer_path
from credence.session import stage

SEQUENCE = 2048
END_ID = 1
GROUP = 4096            # documents in a group, about
BATCH_CHARS = 500_000
FULL = 1 << 62          # sequence ids of pieces that fill a sequence alone start here


class Tournament:
    """Free space of ``n`` bins in order; each inner node holds the larger of its two children."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(n - 1, 0).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """Takes ``size`` from the first bin that has it; returns that bin."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        place = at - self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            a, b = best[2 * at], best[2 * at + 1]
            top = a if a > b else b
            if best[at] == top:
                break
            best[at] = top
        return place


def first_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[int]:
    """The bin of each length. The longest come first, equal ones in the order given; no length exceeds ``capacity``."""
    tree = Tournament(len(lengths), capacity)
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i] = tree.first(lengths[i])
    return bins


def document_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID,
                    tokenizer: str | None = None, memo: int = MEMO_PIECES) -> DataFrame:
    """Pieces of at most ``sequence`` ids: row, key, start, length, ids_crc32, doc_tokens.

    ``row`` numbers the documents of the scan. A document's ids are those of its text (null: none) and
    ``end_id``; it is cut each ``sequence`` ids, so that only its last piece may be shorter.
    """
    path = tokenizer or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")

    def work(pairs: Iterator[tuple[Any, str | None]]) -> Iterable[tuple]:
        row = TaskContext.get().partitionId() << 33
        for run in batches_by_bytes(pairs, BATCH_CHARS):
            for (k, _), ids in zip(run, encoder(path, memo).encode([t for _, t in run])):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, sequence):
                    piece = ids[4 * start:4 * (start + sequence)]
                    yield row, k, start, len(piece) // 4, zlib.crc32(piece), n
                row += 1

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, F.col(key), F.col(text), work,
                     f"row bigint, k {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID,
         group: int = GROUP, seed: int = 17, tokenizer: str | None = None, memo: int = MEMO_PIECES) -> DataFrame:
    """Every id of every document in exactly one piece, every piece in one sequence of at most ``sequence`` ids.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id, offset. The texts are encoded once;
    what moves afterwards is a short row per document. A piece of ``sequence`` ids is a sequence alone.
    The rest, one piece per document at most, is dealt by a seeded hash of its row number into groups
    of about ``group``, so that equal keys or texts never gather in one group, and each group is packed
    first-fit decreasing in its own task. ``memo``: pieces whose ids a worker remembers, in each of two generations.

    A null or empty text is a document of the end id alone. Null and repeated keys are documents of their
    own. An empty table gives no rows. Columns other than the key and the text are not read.
    """
    pieces = stage(document_pieces(docs, key, text, sequence, end_id, tokenizer, memo), "pieces")
    n = pieces.where(F.col("length") < sequence).count()
    groups = max(1, -(-n // group))
    out = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def one_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "start"], kind="stable", ignore_index=True)
        rows["bin"] = first_fit_decreasing(rows["length"].tolist(), sequence)
        rows["sequence_id"] = rows["g"] * (1 << 32) + rows["bin"]
        rows["offset"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return rows[out]

    full = pieces.where(F.col("length") == sequence)
    alone = full.select(*out[:5], (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    dealt = pieces.where(F.col("length") < sequence).withColumn("g", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    kind = docs.schema[key].dataType.simpleString()
    packed = dealt.groupBy("g").applyInPandas(one_group, schema(
        f"k {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"))
    return packed.unionByName(alone).withColumnRenamed("k", key)
