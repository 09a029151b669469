"""Token ids as packed binary matrices: best-fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate
from typing import Any

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import batches_by_bytes, map_rows, map_texts, schema
from credence.llm.encoding import encoder, tokenizer_path
from credence.session import stage_path

SEQUENCE = 2048
END_ID = 1
PAD_ID = 0
RUN_TOKENS = 4_000_000      # ids that a task packs at a time
BATCH_CHARS = 500_000


class FreeSpace:
    """Open bins by free capacity: a segment tree counts them per capacity and finds the least that suffices."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, free: int, n: int) -> None:
        at = self.leaves + free
        while at:
            self.count[at] += n
            at //= 2

    def put(self, free: int, place: int) -> None:
        if free:
            self.bins[free].append(place)
            self._add(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, its free capacity) with the least capacity of at least ``size``, no longer open; or None."""
        count, at = self.count, self.leaves + size
        if not count[at]:
            while at > 1 and (at % 2 or not count[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not count[at]:
                    at += 1
        free = at - self.leaves
        self._add(free, -1)
        return self.bins[free].pop(), free


def best_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[int]:
    """The bin of each length; bins are numbered as they are opened and no length exceeds ``capacity``."""
    space, bins, opened = FreeSpace(capacity), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = space.take(lengths[i])
        if found is None:
            found, opened = (opened, capacity), opened + 1
        bins[i] = found[0]
        space.put(found[1] - lengths[i], found[0])
    return bins


OUT = ("sequence_id bigint, ids binary, cu_seqlens array<int>, position_ids binary, "
       "segments array<struct<{key}:{kind},start:bigint,length:int>>")


def pack_rows(docs: DataFrame, key: str, text: str, sequence: int, end_id: int, pad_id: int, tokenizer: str | None,
              run_tokens: int) -> DataFrame:
    path = tokenizer or tokenizer_path()
    end, pad = (int(i).to_bytes(4, "little") for i in (end_id, pad_id))
    ramp, zero, width = position_ramp(sequence)

    def packed(run: list[tuple[Any, int, bytes]], first: int) -> Iterator[tuple]:
        bins = best_fit_decreasing([len(p) // 4 for _, _, p in run], sequence)
        members: dict[int, list[int]] = {}
        for i, b in enumerate(bins):
            members.setdefault(b, []).append(i)
        for b in sorted(members):
            pieces = [run[i] for i in members[b]]
            lengths = [len(p) // 4 for _, _, p in pieces]
            ends = [0, *accumulate(lengths)]
            left = sequence - ends[-1]
            yield (first + b, b"".join([p for _, _, p in pieces]) + pad * left, ends,
                   b"".join([ramp[:width * n] for n in lengths]) + zero * left,
                   [{key: k, "start": start, "length": n} for (k, start, _), n in zip(pieces, lengths)])

    def work(pairs: Iterator[tuple[Any, str | None]]) -> Iterable[tuple]:
        first, run, size = TaskContext.get().partitionId() << 33, [], 0
        for texts in batches_by_bytes(pairs, BATCH_CHARS):
            for (k, _), ids in zip(texts, encoder(path).encode([t for _, t in texts])):
                ids += end
                for start in range(0, len(ids), 4 * sequence):
                    run.append((k, start // 4, ids[start:start + 4 * sequence]))
                    size += len(run[-1][2]) // 4
                    if size >= run_tokens:
                        yield from packed(run, first)
                        first, run, size = first + len(run), [], 0
        if run:
            yield from packed(run, first)

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, F.col(key), F.col(text), work, OUT.format(key=key, kind=kind), batch=256)


def position_ramp(sequence: int) -> tuple[bytes, bytes, int]:
    """(positions 0, 1, 2 ... of a whole sequence, one zero, bytes of a number)."""
    kind = "<u2" if sequence <= 65_536 else "<u4"
    ramp = np.arange(sequence, dtype=kind).tobytes()
    width = len(ramp) // sequence
    return ramp, bytes(width), width


def write_packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID,
                 pad_id: int = PAD_ID, tokenizer: str | None = None, run_tokens: int = RUN_TOKENS) -> None:
    """Writes one row per sequence of ``sequence`` ids as Parquet under ``path`` (a folder all executors reach).

    ``ids`` is a row of the id matrix (little-endian unsigned 32-bit, padded with ``pad_id``); ``cu_seqlens``
    the cumulative segment lengths from 0; ``position_ids`` little-endian positions (16-bit up to 65,536
    ids) that start again at 0 with each segment; ``segments`` the pieces in their order: key, start, length.

    Each task packs its documents in runs of about ``run_tokens`` ids as it reads them: nothing is shuffled,
    and memory holds one run. A document is its ids and ``end_id`` (null or empty text: that id alone); one
    longer than a sequence is cut each ``sequence`` ids, without loss. Null and repeated keys are documents
    of their own; an empty table writes an empty table; other columns are not read.
    """
    rows = pack_rows(docs, key, text, sequence, end_id, pad_id, tokenizer, run_tokens)
    rows.write.option("compression", "zstd").parquet(path)


def digests(docs: DataFrame, sequence: int = SEQUENCE, **options) -> DataFrame:
    """Writes the matrices into the shared folder and returns, per sequence as read back: sequence_id, n_tokens,
    n_segments, cu_seqlens, ids_crc32 (of the ids without padding), positions_ok, doc_ids and starts of the segments."""
    spark = docs.sparkSession
    path = stage_path(spark, "packed-ids")
    write_packed(docs, path, sequence=sequence, **options)

    ramp, zero, width = position_ramp(sequence)

    def rows(source: Iterator[dict]) -> Iterable[tuple]:
        for r in source:
            ends = r["cu_seqlens"]
            expected = b"".join([ramp[:width * (b - a)] for a, b in zip(ends, ends[1:])]) + zero * (sequence - ends[-1])
            yield (r["sequence_id"], ends[-1], len(ends) - 1, ends, zlib.crc32(memoryview(r["ids"])[:4 * ends[-1]]),
                   r["position_ids"] == expected, r["doc_ids"], r["starts"])

    written = spark.read.schema(schema(OUT.format(key="doc_id", kind="bigint"))).parquet(path)
    plain = written.select("sequence_id", "ids", "cu_seqlens", "position_ids",
                           F.col("segments.doc_id").alias("doc_ids"), F.col("segments.start").alias("starts"))
    return map_rows(plain, rows, "sequence_id bigint, n_tokens bigint, n_segments bigint, cu_seqlens array<int>, ids_crc32 bigint, "
                                 "positions_ok boolean, doc_ids array<bigint>, starts array<bigint>")
