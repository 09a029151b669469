"""SimHash near copies by anchor points.

A fingerprint has one bit per bit of its shingles' hashes: 1 if more than half of them have it. Equal fingerprints
are one class. To find the classes whose fingerprints differ in at most ``bits`` bits, the 64 bits are cut into parts
whose thresholds, each plus one, add up to ``bits + 1``: two fingerprints that link differ in one of the parts by no more
than its threshold. In every part the code words of a covering code are the anchors. The code is the Hamming code
of 15 bits, with the part's other bits free, so that every value has exactly one anchor within radius 1, its home.
A fingerprint is sent to every anchor within the covering radius plus the part's threshold; two that link so meet
at the home of either. Per anchor those at home are compared with all who came, on all 64 bits.

Anchors with many fingerprints are a grid of home and visitor groups of bounded size. A task returns a spanning
forest of the links of each bundle of comparisons, not all pairs of a cluster; components follow from these.

Null and empty texts, and those without words, have fingerprint zero and link like any other. Null ids have a
fingerprint and take part; a component's number is the least id that is not null, null if there is none. Rows
that repeat another, and rows with equal ids, are rows of their own. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import map_texts, small_batches
from credence.llm.components import components
from credence.session import stage

WORDS = 4
BITS = 4                    # differing bits of a link
SEED = 42
PARTS = (21, 21, 22)        # widths, from the low end
HAMMING = 15                # low bits of a part that its code covers
RADIUS = 1
HOMES = 4096                # fingerprints at home at an anchor that one task compares
VISITORS = 65_536
PAIRS = 1 << 21             # comparisons at a time
ROWS = 1 << 16
SLICE = 1 << 20             # bytes of a text that are cut into words at a time

_BLANK = re.compile(rb"[ \t-\r]")


# ----------------------------------------------------------------------------- fingerprints

def hashes(raw: bytes, n: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of the ``n``-word shingles, repeats included, a slice of the text at a time."""
    raw = raw.lower()           # bytes: A-Z only
    before: list[bytes] = []
    start, whole = 0, False
    while start < len(raw):
        gap = _BLANK.search(raw, min(start + SLICE, len(raw)))
        end = gap.start() if gap else len(raw)
        words = before + raw[start:end].split()     # of bytes: 0x20 and 0x09 to 0x0D
        if len(words) >= n:
            found = map(b" ".join, zip(*[words[i:] for i in range(n)]))
            yield np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(words) - n + 1)
            whole = True
        before, start = words[-(n - 1):] if n > 1 else [], end
    if before and not whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], np.uint64)


def fingerprint(text: str | bytes | None, n: int = WORDS) -> int:
    """As a signed 64-bit number."""
    raw = text.encode() if isinstance(text, str) else text or b""
    ones, total = np.zeros(64, np.int64), 0
    for h in hashes(raw, n):
        for s in range(0, len(h), ROWS):
            part = h[s:s + ROWS]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""
    def work(pairs: Iterable[tuple[int | None, bytes | None]]) -> Iterator[tuple]:
        for key, text in pairs:
            yield key, fingerprint(text, n)
    return map_texts(docs, F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"), work, "doc_id long, fp long")


# ----------------------------------------------------------------------------- anchors

def thresholds(bits: int, parts: int) -> list[int]:
    """Per part the differing bits up to which it must find a pair; -1: the part is not needed."""
    share, more = divmod(bits + 1, parts)
    return [share + (i < more) - 1 for i in range(parts)]


def syndrome(value: int) -> int:
    out = 0
    for j in range(HAMMING):
        if value >> j & 1:
            out ^= j + 1
    return out


def steps(width: int, reach: int) -> list[list[int]]:
    """Per syndrome what is to be flipped to get to the anchors within ``reach``."""
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    def flip(value: int, first: int, left: int) -> None:
        out[syndrome(value)].append(value)
        if left:
            for j in range(first, width):
                flip(value | 1 << j, j + 1, left - 1)
    flip(0, 0, reach)
    return out


def _syndrome(value: Column) -> Column:
    out = F.lit(0)
    for b in range(HAMMING.bit_length()):
        mask = sum(1 << j for j in range(HAMMING) if (j + 1) >> b & 1)
        out = out + F.bit_count(value.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * F.lit(1 << b)
    return out


def visits(reps: DataFrame, bits: int = BITS, widths: tuple[int, ...] = PARTS) -> DataFrame:
    """(cell, fp, home): every anchor that a fingerprint is sent to; one of each part is its home."""
    if sum(widths) != 64 or min(widths) < HAMMING or max(widths) > 32:
        raise ValueError(f"{widths} are no widths of parts of 64 bits, {HAMMING} to 32 each")
    out, at = [], 0
    for k, (width, limit) in enumerate(zip(widths, thresholds(bits, len(widths)))):
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
        at += width
        if limit < 0:
            continue
        flips = steps(width, RADIUS + limit)
        home = [0] + [1 << j for j in range(HAMMING)]
        rows = reps.select("fp", value.alias("v")).withColumn("s", _syndrome(F.col("v"))).select(
            "fp", "v", F.get(F.lit(home), F.col("s")).cast("long").alias("near"),
            F.explode(F.get(F.array(*[F.lit(f).cast("array<long>") for f in flips]), F.col("s"))).alias("e"))
        out.append(rows.select((F.lit(k << 32) + F.col("v").bitwiseXOR(F.col("e"))).alias("cell"), "fp", (F.col("e") == F.col("near")).alias("home")))
    found = out[0]
    for rows in out[1:]:
        found = found.unionByName(rows)
    return found


# ----------------------------------------------------------------------------- comparisons

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (a, b) connect, fewer than there are nodes."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        now = label.copy()
        np.minimum.at(now, label[u], least)
        np.minimum.at(now, label[v], least)
        now = now[now]
        if np.array_equal(now, label):
            break
        label = now
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _compared(key: np.ndarray, home: np.ndarray, fp: np.ndarray, bits: int, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the links of rows sorted by key, those at home first."""
    new = np.concatenate([[True], np.any(key[1:] != key[:-1], axis=1)])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    at_home = np.bincount(group, weights=home, minlength=len(starts)).astype(np.int64)
    visitors = np.flatnonzero(~home & (at_home[group] > 0))
    sizes = at_home[group[visitors]]
    ends = np.cumsum(sizes)
    first = 0
    while first < len(visitors):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + pairs, "right")))
        n = sizes[first:last]
        v = np.repeat(visitors[first:last], n)
        h = starts[group[v]] + np.arange(len(v)) - np.repeat(ends[first:last] - n - done, n)
        other = fp[v] ^ fp[h]
        hit = (other != 0) & (np.bitwise_count(other) <= bits)
        if hit.any():
            yield forest(fp[v[hit]], fp[h[hit]])
        first = last


def edges(reps: DataFrame, bits: int = BITS, widths: tuple[int, ...] = PARTS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column ``fp``) that connect all that link."""
    sent = visits(reps, bits, widths)
    grid = stage(
        sent.groupBy("cell").agg(F.count_if("home").alias("h"), F.count("*").alias("c"))
        .where((F.col("h") > 0) & (F.col("c") > 1))
        .select("cell", F.ceil(F.col("h") / HOMES).alias("hs"), F.ceil(F.col("c") / VISITORS).alias("vs")), "cells")
    placed = sent.join(grid, "cell").withColumn("x", F.xxhash64("fp"))
    h, v = F.pmod("x", F.col("hs")), F.pmod(F.shiftrightunsigned("x", 32), F.col("vs"))
    mine = placed.where("home").select("cell", h.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("vs") - 1)).alias("j"), F.lit(True).alias("home"), "fp")
    theirs = placed.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hs") - 1)).alias("i"), v.alias("j"), F.lit(False).alias("home"), "fp")
    rows = mine.unionByName(theirs).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", F.desc("home"))
    pairs = PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, fp = np.empty((0, 3), np.int64), np.empty(0, bool), np.empty(0, np.uint64)

        def links() -> Iterator[pa.RecordBatch]:
            for a, b in _compared(key, home, fp, bits, pairs):
                yield pa.RecordBatch.from_pydict({"u": a.view(np.int64), "v": b.view(np.int64)})
        waiting: list[pa.RecordBatch] = []

        def arrays() -> None:
            """What waits, after those at home at the last anchor so far: more visitors of theirs may come."""
            nonlocal key, home, fp
            rest = home & np.all(key == key[-1:], axis=1) if len(key) else home
            t = pa.Table.from_batches(waiting)
            key = np.concatenate([key[rest], np.stack([t.column(c).to_numpy() for c in ("cell", "i", "j")], axis=1)])
            home = np.concatenate([home[rest], t.column("home").to_numpy()])
            fp = np.concatenate([fp[rest], t.column("fp").to_numpy().view(np.uint64)])
            waiting.clear()
        size = 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                size += b.num_rows
            if size >= ROWS:
                arrays()
                yield from links()
                size = 0
        if waiting:
            arrays()
            yield from links()
    small_batches(rows)
    return rows.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, n: int = WORDS, bits: int = BITS, widths: tuple[int, ...] = PARTS) -> DataFrame:
    """(doc_id, fp, component_id): the least id that links of at most ``bits`` differing bits lead to."""
    found = stage(fingerprints(docs, n), "fingerprints")
    reps = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    of = stage(components(edges(reps.select("fp"), bits, widths)), "fingerprint-components")
    tied = reps.join(of, reps["fp"] == of["node"]).select("fp", "least", "component")
    heads = stage(tied.groupBy("component").agg(F.min("least").alias("component_id")), "heads")
    linked = stage(tied.join(heads, "component").select("fp", "component_id"), "linked")
    alone = reps.join(of, reps["fp"] == of["node"], "left_anti").select("fp", F.col("least").alias("component_id"))
    classes = stage(linked.unionByName(alone), "class-heads")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
