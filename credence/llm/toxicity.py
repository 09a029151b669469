"""Toxicity by a factorization machine over hashed terms.

z = bias + sum of w over a text's distinct terms + sum over all pairs of terms of the inner product of
their factors; the score is 1 / (1 + exp(-z)). The pairs let two terms that are harmless alone count
together, and one term change what another says. Terms are the words and their first letters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import batches_by_bytes, crc32_mod, filter_rows, kept, map_texts, schema
from credence.session import stage

BITS = 20
FACTORS = 4
STEM = 4                # letters of the second kind of term
TRAIN_ROWS = 20_000     # labelled rows to fit on, half of them of each class at most
MIN_DOCS = 3            # terms in fewer training rows are left out
MIN_CHI = 10.8          # the 0.1 % point of one degree of freedom; the machine learns all terms that tell the classes apart so far
EPOCHS, BATCH, RATE = 10, 256, 0.2
DECAY, FACTOR_DECAY = 1e-4, 1e-4      # a row and step; at 1e-2 the factors shrink to zero and only w is left
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
SLICE = 1 << 20
MEMO = 150_000          # words whose hashes a worker keeps
PARTS = 10 ** 12        # steps of the share of labelled rows that is kept
BATCH_CHARS = 1_000_000

_separators = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_gap = re.compile(r"\s")


def term_ids(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's words and word beginnings; 0 is in every text, for the bias."""
    words: set[str] = set()
    start = 0
    while start < len(text):
        gap = _gap.search(text, start + SLICE)      # a slice ends between words
        end = gap.start() if gap else len(text)
        part = text[start:end].lower().encode("utf-8", "replace").translate(_separators)
        words.update(part.decode("utf-8").split())
        start = end
    memo = kept("term hashes", dict)
    if len(memo) > MEMO:
        memo.clear()
    out = {0}
    for w in words:
        h = memo.get(w)
        if h is None:
            mask = (1 << BITS) - 1
            memo[w] = h = (zlib.crc32(w.encode()) & mask) << 32 | zlib.crc32(b"^" + w[:STEM].encode()) & mask
        out.add(h >> 32)
        out.add(h & 0xFFFFFFFF)
    return np.array(sorted(out), dtype=np.int32)


def machine(weights: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(z per row, sum of factors per row); ``weights`` has w in its first column and the factors in the rest."""
    x = weights[ids]
    sums = np.add.reduceat(x, starts, axis=0)
    squares = np.add.reduceat((x[:, 1:] ** 2).sum(axis=1), starts)
    return sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares), sums[:, 1:]


def telling_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Hashes of the bias and of the terms whose presence tells the classes apart, by chi-square."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)      # texts with a term, per class
    for row, label in zip(rows, labels):
        counts[int(label), row] += 1
    seen = counts.sum(axis=0)
    hashes = np.flatnonzero(seen)
    seen, positive = seen[hashes], counts[1, hashes]
    expected = seen * labels.mean()
    off = (positive - expected) ** 2
    chi = off / np.maximum(expected, 1e-9) + off / np.maximum(seen - expected, 1e-9)
    usable = (seen >= MIN_DOCS) & (chi >= MIN_CHI)
    return np.unique(np.append(hashes[usable], 0))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 3,
                counts_for: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) by AdaGrad on the log loss with weight decay; accumulators start at 1, so rare terms move little.
    ``counts_for`` says how many rows each row stands for, where they were not sampled at one rate."""
    hashes = telling_terms(rows, labels)
    rows = [np.searchsorted(hashes, np.intersect1d(r, hashes, assume_unique=True)) for r in rows]
    worth = np.ones(len(rows)) if counts_for is None else counts_for / counts_for.mean()
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 0.01, (len(hashes), 1 + factors))
    weights[:, 0] = 0
    gathered = np.ones(weights.shape)
    decay = np.array([DECAY] + [FACTOR_DECAY] * factors)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            sizes = np.array([len(rows[i]) for i in batch])
            ids = np.concatenate([rows[i] for i in batch])
            z, sums = machine(weights, ids, np.cumsum(sizes) - sizes)
            g = np.repeat(worth[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]), sizes)
            others = np.repeat(sums, sizes, axis=0) - weights[ids][:, 1:]
            step = decay * len(batch) * weights
            step[:, 0] += np.bincount(ids, weights=g, minlength=len(hashes))
            for f in range(factors):
                step[:, 1 + f] += np.bincount(ids, weights=g * others[:, f], minlength=len(hashes))
            gathered += step ** 2
            weights -= RATE * step / np.sqrt(gathered)
    return hashes, weights.astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Staged model (hash, weights) from labelled rows whose key is not held out.

    A key with several labels has the greatest. Of each class the rows with the smallest hash of the key are
    kept so that about ``train_rows`` / 2 remain at most: a sample whose bound is this argument, fitted in
    one task. Each row weighs as many rows as it was drawn from, so that scores follow the labels' own balance
    of classes whatever the table's size. A key that several documents share counts once. Without rows of both
    classes the model has no terms, or only a bias, and says so in its scores.
    """
    known = (labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
             .groupBy("k").agg(F.max("y").alias("y")).where(~held_out("k")))
    known = stage(known.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(PARTS))), "labels")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, train_rows / 2 / n) for y, n in sizes.items()}
    keep = F.lit(False)
    for y, part in share.items():
        keep = keep | ((F.col("y") == y) & (F.col("h") < int(part * PARTS)))
    chosen = known.where(keep).select("k", "y")       # its size is known and bounded by train_rows
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")

    def work(pairs: Iterator[tuple[Any, str | None]]) -> Iterable[tuple]:
        for k, t in pairs:
            yield k["k"], k["y"], term_ids(t or "").tolist()

    kind = labels.schema[key].dataType.simpleString()
    rows = map_texts(texts, F.struct("k", "y"), F.col("t"), work, f"k {kind}, y int, ids array<int>", batch=256)
    rows = rows.groupBy("k").agg(F.max("y").alias("y"), F.max("ids").alias("ids"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        sample = pa.Table.from_batches(found).combine_chunks().sort_by("k")
        ids = sample["ids"].combine_chunks()
        flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        y = sample["y"].to_numpy()
        drawn_from = np.array([1 / share[int(v)] for v in y])
        hashes, weights = fit_machine([flat[a:b] for a, b in zip(ends, ends[1:])], y.astype(float), counts_for=drawn_from)
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int32()), pa.array(list(weights), pa.list_(pa.float32()))], ["hash", "weights"])

    return stage(rows.repartition(1).mapInArrow(fit, schema("hash int, weights array<float>")), "toxicity-model")


def table_of(model: DataFrame, factors: int) -> np.ndarray:
    """Weights by hash, zeros for what was not learned: 2^20 rows."""
    found = model.toPandas()
    dense = np.zeros((1 << BITS, 1 + factors), dtype=np.float32)
    if len(found):
        dense[found["hash"].to_numpy()] = np.stack(found["weights"].to_numpy())
    return dense


def probabilities(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    ids = [term_ids(t) for t in texts]
    sizes = np.array([len(x) for x in ids])
    z, _ = machine(weights, np.concatenate(ids), np.cumsum(sizes) - sizes)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def score(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", factors: int = FACTORS) -> DataFrame:
    """Per row: key, score, predicted. The model, 2^20 hashes at most, goes to the tasks as one broadcast.

    A null text is an empty one, which scores the bias. Null and repeated keys are rows of their own; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table_of(model, factors))

    def work(pairs: Iterator[tuple[Any, str | None]]) -> Iterable[tuple]:
        for run in batches_by_bytes(pairs, BATCH_CHARS):
            p = probabilities(shared.value, [t for _, t in run])
            for (k, _), x in zip(run, p.tolist()):
                yield k, x, int(x >= THRESHOLD)

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, F.col(key), F.col(text), work, f"k {kind}, score double, predicted int").withColumnRenamed("k", key)


def harmless(docs: DataFrame, model: DataFrame, text: str = "text", factors: int = FACTORS) -> DataFrame:
    """The rows that score below ``THRESHOLD``, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(table_of(model, factors))

    def keep(texts: list[str | None]) -> list[bool]:
        return [bool(p < THRESHOLD) for run in batches_by_bytes(((None, t) for t in texts), BATCH_CHARS)
                for p in probabilities(shared.value, [t for _, t in run])]

    return filter_rows(docs, text, lambda: keep)


def held_out(key: Column | str) -> Column:
    """Rows that are never learned from; a null key is not held out."""
    return F.coalesce(crc32_mod(key, FOLDS) == HELD_OUT, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
         train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learns from the labels and scores all documents: key, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels, key, text, label, train_rows), key, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")
