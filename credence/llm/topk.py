"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances by one more component: with M the greatest norm, a candidate x gets
sqrt(M^2 - |x|^2), a query 0, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x. Every candidate is keyed by its
nearest pivot and its distance to it; the index is sorted by that key and cut into annuli. For a query at
distance e from the pivot, an annulus [a, b] holds nothing nearer than max(0, a - e, e - b): the annuli
are visited in that order until this bound cannot reach the query's k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from credence.llm.common import schema
from credence.session import stage, stage_path

K = 20
QUERY_EVERY = 20
SCALE = 64
PIVOTS = 64
SEEDS = 4096             # candidates that give every query a first lower bound
QUERY_BLOCK = 4096       # queries that are searched for in one pass
PARTITION_ROWS = 1 << 16
ANNULUS = 512            # candidates


def vectors_of(values: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers from a list array; shorter ones end in zeros."""
    ends = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = np.zeros((len(values), dims))
    if len(values) and (sizes == dims).all():
        out[:] = flat[ends[0]:ends[-1]].reshape(-1, dims)
    else:
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            out[i, :b - a] = flat[a:b]
    return out


def distances(rows: np.ndarray, lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows with an extra component to pivots whose last column is theirs."""
    squares = (rows ** 2).sum(axis=1) + lifted ** 2
    cross = rows @ pivots[:, :-1].T + np.outer(lifted, pivots[:, -1])
    return np.sqrt(np.maximum(squares[:, None] + (pivots ** 2).sum(axis=1)[None, :] - 2 * cross, 0))


def top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id, then row."""
    return np.lexsort((rows, ids, -scores))[:k]


@dataclass
class Shared:
    """What every search task needs: a block of queries and the pivots."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    least: np.ndarray        # a lower bound of each query's k-th best score
    to_pivots: np.ndarray
    square: float            # M^2
    k: int


class Gathered:
    """Scores of one query that may be among its k best."""

    def __init__(self, least: float, k: int) -> None:
        self.least, self.k, self.n, self.parts = least, k, 0, []

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((scores, ids, rows))
        self.n += len(scores)
        if self.n >= 2 * self.k or self.n >= self.k and self.least == -np.inf:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.parts:
            return None
        scores, ids, rows = (np.concatenate(x) for x in zip(*self.parts))
        at = top(scores, ids, rows, self.k)
        best = (scores[at], ids[at], rows[at])
        self.parts, self.n = [best], len(at)
        if len(at) == self.k:
            self.least = max(self.least, float(best[0][-1]))
        return best


def search(s: Shared, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, dist: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, Gathered]]:
    """Candidates in index order against all queries of the block."""
    cuts = np.flatnonzero(np.diff(pivots)) + 1
    edges = sorted({0, len(rows), *cuts.tolist(), *(a + i for a, b in zip([0, *cuts], [*cuts, len(rows)]) for i in range(0, b - a, ANNULUS))})
    annuli = list(zip(edges, edges[1:]))
    of = np.array([pivots[a] for a, _ in annuli])
    inner, outer = np.array([dist[a:b].min() for a, b in annuli]), np.array([dist[a:b].max() for a, b in annuli])
    e = s.to_pivots[:, of]
    gap = np.maximum(np.maximum(inner[None, :] - e, e - outer[None, :]), 0)
    norms = (s.vectors ** 2).sum(axis=1)
    slack = 1e-9 * (s.square + norms) + 1e-6
    bound = (norms[:, None] + s.square - np.maximum(gap - 1e-6, 0) ** 2) / 2 + slack[:, None]      # no score in the annulus is greater
    order = np.argsort(-bound, axis=1, kind="stable")
    found = [Gathered(float(t), s.k) for t in s.least]
    open_queries = np.arange(len(s.rows))
    for turn in range(len(annuli)):
        next_annulus = order[open_queries, turn]
        least = np.array([found[q].least for q in open_queries])
        go = bound[open_queries, next_annulus] >= least
        open_queries, next_annulus, least = open_queries[go], next_annulus[go], least[go]
        if not len(open_queries):
            break
        for number in np.unique(next_annulus):
            a, b = annuli[number]
            here = next_annulus == number
            queries = open_queries[here]
            scores = x[a:b] @ s.vectors[queries].T
            hit, column = np.nonzero((scores >= least[here][None, :]) & (rows[a:b, None] != s.rows[queries][None, :]))
            by_query = np.argsort(column, kind="stable")
            hit, column = hit[by_query], column[by_query]
            starts = np.flatnonzero(np.diff(column, prepend=-1))
            for c, at, end in zip(column[starts], starts, [*starts[1:], len(column)]):
                places = hit[at:end]
                found[queries[c]].add(scores[places, c], ids[a + places], rows[a + places])
    return ((q, g) for q, g in enumerate(found) if g.n)


def quantized(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Staged (row, id, v): floor(scale * x) of every component, for rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = embeddings.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)

    def floor(y: Column) -> Column:      # beyond 2^53 every number is whole
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(F.when(F.abs(y) < 2.0 ** 53, y)).cast("double")).otherwise(y)

    v = F.transform(vector, lambda x: floor(x.cast("double") * scale))
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), v.alias("v")), "quantized")


INDEX = "pivot int, dist double, row bigint, id bigint, v array<double>"


def build_index(rows: DataFrame, pivots: np.ndarray, square: float, n: int) -> DataFrame:
    """Staged index sorted by (pivot, distance); ``row`` in the range key lets equal vectors be divided."""
    dims = pivots.shape[1] - 1

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors_of(b["v"], dims)
            d = distances(x, np.sqrt(np.maximum(square - (x ** 2).sum(axis=1), 0)), pivots)
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest]), b["row"], b["id"], b["v"]],
                ["pivot", "dist", "row", "id", "v"])

    keyed = rows.select("row", "id", "v").mapInArrow(key, schema(INDEX))
    parts = max(1, -(-n // PARTITION_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ANNULUS)))
    return stage(keyed.repartitionByRange(parts, "pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row"), "pivot-index")


def is_query(key: Column | str = "id", every: int = QUERY_EVERY) -> Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(every)) == 0


def top_k(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, query: Column | None = None,
          scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """Each query's ``k`` greatest inner products: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by 20, or those for which ``query``, a condition on ``id``,
    holds; candidates are all rows but the query's own, so that a row that repeats a query's id is a
    candidate. Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors of
    unequal length are compared as if the shorter ended in zeros. Ties go to the smaller id. Scores are exact
    below 2^53 and the nearest representable number, at most the largest long, beyond. No rows, no result.

    Queries are searched for in blocks of ``QUERY_BLOCK``, each broadcast and passed over the index once. A
    block's first bounds come from ``SEEDS`` candidates; they only save work. All candidates are indexed.
    """
    spark = embeddings.sparkSession
    rows = quantized(embeddings, key, vector, scale)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"),
                    F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    result = schema("query bigint, query_id bigint, id bigint, row bigint, score double")
    if not size["n"]:
        return spark.createDataFrame([], schema("query_id bigint, rank int, vec_id bigint, score bigint"))
    dims, square = size["dims"], float(size["square"])

    def local(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = df.select("row", "id", "v").toArrow().combine_chunks()
        if not t.num_rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dims))
        return t["row"].to_numpy(), t["id"].to_numpy(), vectors_of(t["v"].combine_chunks(), dims)

    by_hash = rows.orderBy(F.xxhash64("row"), "row")
    _, _, chosen = local(by_hash.limit(pivots))
    centres = np.column_stack([chosen, np.sqrt(np.maximum(square - (chosen ** 2).sum(axis=1), 0))])
    seed_rows, _, seeds = local(by_hash.limit(SEEDS))
    index = build_index(rows, centres, square, size["n"])

    asked = rows.where(is_query() if query is None else query)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = stage_path(spark, "top-k")
    indexed = to_arrow_schema(schema(INDEX))
    names = result.names
    for number in range(blocks):
        q_rows, q_ids, q = local(asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number))
        least = np.full(len(q), -np.inf)
        if len(seeds) > k:
            for at in range(0, len(q), 512):
                scores = q[at:at + 512] @ seeds.T
                scores[q_rows[at:at + 512, None] == seed_rows[None, :]] = -np.inf
                least[at:at + 512] = np.partition(scores, -k, axis=1)[:, -k]
        block = spark.sparkContext.broadcast(Shared(q_rows, q_ids, q, least, distances(q, np.zeros(len(q)), centres), square, k))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            s = block.value
            table = pa.Table.from_batches(list(batches), indexed)
            if not table.num_rows or not len(s.rows):
                return
            at = np.lexsort((table["row"].to_numpy(), table["dist"].to_numpy(), table["pivot"].to_numpy()))
            x = vectors_of(table["v"].combine_chunks(), dims)[at]
            rows_, ids = table["row"].to_numpy()[at], table["id"].to_numpy()[at]
            kept = []
            for i, g in search(s, rows_, ids, table["pivot"].to_numpy()[at], table["dist"].to_numpy()[at], x):
                scores, found, places = g.cut()
                kept.append((np.full(len(scores), s.rows[i]), np.full(len(scores), s.ids[i]), found, places, scores))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept)], names)

        index.mapInArrow(run, result).write.mode("append").parquet(out)
    found = spark.read.schema(result).parquet(out)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    longs = F.when(F.col("score") >= 2.0 ** 63, F.lit(2 ** 63 - 1)).when(F.col("score") <= -2.0 ** 63, F.lit(-2 ** 63)).otherwise(F.col("score").cast("bigint"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), longs.alias("score")))
