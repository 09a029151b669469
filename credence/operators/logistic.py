"""L2 logistic regression whose coefficients and gradients stay distributed, for vocabularies of any size.

The rows X of a route are cut into blocks, each a sparse matrix over the columns that it has. Started at zero,
every iterate and gradient of the optimiser is a combination of rows, X'a. Such a vector p is kept as the pair (a, Xp)
of two numbers per row, next to the rows it belongs to, and the inner product of two of them is a sum over rows,
``p.q = a_p . Xq``. L-BFGS needs sums and inner products only, so its history lies in the row blocks; the driver
sees the inner products and the step, a few hundred numbers. An iteration is one job:

    rows: a -> blocks: X'a on their columns -> column ranges: added up -> blocks: XX'a and the new products

and one small job for the slope along the new direction at many step lengths. No vector over the vocabulary is ever in one
place: a task holds a range of coefficients at a time. What a block sends to a range and gets back is one number
for each of its columns that another block has too, in an order that both sides know; a column of a single block stays there.
So an iteration moves no more than the entries of X, however many columns there are. At the end X'a is written once as a table.

Blocks, their state and the lists of shared columns are kept as serialized Python objects, one per batch, and meet by position:
a block's state never leaves its partition, and tasks get arrays as they are, without rows, sorting or Arrow between. The state is written
to the checkpoint folder every ``CHECKPOINT`` iterations, so that a lost executor costs no more than those.

The intercept is a column of ones and is penalised like any other coefficient. Classes weigh n / (2 n_class).
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from credence.operators.memory import released
from credence.session import stage, staging_root

ROWS = 16_384              # of a block at most
ENTRIES = 1 << 20          # of a block, after which it is closed
COLUMNS = 1 << 15          # of a range at least
RANGES = 64                # of a route, wider ones where it has more columns
CELLS_TOGETHER = 64        # row blocks per range, beyond which there are more ranges
TASKS = 12                 # that add up column ranges at least, where there are as many partitions of rows
HISTORY = 16               # pairs of differences that are kept
CHECKPOINT = 5             # iterations after which the state is written
STEPS = 2.0 ** (np.arange(-72, 25) / 3)     # step lengths at which the slope is taken, 2**-24 to 2**8

KEPT = StorageLevel.MEMORY_AND_DISK_DESER       # the arrays' bytes as they are, which needs no reading

RANGE = "route string, columns int, x binary"
FLAT = "route string, idx int, weight double"


def _floats(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.float64)


def _single(rdd: RDD) -> RDD:
    """One element per batch: such ones meet by position, and a task holds one block at a time."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _each(f: Callable[..., Iterable]) -> Callable[[Iterable], Iterator]:
    """All that ``f`` makes of every element of a partition."""
    return released(lambda items: chain.from_iterable(map(f, items)))


# ----------------------------------------------------------------------------- blocks

def widths(vectors: DataFrame, sizes: dict[str, int]) -> dict[str, int]:
    """Columns of a range per route. The number of ranges grows with the row blocks, slowly, and not with the columns."""
    out = {}
    for r in vectors.groupBy("route").agg(F.count("*").alias("n"), F.sum(F.size("indices").cast("long") + 1).alias("entries")).collect():
        if r["route"] in sizes:
            blocks = max(r["n"] // ROWS, r["entries"] // ENTRIES)
            ranges = min(-(-(sizes[r["route"]] + 1) // COLUMNS), max(RANGES, blocks // CELLS_TOGETHER))
            out[r["route"]] = -(-(sizes[r["route"]] + 1) // ranges)
    return out


class _Block:
    """Rows of a route. ``rows``: its number, the partition in the upper bits; ``y``, ``s``: labels (as -1 and 1) and weights; ``u``: the columns that
    occur, ascending, with the intercept at their end; entries by row: ``lengths`` of the rows, places ``c`` in ``u``, values ``v``; the intercept has no entries.

    In ``_Matrix.by_rows`` also ``at``: places of the columns that other blocks have too, ``ends``: where a column range ends among them."""

    def __init__(self, route: str, rows: int, y: np.ndarray, s: np.ndarray, lengths: np.ndarray, c: np.ndarray, v: np.ndarray, u: np.ndarray) -> None:
        self.route, self.rows, self.y, self.s, self.lengths, self.c, self.v, self.u = route, rows, y, s, lengths, c, v, u

    def ranges(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Column ranges, ascending, and where each starts in ``u``."""
        return np.unique(self.u // width, return_index=True)

    def share(self, masks: dict[int, bytes], width: int) -> _Block:
        self.columns, starts = self.ranges(width)
        sizes = np.diff(np.append(starts, len(self.u)))
        self.at = np.flatnonzero(np.concatenate([np.unpackbits(np.frombuffer(masks[k], np.uint8), count=n) for k, n in zip(self.columns.tolist(), sizes)])).astype(np.int32)
        self.ends = np.searchsorted(self.at, np.append(starts[1:], len(self.u)))
        self.y = self.s = None          # the state has them
        return self

    def down(self, a: np.ndarray) -> np.ndarray:
        x = np.bincount(self.c, self.v * np.repeat(a, self.lengths), len(self.u)).astype(np.float64, copy=False)     # of no entries it is whole numbers
        x[-1] = a.sum()
        return x

    def up(self, p: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(self.lengths)), self.lengths > 0
        if full.any():
            out[full] = np.add.reduceat(self.v * p[self.c], (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[full])
        return out + p[-1]


def blocks(vectors: DataFrame, sizes: dict[str, int], weights: dict[str, tuple[float, float]]) -> RDD:
    """Kept row blocks of (route, label, indices, values). ``sizes``: columns per route, the intercept follows them; ``weights``: per route and class.

    They stay in the partitions in which the vectors are read, unless there are fewer of these than cores."""
    most, entries = ROWS, ENTRIES

    def cut(route: str, number: int, labels: list[int], indices: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        y = np.where(np.array(labels) == 1, 1.0, -1.0)
        s = np.where(y > 0, weights[route][1], weights[route][0])
        u, place = np.unique(np.concatenate(indices).astype(np.int32), return_inverse=True)
        block = _Block(route, number, y, s, np.array([len(i) for i in indices], np.int32), place.astype(np.int32), np.concatenate(values),
                       np.append(u, np.int32(sizes[route])))
        return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block, 5)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_blocks: dict[str, tuple[list, list, list]] = {}
        held: dict[str, int] = {}
        for b in batches:
            indices, values = b.column("indices"), b.column("values")
            for i, (route, label) in enumerate(zip(b.column("route").to_pylist(), b.column("label").to_pylist())):
                block = open_blocks.setdefault(route, ([], [], []))
                block[0].append(label)
                block[1].append(indices[i].values.to_numpy(zero_copy_only=False))
                block[2].append(values[i].values.to_numpy(zero_copy_only=False))
                held[route] = held.get(route, 0) + len(block[1][-1]) + 1
                if len(block[0]) >= most or held[route] >= entries:
                    yield cut(route, number, *open_blocks.pop(route))
                    number, held[route] = number + 1, 0
        for route, block in open_blocks.items():
            yield cut(route, number, *block)
            number += 1

    def renumbered(part: int, found: Iterator[_Block]) -> Iterator[_Block]:
        for i, block in enumerate(sorted(found, key=lambda b: b.rows)):
            block.rows = part << 32 | i
            yield block

    spark = vectors.sparkSession
    chosen = vectors.where(F.col("route").isin(list(sizes))).select(
        "route", "label", "indices", F.col("values").cast("array<double>").alias("values"))
    found = chosen.mapInArrow(released(run), "block binary").rdd.map(lambda r: pickle.loads(r["block"]))
    if found.getNumPartitions() < spark.sparkContext.defaultParallelism:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = found.keyBy(lambda b: (b.rows >> 32) + (b.rows & 0xFFFFFFFF)).partitionBy(parts, lambda k: k).values().mapPartitionsWithIndex(renumbered)
    return _single(found).persist(KEPT)


# ----------------------------------------------------------------------------- products

def _partition(rows: int) -> int:
    return rows >> 32


def _common(rows: Iterable[tuple], widths: dict[str, int]) -> dict[tuple[str, int], list[tuple[int, np.ndarray, bytes]]]:
    """Per column range and block of ((route, columns), (rows, u)): the columns that another block has too, and which of its own they are, as bits."""
    lists: dict[tuple[str, int], list] = {}
    for key, found in rows:
        lists.setdefault(key, []).append(found)
    out = {}
    for key, parts in lists.items():
        times = np.zeros(widths[key[0]], np.int32)
        for _, u in parts:
            times[u] += 1
        out[key] = [(number, u[times[u] > 1], np.packbits(times[u] > 1).tobytes()) for number, u in parts]
    return out


def _gathered(found: Iterator[tuple[int, tuple[int, bytes]]]) -> Iterator[tuple[int, dict[int, bytes]]]:
    """One element per block, in the order of the blocks."""
    out: dict[int, dict[int, bytes]] = {}
    for rows, (k, x) in found:
        out.setdefault(rows, {})[k] = x
    return iter(sorted(out.items(), key=lambda kv: kv[0]))


class _Matrix:
    """X of some routes: blocks of rows, and per column range the columns that blocks share.

    Every block has the intercept's range, so that something is sent and comes back for each, be it empty."""

    def __init__(self, blocks: RDD, widths: dict[str, int]) -> None:
        self.widths, self.parts = widths, blocks.getNumPartitions()
        self.ranges = max(min(self.parts, TASKS), self.parts // 3)         # partitions of column ranges, of which each has some

        def split(block: _Block) -> Iterator[tuple]:
            columns, starts = block.ranges(widths[block.route])
            for k, u in zip(columns.tolist(), np.split(block.u, starts[1:])):
                yield (block.route, k), (block.rows, u - np.int32(k * widths[block.route]))

        def marked(pair: tuple) -> _Block:
            block, (rows, masks) = pair
            assert rows == block.rows
            return block.share(masks, widths[block.route])

        self.by_columns = _single(self._by_range(blocks.mapPartitions(_each(split))).mapPartitions(released(lambda rows: [_common(rows, widths)]))).persist(KEPT)
        masks = self.by_columns.flatMap(lambda found: [(rows, (k, mask)) for (_, k), lists in found.items() for rows, _, mask in lists])
        self.by_rows = _single(blocks.zip(self._by_block(masks)).mapPartitions(released(lambda pairs: map(marked, pairs)))).persist(KEPT)
        self.by_rows.count()            # ``blocks`` are needed no longer

    def _by_range(self, keyed: RDD) -> RDD:
        ranges = self.ranges
        return keyed.partitionBy(ranges, lambda key: (crc32(key[0].encode()) + key[1]) % ranges)

    def _by_block(self, keyed: RDD) -> RDD:
        return _single(keyed.partitionBy(self.parts, _partition).mapPartitions(_gathered))

    def sent(self, a: _Vector) -> RDD:
        """Parts of X'a on shared columns: (route, columns, rows, x)."""
        def run(pair: tuple) -> Iterator[dict]:
            block, held = pair
            x = np.split(block.down(a.of(held, block))[block.at], block.ends[:-1])
            for k, part in zip(block.columns.tolist(), x):
                if len(part) or k == block.columns[-1]:
                    yield {"route": block.route, "columns": k, "rows": block.rows, "x": part.tobytes()}
        return self.by_rows.zip(a.state).mapPartitions(_each(run))

    def added(self, parts: RDD) -> RDD:
        """X'a where blocks share columns: to every block, in the order of its own, (route, columns, rows, x) of the same."""
        widths = self.widths

        def run(pair: tuple) -> Iterator[dict]:
            known, parts = pair
            found: dict[tuple[str, int], dict[int, np.ndarray]] = {}
            for key, (rows, x) in parts:
                found.setdefault(key, {})[rows] = np.frombuffer(x)
            for key, by_rows in found.items():
                places = {rows: u for rows, u, _ in known[key]}
                total = np.zeros(widths[key[0]])
                for rows in sorted(by_rows):
                    total[places[rows]] += by_rows[rows]
                for rows in by_rows:
                    yield {"route": key[0], "columns": key[1], "rows": rows, "x": total[places[rows]].tobytes()}
        keyed = self._by_range(parts.map(lambda r: ((r["route"], r["columns"]), (r["rows"], r["x"]))))
        return self.by_columns.zip(_single(keyed.glom())).mapPartitions(_each(run))

    def received(self, a: _Vector) -> RDD:
        """Per block what X'a is on the columns that it shares: (rows, x per column range)."""
        return self._by_block(self.added(self.sent(a)).map(lambda r: (r["rows"], (r["columns"], r["x"]))))

    def columns_of(self, a: _Vector) -> RDD:
        """X'a on all columns: (route, columns, x); ranges without rows are left out."""
        widths = self.widths

        def whole(pair: tuple) -> Iterator[tuple]:
            block, held = pair
            x, width = block.down(a.of(held, block)), widths[block.route]
            columns, starts = block.ranges(width)
            for k, u, part in zip(columns.tolist(), np.split(block.u, starts[1:]), np.split(x, starts[1:])):
                yield (block.route, k), (block.rows, u - np.int32(k * width), part)

        def add(found: Iterator[tuple]) -> Iterator[dict]:
            lists: dict[tuple[str, int], list] = {}
            for key, part in found:
                lists.setdefault(key, []).append(part)
            for (route, k), parts in lists.items():
                total = np.zeros(widths[route])
                for _, u, x in sorted(parts, key=lambda p: p[0]):
                    total[u] += x
                yield {"route": route, "columns": k, "x": total.tobytes()}
        return self._by_range(self.by_rows.zip(a.state).mapPartitions(_each(whole))).mapPartitions(released(add))

    def only(self, routes: list[str]) -> _Matrix:
        """The same for fewer routes; this one is still to be released."""
        out = object.__new__(_Matrix)
        out.widths, out.parts, out.ranges, out.by_columns = self.widths, self.parts, self.ranges, self.by_columns
        out.by_rows = _single(self.by_rows.filter(lambda b: b.route in routes))
        return out

    def release(self) -> None:
        self.by_rows.unpersist()
        self.by_columns.unpersist()


# ----------------------------------------------------------------------------- state of the rows

class _Rows:
    """One row block: labels, weights, and pairs (a, Xp) of the iterate, the gradient and the past differences; ``dots``: loss and inner products."""

    def __init__(self, route: str, rows: int, y: np.ndarray, s: np.ndarray) -> None:
        self.route, self.rows, self.y, self.s, self.dots = route, rows, y, s, np.zeros(0)
        self.w, self.g, self.past = np.zeros((2, len(y))), np.zeros((2, len(y))), np.zeros((0, 2, len(y)))

    def direction(self, parts: np.ndarray) -> np.ndarray:
        return np.tensordot(parts, np.concatenate([self.past, self.g[None]]), 1)

    def stepped(self, parts: np.ndarray | None, step: float) -> np.ndarray:
        """Moves the iterate and returns the gradient's ``a`` there: the gradient is X'a."""
        if parts is not None:
            self.d = step * self.direction(parts)
            self.w = self.w + self.d
        with np.errstate(over="ignore"):
            return self.w[0] - self.s * self.y / (1 + np.exp(self.y * self.w[1]))

    def received(self, a: np.ndarray, product: np.ndarray, first: bool, history: int) -> None:
        """Takes the new gradient's pair, and makes loss and inner products of the newest vectors."""
        g = np.stack([a, product])
        if not first:
            self.past = np.concatenate([self.past, self.d[None], (g - self.g)[None]])[-2 * history:]
        self.g, self.d = g, None
        base = np.concatenate([self.past, self.g[None], self.w[None]])
        new = base[-4:] if not first else base[-2:]
        products = new[:, 0] @ base[:, 1].T         # p.q = a_p . Xq
        loss = float((self.s * np.logaddexp(0, -self.y * self.w[1])).sum())
        self.dots = np.concatenate([[loss], products.ravel()])

    def slopes(self, parts: np.ndarray) -> np.ndarray:
        """Derivative of the loss along the direction at all step lengths."""
        v = self.direction(parts)[1]
        out = np.zeros(len(STEPS))
        for j, t in enumerate(STEPS):
            with np.errstate(over="ignore"):
                out[j] = (-self.s * self.y * v / (1 + np.exp(self.y * (self.w[1] + t * v)))).sum()
        return out


Plan = dict[str, tuple[np.ndarray | None, float]]       # per route: parts of the direction, step


def _start(blocks: RDD) -> RDD:
    return _single(blocks.map(lambda b: _Rows(b.route, b.rows, b.y, b.s))).persist(KEPT)


class _Vector:
    """One number per row, taken from the state of a block where it is needed."""

    def __init__(self, state: RDD, number: Callable[[_Rows], np.ndarray]) -> None:
        self.state, self.number = state, number

    def __getstate__(self) -> dict:
        return {"number": self.number}          # what tasks need

    def of(self, held: _Rows, block: _Block) -> np.ndarray:
        assert held.rows == block.rows
        return self.number(held)


def _gradients(state: RDD, plan: Plan) -> _Vector:
    """``a`` of the gradient after the step."""
    return _Vector(state, lambda held: held.stepped(*plan[held.route]))


def _advance(state: RDD, matrix: _Matrix, plan: Plan) -> RDD:
    """The state after the step, with the new gradient and its inner products."""
    history, a = HISTORY, _gradients(state, plan)

    def merge(triple: tuple) -> _Rows:
        (block, held), (rows, x) = triple
        assert rows == block.rows
        new = a.of(held, block)
        p = block.down(new)
        if len(block.at):
            p[block.at] = np.concatenate([np.frombuffer(x[k]) for k in block.columns.tolist() if k in x])
        held.received(new, block.up(p), plan[held.route][0] is None, history)
        return held
    return _single(matrix.by_rows.zip(state).zip(matrix.received(a)).mapPartitions(released(lambda found: map(merge, found)))).persist(KEPT)


def _summed(values: RDD) -> dict[str, np.ndarray]:
    """Per route the sums of (route, array): one array per partition and route comes to the driver, of some hundred places at most."""
    def add(found: Iterable[tuple[str, np.ndarray]]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for route, x in found:
            out[route] = out[route] + x if route in out else x
        return out
    return add(values.mapPartitions(lambda found: add(found).items()).collect())


def _dots(state: RDD) -> dict[str, np.ndarray]:
    return _summed(state.map(lambda block: (block.route, block.dots)))


def _slopes(state: RDD, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return _summed(state.map(lambda block: (block.route, block.slopes(parts[block.route]))))


# ----------------------------------------------------------------------------- the driver's part

class _Search:
    """L-BFGS on inner products: base vectors are the past differences (s, y, s, y, ...), the gradient and the iterate."""

    def __init__(self) -> None:
        self.gram = np.zeros((0, 0))
        self.loss = np.inf
        self.done = False
        self.iterations = 0

    def learn(self, sums: np.ndarray, tol: float) -> None:
        """Inner products of the newest vectors with all base vectors, and the loss."""
        first = not len(self.gram)
        new = 2 if first else 4
        size = (len(sums) - 1) // new
        gram = np.zeros((size, size))
        if not first:
            kept = size - 4
            old = self.gram[:-2, :-2][-kept:, -kept:] if kept else np.zeros((0, 0))
            gram[:kept, :kept] = old
        gram[-new:] = sums[1:].reshape(new, size)
        gram[:, -new:] = gram[-new:].T
        self.gram = gram
        loss = float(sums[0] + gram[-1, -1] / 2)
        self.done = self.loss - loss <= tol * max(abs(loss), 1e-12)
        self.loss = loss
        self.iterations += not first

    def direction(self) -> np.ndarray:
        """Parts of the past differences and of the gradient."""
        gram = self.gram[:-1, :-1]
        k = len(gram) // 2
        q = np.zeros(len(gram))
        q[-1] = 1.0
        alphas = np.zeros(k)
        usable = [j for j in range(k) if gram[2 * j, 2 * j + 1] > 0]
        for j in reversed(usable):
            alphas[j] = (gram[2 * j] @ q) / gram[2 * j, 2 * j + 1]
            q[2 * j + 1] -= alphas[j]
        if usable:
            j = usable[-1]
            q *= gram[2 * j, 2 * j + 1] / gram[2 * j + 1, 2 * j + 1]
        for j in usable:
            q[2 * j] += alphas[j] - (gram[2 * j + 1] @ q) / gram[2 * j, 2 * j + 1]
        return -q

    def step(self, parts: np.ndarray, slopes: np.ndarray) -> float:
        """Where the slope changes its sign, between two of the step lengths; 0 if it does not go down at all."""
        wide = np.append(parts, 0.0)
        along, square = float(self.gram[-1] @ wide), float(wide @ self.gram @ wide)
        total = slopes + along + STEPS * square
        if total[0] >= 0:
            return 0.0
        if total[-1] < 0:
            return float(STEPS[-1])
        j = int(np.argmax(total >= 0))
        share = -total[j - 1] / (total[j] - total[j - 1])
        return float(STEPS[j - 1] + share * (STEPS[j] - STEPS[j - 1]))


def fit(vectors: DataFrame, sizes: dict[str, int], counts: dict[str, tuple[int, int]], strength: dict[str, float], max_iter: int,
        tol: float) -> tuple[DataFrame, dict[str, float], dict[str, int]]:
    """((route, idx, weight) staged, intercepts, iterations) of one regression per route, all in the same jobs.

    ``vectors``: (route, label, indices, values); ``sizes``: columns per route; ``counts``: rows of class 0 and 1;
    ``strength``: C. Stops when the loss falls by less than ``tol`` of itself.
    """
    weights = {}
    for route, (n0, n1) in counts.items():
        if not (n0 and n1):
            raise ValueError(f"route {route!r} has rows of one class only")
        n, c = n0 + n1, strength.get(route, 1.0)
        weights[route] = (c * n / (2 * n0), c * n / (2 * n1))
    _checkpoints(vectors.sparkSession)
    columns = {r: sizes[r] for r in counts}
    table = blocks(vectors, columns, weights)
    state, matrix = _start(table), _Matrix(table, widths(vectors, columns))
    kept = [matrix.by_rows, matrix.by_columns]
    state.count()
    table.unpersist()
    try:
        searches = {r: _Search() for r in counts}
        plan: Plan = {r: (None, 0.0) for r in counts}
        settled: list[DataFrame] = []
        open_routes = list(counts)
        for i in range(max_iter + 1):
            before, state = state, _advance(state, matrix, plan)
            if i % CHECKPOINT == CHECKPOINT - 1:
                state.checkpoint()
            sums = _dots(state)
            before.unpersist()
            del before
            if i % CHECKPOINT == CHECKPOINT - 1:
                state = RDD(state._jrdd, state.ctx, state._jrdd_deserializer)       # without the steps before
                _forget(vectors.sparkSession)
            for r in open_routes:
                searches[r].learn(sums[r], tol)
            going = [r for r in open_routes if not searches[r].done and i < max_iter]
            parts = {r: searches[r].direction() for r in going}
            slopes = _slopes(_of_routes(state, going), parts) if going else {}
            plan = {r: (parts[r], searches[r].step(parts[r], slopes[r])) for r in going}
            going = [r for r in going if plan[r][1] > 0]
            if ended := [r for r in open_routes if r not in going]:
                iterates = _Vector(_of_routes(state, ended), lambda held: held.w[0])
                found = matrix.only(ended).columns_of(iterates).map(lambda r: (r["route"], r["columns"], r["x"]))
                settled.append(stage(vectors.sparkSession.createDataFrame(found, RANGE, verifySchema=False), "ranges"))
                if going:
                    kept.append(state)
                    state, matrix = _of_routes(state, going), matrix.only(going)
                    state.persist(KEPT)
                    kept.append(matrix.by_rows.persist(KEPT))
                    open_routes = going
            if not going:
                break
        ranges = _ranges(vectors, sizes, matrix.widths)
        last = reduce(DataFrame.unionByName, settled)
        found = stage(_flat(ranges.join(last, ["route", "columns"], "left"), sizes, matrix.widths), "coefficients")
    finally:
        for rdd in [*kept, state]:
            rdd.unpersist()
    ends = {r["route"]: r["weight"] for r in found.where("idx < 0").collect()}       # one row per route
    return found.where("idx >= 0"), {r: ends[r] for r in counts}, {r: s.iterations for r, s in searches.items()}


def _checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(staging_root(spark))


def _forget(spark: SparkSession) -> None:
    """Shuffle files of steps before a checkpoint go when the driver collects its garbage, which may be never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _of_routes(state: RDD, routes: list[str]) -> RDD:
    return _single(state.filter(lambda block: block.route in routes))


def _ranges(any_frame: DataFrame, sizes: dict[str, int], widths: dict[str, int]) -> DataFrame:
    """(route, columns) of all column ranges: one that no row has is zero."""
    last = [(r, sizes[r] // w) for r, w in widths.items()]
    return any_frame.sparkSession.createDataFrame(last, "route string, last int").select(
        "route", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("columns"))


def _flat(ranges: DataFrame, sizes: dict[str, int], widths: dict[str, int]) -> DataFrame:
    """(route, idx, weight) of all columns; the intercept has idx -1."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                route, first = b.column("route")[i].as_py(), b.column("columns")[i].as_py()
                width = widths[route]
                first *= width
                x = (_floats(b.column("x")[i]) if b.column("x")[i].is_valid else np.zeros(width))[:sizes[route] + 1 - first]
                idx = np.arange(first, first + len(x))
                idx[idx == sizes[route]] = -1
                yield pa.RecordBatch.from_pydict({"route": [route] * len(x), "idx": pa.array(idx, pa.int32()), "weight": x})
    return ranges.mapInArrow(released(run), FLAT)
