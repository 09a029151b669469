"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with itself.

1. Every document becomes the set of hashes of its word n-grams. Equal sets are one class.
2. N-grams in very many classes are found by counting; they come last in the global order, all others by
   hash. Of every class only a prefix of its set in that order is looked at: two sets that link share at
   least as many prefix entries as their sizes demand.
3. Overlap counts of the prefixes are accumulated from the shared n-grams; pairs below their bound go.
   Classes that consist of very common n-grams are tied to one another per n-gram instead.
4. The groups so connected are blocks. In each the product over the full sets gives exact overlaps, from
   the postings of the n-grams, and the links. Blocks of many classes are cut into parts: every part
   against itself and the first, then whatever is not in the block's main component against all parts.
5. Components of the links.

Two classes that link are in one block whatever n-grams were taken as common: that choice only saves work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from credence.llm.common import rows_of, schema, small_batches
from credence.llm.components import components
from credence.session import stage

WORDS = 4
THRESHOLD = (85, 100)
COMMON = 40                  # classes; n-grams in more are common
MAX_COMMON = 500_000         # common n-grams that go to the tasks; the most frequent ones if there are more
LONG_LIST = 256              # a longer list of an n-gram's classes makes it common in another round
WINDOW = 2_000_000           # n-grams that a task counts at a time
PART_CLASSES = 1_500         # of a block in one task, about
PART_ENTRIES = 4_000_000
BROADCAST_ROWS = 200_000     # classes (of six numbers) up to which their texts are picked by a broadcast
SLICE = 1 << 20              # bytes of a text hashed at a time

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_END = np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _END
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_SPACE[b]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _ODD, dtype=np.uint64))
    return _mix(np.add.reduceat(_BYTE[b[at]] * powers[place], first) + lengths.astype(np.uint64) * _END)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash per word ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; long texts in slices that end between words."""
    parts, start = [], 0
    raw = raw.lower()
    while start < len(raw):
        end = min(start + SLICE, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        parts.append(_word_hashes(raw[start:end]))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(raw: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of fewer words, but not none, the whole sequence is one."""
    w = word_hashes(raw or b"")
    m = min(n, len(w))
    if not m:
        return w
    h = np.full(len(w) - m + 1, np.uint64(m), dtype=np.uint64)
    for i in range(m):
        h = _mix(h * _ODD + w[i:len(w) - m + 1 + i])
    return np.unique(h)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two longs."""
    a = int(_mix(s + _ODD).sum(dtype=np.uint64))
    b = int(_mix((s ^ _END) * _ODD).sum(dtype=np.uint64))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def least_overlap(a: int | np.ndarray, b: int | np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> int | np.ndarray:
    """Least intersection of sets of these sizes that link: num * union <= den * intersection."""
    num, den = threshold
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    num, den = threshold
    return n + (-num * n // den) + 1


def links(sets: list[np.ndarray], ask: np.ndarray | None = None, threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int]]:
    """Enough links between ``sets`` to connect all that any links connect, of those with an end in ``ask`` (None: all).

    Overlaps of one set with all others are counted from the lists of its n-grams. Sets already connected
    with the first one asked need no count of their own: each of their links to anything outside is found
    from the other end.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n < 2:
        return []
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = seen[token] > 1
    token, owner = token[shared], owner[shared]
    by_token = np.argsort(token, kind="stable")
    lists = owner[by_token]
    counts = np.bincount(token, minlength=len(seen))
    list_starts = np.cumsum(counts) - counts
    own_starts = np.searchsorted(owner, np.arange(n + 1))
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    weight = np.add.reduceat(np.append(counts[token], 0), np.minimum(own_starts[:-1], len(token))) * (own_starts[1:] > own_starts[:-1])
    rows = np.flatnonzero(ask) if ask is not None else np.arange(n)
    out: list[tuple[int, int]] = []
    pivot = None
    num, den = threshold
    for i in rows[np.argsort(-weight[rows], kind="stable")].tolist():
        if ask is None:
            if pivot is None:
                pivot = i
            elif root(i) == root(pivot):
                continue
        mine = token[own_starts[i]:own_starts[i + 1]]
        if not len(mine):
            continue
        c, s = counts[mine], list_starts[mine]
        flat = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(s, c)
        overlap = np.bincount(lists[flat], minlength=n)
        overlap[i] = 0
        for j in np.flatnonzero(den * overlap >= num * (sizes[i] + sizes - overlap)).tolist():
            if overlap[j] and root(i) != root(j):
                parent[root(i)] = root(j)
                out.append((i, j))
    return out


SETS = "k {kind}, th bigint, n bigint, s1 bigint, s2 bigint, token bigint, seen bigint"


def _typed(ddl: str):
    return to_arrow_schema(schema(ddl))


def _batches(df: DataFrame, rows, ddl: str, size: int = 1024) -> DataFrame:
    """``mapInArrow`` over (k, th, t) rows whose texts arrive as bytes."""
    small_batches(df)
    to = _typed(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for row in rows(rows_of(batches)):
            done.append(row)
            if len(done) == size:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), to)], schema=to)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), to)], schema=to)
    return df.mapInArrow(run, schema(ddl))


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t"))


def document_sets(texts: DataFrame, kind: str, n_words: int) -> DataFrame:
    """Staged: a row per document with its set's size and signature, and counts of n-grams that repeat within a task's window."""
    def rows(source: Iterable[tuple]) -> Iterator[tuple]:
        waiting: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def flush() -> Iterator[tuple]:
            tokens, counts = np.unique(np.concatenate(waiting), return_counts=True)
            for t, c in zip(tokens[counts > 2].view(np.int64).tolist(), counts[counts > 2].tolist()):
                yield None, None, None, None, None, t, c

        for k, th, raw in source:
            s = shingles(raw, n_words)
            sig = signature(s)
            yield k, th, len(s), *sig, None, None
            if len(s) and sig not in seen:
                seen.add(sig)
                waiting.append(s)
                size += len(s)
                if size > WINDOW:
                    yield from flush()
                    waiting, size = [], 0
                    seen.clear()
        if waiting:
            yield from flush()

    return stage(_batches(texts, rows, SETS.format(kind=kind)), "sets")


def common_tokens(counts: DataFrame, most: int = MAX_COMMON, above: int = COMMON) -> np.ndarray:
    """The most frequent n-grams of (token, seen) that were seen more than ``above`` times, ``most`` at most, sorted."""
    sums = stage(counts.groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") > above), "frequent")
    bands = sorted(((r["b"], r["c"]) for r in sums.groupBy(F.floor(F.log2("seen") * 4).alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for band, c in bands:
        if total + c > most:
            break
        total, least = total + c, band
    if least is None:
        return np.empty(0, np.int64)
    chosen = sums.where(F.floor(F.log2("seen") * 4) >= least).select("token")
    return np.sort(chosen.toArrow()["token"].to_numpy())


POSTING = "s1 bigint, n bigint, cold array<bigint>, hot array<bigint>"


def prefixes(picked: DataFrame, common: np.ndarray, n_words: int, threshold: tuple[int, int]) -> DataFrame:
    """Staged (token, s1, n, hot): prefix entries that more than one class has."""
    spark = picked.sparkSession
    shared = spark.sparkContext.broadcast(common)       # MAX_COMMON numbers and a list's worth at most

    def rows(source: Iterable[tuple]) -> Iterator[tuple]:
        hot_tokens = np.append(np.sort(shared.value.view(np.uint64)), np.uint64(0))     # the last is beyond the end
        for _, _, raw in source:
            s = shingles(raw, n_words)
            if not len(s):
                continue
            p = prefix_length(len(s), threshold)
            at = np.searchsorted(hot_tokens[:-1], s)
            hot = (hot_tokens[at] == s) & (at < len(hot_tokens) - 1)
            cold = s[~hot][:p]
            yield signature(s)[0], len(s), cold.view(np.int64).tolist(), s[hot][:p - len(cold)].view(np.int64).tolist()

    lists = _batches(picked, rows, POSTING, 256)
    entries = F.concat(F.transform("cold", lambda t: F.struct(t.alias("token"), F.lit(False).alias("hot"))),
                       F.transform("hot", lambda t: F.struct(t.alias("token"), F.lit(True).alias("hot"))))
    flat = lists.select("s1", "n", (F.size("hot") > 0).alias("mixed"), F.explode(entries).alias("e")).select("e.token", "s1", "n", "mixed", "e.hot")
    by_token = flat.repartition("token").dropDuplicates(["token", "s1"])
    lists_of_two = by_token.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    return stage(by_token.join(lists_of_two, "token"), "postings")


def candidate_edges(postings: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): pairs whose prefixes overlap as much as their sizes demand, and ties between classes of common n-grams."""
    num, den = threshold
    cold = postings.where(~F.col("hot"))
    a = cold.select("token", F.col("s1").alias("a"), F.col("n").alias("na"), F.col("mixed").alias("ma"))
    b = cold.select("token", F.col("s1").alias("b"), F.col("n").alias("nb"), F.col("mixed").alias("mb"))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    pairs = a.join(b, "token").where(near).groupBy("a", "b", "na", "nb", (F.col("ma") & F.col("mb")).alias("both")).agg(F.count("*").alias("c"))

    def prefix(n: str) -> Column:
        return F.col(n) - F.floor((F.col(n) * num + den - 1) / den) + 1

    t = F.floor(((F.col("na") + F.col("nb")) * num + (num + den - 1)) / (num + den))
    bound = F.least(t - F.col("na") + prefix("na"), t - F.col("nb") + prefix("nb"))
    kept = pairs.where(F.col("both") | (F.col("c") >= bound)).select("a", "b")
    hot = postings.where("hot")
    centre = hot.groupBy("token").agg(F.min("s1").alias("a"))
    ties = hot.join(centre, "token").where("a <> s1").select("a", F.col("s1").alias("b"))
    return kept.union(ties)


def block_edges(members: DataFrame, threshold: tuple[int, int], ask_only: bool) -> DataFrame:
    """(a, b) links between the classes of each (block, part, other); one task may have many, one after another."""
    small_batches(members)
    to = _typed("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, ask = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            found = links(sets, np.array(ask) if ask_only else None, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], schema=to)

        seen: dict[tuple[int, int], int] = {}
        for block, part, other, s1, s2, raw, asked in rows_of(batches):
            if (block, part, other) != now:
                yield from close()
                now, ids, sets, ask = (block, part, other), [], [], []
                seen.clear()
            if (s1, s2) in seen:
                ask[seen[s1, s2]] |= asked
                continue
            seen[s1, s2] = len(ids)
            ids.append(s1)
            sets.append(np.frombuffer(raw, dtype=np.uint64))
            ask.append(asked)
        yield from close()

    keys = ["block", "part", "other"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema("a bigint, b bigint"))


def full_sets(texts: DataFrame, chosen: DataFrame, n_words: int) -> DataFrame:
    """Staged (chosen's block, s1, s2, set): the sets of the chosen classes, from one document of each."""
    small = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = chosen.select(F.col("k").alias("ck"), F.col("th").alias("cth"), "block", "s1", "s2")
    right = F.broadcast(right) if small else right
    picked = texts.join(right, (F.col("k").eqNullSafe(F.col("ck"))) & (F.col("th") == F.col("cth"))).select("block", "s1", "s2", "t")
    ddl = "block bigint, s1 bigint, s2 bigint, set binary"

    def rows(source: Iterable[tuple]) -> Iterator[tuple]:
        for block, s1, s2, raw in source:
            s = shingles(raw, n_words)
            if signature(s) == (s1, s2):
                yield block, s1, s2, s.tobytes()

    return stage(_batches(picked, rows, ddl, 256), "full-sets")


def linked_classes(texts: DataFrame, classes: DataFrame, counts: DataFrame, n_words: int, threshold: tuple[int, int],
                   common: int, part_classes: int) -> DataFrame:
    """(node, component) of the classes that link with another; nodes are first halves of signatures."""
    reps = classes.where("n > 0").select(F.col("k").alias("ck"), F.col("th").alias("cth"))
    picked = texts.join(reps, (F.col("k").eqNullSafe(F.col("ck"))) & (F.col("th") == F.col("cth")), "left_semi")
    tokens = common_tokens(counts, MAX_COMMON, common)
    while True:
        postings = prefixes(picked, tokens, n_words, threshold)
        long_lists = postings.where(~F.col("hot") & (F.col("c") > max(LONG_LIST, common))).select("token", F.col("c").alias("seen")).distinct()
        if len(tokens) >= MAX_COMMON:
            break
        more = np.setdiff1d(common_tokens(long_lists, MAX_COMMON - len(tokens), 0), tokens)
        if not len(more):
            break
        tokens = np.sort(np.concatenate([tokens, more]))

    blocks = stage(components(candidate_edges(postings, threshold)).select(F.col("node").alias("s1"), F.col("component").alias("block")), "blocks")
    chosen = classes.where("n > 0").join(blocks, "s1")
    sets = full_sets(texts, chosen, n_words)
    sizes = sets.groupBy("block").agg(F.count("*").alias("c"), F.sum(F.octet_length("set") / 8).alias("e"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("c") / part_classes), F.ceil(F.col("e") / PART_ENTRIES)).cast("int")
    sizes = stage(sizes.where("c > 1").select("block", parts.alias("m")), "block-sizes")
    dealt = sets.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("s1", "s2"), F.col("m")).cast("int"))

    # Every part with itself and with part 0, whose classes go to all of them.
    others = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array("part"))
    first = dealt.select("block", F.lit(0).alias("part"), F.explode(others).alias("other"), "s1", "s2", "set", F.lit(True).alias("ask"))
    edges = stage(block_edges(first, threshold, False), "links")

    # In blocks of several parts, what is outside the main component, in chunks, with every part.
    large = dealt.where("m > 1")
    if not large.limit(1).count():
        return components(edges)
    found = components(edges)
    placed = large.join(found.withColumnRenamed("node", "s1"), "s1", "left").withColumn("component", F.coalesce("component", "s1"))
    largest = placed.groupBy("block", "component").agg(F.count("*").alias("size")).groupBy("block").agg(
        F.max(F.struct("size", "component"))["component"].alias("main"))
    outside = stage(placed.join(largest, "block").where("component <> main").select("block", "s1", "s2", "set", "m"), "outside")
    chunks = outside.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / part_classes, F.sum(F.octet_length("set") / 8) / PART_ENTRIES)).cast("int").alias("u"))
    chunks = stage(chunks, "chunks")
    asking = outside.join(chunks, "block").select(
        "block", F.pmod(F.xxhash64("s2", "s1"), F.col("u")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"),
        "s1", "s2", "set", F.lit(True).alias("ask"))
    asked = large.join(chunks, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("u") - 1)).alias("part"), F.col("part").alias("other"), "s1", "s2", "set", F.lit(False).alias("ask"))
    more = block_edges(asking.union(asked), threshold, True)
    return components(edges.union(more))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = WORDS, threshold: tuple[int, int] = THRESHOLD,
         common: int = COMMON, part_classes: int = PART_CLASSES) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (the least key of its component), keep, text_hash.

    Sets link when num * union <= den * intersection. ``keep`` marks the documents with the least (key, text
    hash) of their component, null keys last: one document, or several equal ones. A null text or one without
    words has the empty set, links with nothing and is its own component. Null keys take part and are passed
    over when the least key is chosen; rows that repeat a key are documents of their own, equal in the result if
    their texts are. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = texts_of(docs, key, text)
    sets = document_sets(texts, kind, n_words)
    rows = sets.where("s1 IS NOT NULL")
    order = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("th").alias("th"))
    classes = stage(rows.where("n > 0").groupBy("s1", "s2").agg(F.min(order).alias("o"), F.first("n").alias("n"))
                    .select("s1", "s2", "n", F.col("o.k").alias("k"), F.col("o.th").alias("th")), "classes")
    counts = sets.where("token IS NOT NULL").select("token", "seen")
    found = linked_classes(texts, classes, counts, n_words, threshold, common, part_classes)
    placed = classes.join(found.withColumnRenamed("node", "s1"), "s1", "left").select(
        "s1", "s2", "k", "th", "component")
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("o"))
    heads = placed.join(least, "component", "left").select(
        "s1", "s2", F.coalesce("o", order).alias("o"))
    out = rows.where("n > 0").join(heads, ["s1", "s2"]).select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("o.k").alias("component_id"),
        (F.col("k").eqNullSafe(F.col("o.k")) & (F.col("th") == F.col("o.th"))).alias("keep"), F.col("th").alias("text_hash"))
    empty = rows.where("n = 0").select(F.col("k").alias(key), F.lit(0).cast("bigint").alias("n_shingles"), F.col("k").alias("component_id"),
                                       F.lit(True).alias("keep"), F.col("th").alias("text_hash"))
    return out.union(empty)
