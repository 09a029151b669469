"""A Merkle manifest of a table as an append log in postorder, and proofs read from it.

Every row is a leaf. Per tree (language) the leaves are numbered; while several nodes remain, every eight
consecutive ones become their parent. Builders take aligned blocks of 8**3 leaves and append nodes as they are
completed: a leaf, and a parent at once after the last of its children. In such a log the node with number ``i`` of
level ``l`` stands at ``sum(e // 8**j) + l`` over all j >= 0, where e is its last leaf: so many nodes are complete
before it. That holds for whole and for cut-off trees alike, so siblings are addressed without an index.
The roots of the blocks are the leaves of the next round, until one node of each tree remains; these are
the leaves of a tree of their own.

Proofs go the other way: a round's segments of the log are joined with what lies above each block and read by position.
A task holds one block or one segment at a time, a few hundred nodes. Texts are hashed where they are read;
only digests are shuffled.

Defined cases: null fields are ``-`` in a leaf, null ids come first, rows with equal ids follow their digests, and
repeated rows are leaves of their own. A tree of one leaf is that leaf and its proof is empty. Columns other than
doc_id, source, lang, n_chars and text have no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import crc32_mod, small_batches
from credence.session import stage

ARITY = 8
LEVELS = 3                  # that a builder completes: 512 leaves and 585 nodes
DIGEST = 64                 # characters
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"
SEGMENT = "tree string, block long, leaves int, height int, nodes array<string>, ids array<long>, others array<string>"
ALL = "all"                 # name of the tree over the trees


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height_of(leaves: int) -> int:
    """Levels above the leaves: none for a single leaf."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // ARITY), h + 1
    return h


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree of ``leaves``, from 0."""
    last = min((index + 1) * ARITY ** level, leaves) - 1
    place = level
    while last:
        place, last = place + last, last // ARITY
    return place


def postorder(leaves: list[str], height: int) -> list[str]:
    """The nodes of a tree of ``height`` levels above its leaves, in the order in which they are completed."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(height + 1)]

    def add(level: int, node: str) -> None:
        log.append(node)
        if level < height:
            runs[level].append(node)
            if len(runs[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        node, runs[level] = digest("".join(runs[level])), []
        add(level + 1, node)

    for leaf in leaves:
        add(0, leaf)
    for level in range(height):
        if runs[level]:
            close(level)
    return log


def proofs(log: list[str], leaves: int, height: int) -> Iterator[list[tuple[str, str]]]:
    """Per leaf the siblings on its left and right, joined, level by level."""
    runs = []           # per level: the digests of each run
    for level in range(height):
        nodes = [log[position(level, i, leaves)] for i in range(-(-leaves // ARITY ** level))]
        runs.append(["".join(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)])
    for leaf in range(leaves):
        path = []
        for level in range(height):
            index = leaf // ARITY ** level
            run, at = runs[level][index // ARITY], index % ARITY * DIGEST
            path.append((run[:at], run[at + DIGEST:]))
        yield path


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


# ----------------------------------------------------------------------------- leaves

def _encoded(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row, with another text if one is given."""
    values = [F.col(f) if f != "text" or text is None else text for f in FIELDS]
    return F.sha2(F.concat(*[_encoded(v) for v in values]), 256)


def tree_of(lang: Column | str) -> Column:
    """Name of a language's tree; the order of the names is null first, then that of the bytes."""
    c = F.col(lang) if isinstance(lang, str) else lang
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0, within the tree) and ``n`` (leaves of the tree).

    Leaves are range-partitioned, numbered in their part and shifted by the counts of earlier parts.
    """
    parts = stage(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "leaves-sorted")
    tree = Window.partitionBy("tree")                                    # one row per tree and part
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("tree", "part").agg(F.count("*").alias("c")).select(
        "tree", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"), F.sum("c").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    return parts.withColumn("inside", inside).join(counts, ["tree", "part"]).withColumn(
        "place", F.col("off") + F.col("inside") - 1).drop("part", "off", "inside", *[c for c in order if c != "id"])


# ----------------------------------------------------------------------------- log

def _build(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    n = rows.column("n")[0].as_py()
    height = min(LEVELS, height_of(n))
    nodes = postorder(rows.column("digest").to_pylist(), height)
    return pa.table({
        "tree": [key[0].as_py()], "block": [key[1].as_py()], "leaves": pa.array([rows.num_rows], pa.int32()),
        "height": pa.array([height], pa.int32()), "nodes": pa.array([nodes], pa.list_(pa.string())),
        "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
        "others": pa.array([rows.column("other").to_pylist()], pa.list_(pa.string()))})


def segments(leaves: DataFrame, name: str) -> DataFrame:
    """Staged segments of the log, one row per aligned block of (tree, place, n, digest, id, other)."""
    block = F.floor(F.col("place") / ARITY ** LEVELS).cast("long")
    built = leaves.select("tree", block.alias("block"), "place", "n", "digest", "id", "other").groupBy("tree", "block").applyInArrow(_build, SEGMENT)
    return stage(built, name)


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(segments of every round, roots (tree, digest)) of numbered leaves."""
    rounds, roots = [], []
    most = leaves.agg(F.max("n").alias("m")).first()["m"] or 0
    now = leaves
    while True:
        rounds.append(segments(now, f"log-{len(rounds)}"))
        tops = rounds[-1].select("tree", F.col("block").alias("place"), F.element_at("nodes", -1).alias("digest"))
        count = tops.groupBy("tree").agg(F.count("*").alias("n"))
        sized = tops.join(count, "tree")
        roots.append(sized.where("n = 1").select("tree", "digest"))
        if most <= ARITY ** LEVELS:
            break
        most = -(-most // ARITY ** LEVELS)
        now = sized.where("n > 1").select("tree", "place", "n", "digest", F.col("place").alias("id"), F.lit(None).cast("string").alias("other"))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return rounds, out


def log(rounds: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """(tree, position, level, index, digest) of every node; ``sizes``: (tree, n) leaves of each tree."""
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                base, first = s["round"] * LEVELS, 1 if s["round"] else 0     # a later round's leaves are an earlier one's roots
                for level in range(first, s["height"] + 1):
                    width = ARITY ** (LEVELS - level)
                    index = [s["block"] * width + i for i in range(-(-s["leaves"] // ARITY ** level))]
                    yield pa.RecordBatch.from_pydict({
                        "tree": [s["tree"]] * len(index), "position": [position(base + level, i, s["n"]) for i in index],
                        "level": pa.array([base + level] * len(index), pa.int32()), "index": index,
                        "digest": [s["nodes"][position(level, i - s["block"] * width, s["leaves"])] for i in index]})
    parts = [r.select("tree", "block", "leaves", "height", "nodes", F.lit(k).alias("round")) for k, r in enumerate(rounds)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    small_batches(rows)
    return rows.join(sizes, "tree").mapInArrow(nodes, "tree string, position long, level int, index long, digest string")


# ----------------------------------------------------------------------------- proofs

def _segments_with(seg: DataFrame, above: DataFrame) -> DataFrame:
    small_batches(seg)
    return seg.join(above, ["tree", "block"])


def _tops(s: dict) -> list[str]:
    """Roots above a segment's leaves: that of its own tree, if the segment holds it, and those of the trees above."""
    return ([s["nodes"][-1]] if s["whole"] else []) + s["tops"]


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for b in batches:
        for i in range(b.num_rows):
            s = b.slice(i, 1).to_pylist()[0]
            paths = [[{"left": x, "right": y} for x, y in p] + s["path"] for p in proofs(s["nodes"], s["leaves"], s["height"])]
            yield pa.RecordBatch.from_pydict({
                "tree": [s["tree"]] * len(paths), "block": pa.array(s["ids"], pa.int64()), "whole": [False] * len(paths),
                "path": pa.array(paths, kind), "tops": pa.array([_tops(s)] * len(paths), pa.list_(pa.string())),
                "other": pa.array(s["others"], pa.string())})


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            s = b.slice(i, 1).to_pylist()[0]
            upper = [(p["left"], p["right"]) for p in s["path"]]
            subroot, root = _tops(s)
            out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "proof_sha256", "folded_root")}
            for k, path in enumerate(proofs(s["nodes"], s["leaves"], s["height"])):
                path += upper
                node = s["nodes"][position(0, k, s["leaves"])]
                out["doc_id"].append(s["ids"][k])
                out["leaf"].append(node)
                out["proof_sha256"].append(digest("".join([x + y for x, y in path])))
                out["folded_root"].append(fold(node if s["others"][k] is None else s["others"][k], path))
            n = len(out["leaf"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(out["doc_id"], pa.int64()), "leaf": out["leaf"], "subroot": [subroot] * n, "root": [root] * n,
                "proof_sha256": out["proof_sha256"], "folded_root": out["folded_root"],
                "verified": [f == root for f in out["folded_root"]]})


UPPER = f"tree string, block long, whole boolean, path {PATH}, tops array<string>, other string"


def above(rounds: list[DataFrame], trees: DataFrame, last: int) -> DataFrame:
    """What lies above each block of round ``last``: (tree, block, whole, path, tops).

    ``trees`` says so for whole trees, (tree, path, tops); a tree takes part from the round in which it is one block.
    """
    found = None
    for k in range(len(rounds) - 1, last - 1, -1):
        blocks = rounds[k].groupBy("tree").agg(F.count("*").alias("n"))
        here = blocks.where("n = 1").join(trees, "tree").select("tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), "path", "tops")
        found = here if found is None else here.unionByName(found)
        if k > last:
            found = stage(_segments_with(rounds[k], found).mapInArrow(_upper, UPPER).drop("other"), f"above-{k}")
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, its language's root, the root, its proof's digest, and the root that its leaf,
    or a lower-cased one where 3 divides the id's crc32, folds to."""
    tampered = F.when(crc32_mod("doc_id", 3) == 0, leaf(F.translate(F.col("text"), ascii_uppercase, ascii_lowercase)))
    leaves = stage(docs.select(
        tree_of("lang").alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf().alias("digest"), tampered.alias("other"),
        F.monotonically_increasing_id().alias("row")), "leaves")     # so that repeated rows can be told apart and split
    rounds, subroots = grow(stage(numbered(leaves.withColumn("leaf", F.col("digest")), ["id", "leaf", "row"]), "leaves-numbered"))

    none = F.lit(None).cast("long")
    tops = stage(numbered(subroots.select(F.lit(ALL).alias("tree"), none.alias("id"), "digest", F.col("tree").alias("other"), F.col("tree").alias("name")),
                          ["name"]), "subroots")
    top_rounds, _ = grow(tops)
    start = top_rounds[0].select("tree").distinct().select("tree", F.array().cast(PATH).alias("path"), F.array().cast("array<string>").alias("tops"))
    trees = stage(_segments_with(top_rounds[0], above(top_rounds, start, 0)).mapInArrow(_upper, UPPER)
                  .select(F.col("other").alias("tree"), "path", "tops"), "above-trees")
    return _segments_with(rounds[0], above(rounds, trees, 0)).mapInArrow(
        _proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
