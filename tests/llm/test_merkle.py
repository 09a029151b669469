"""The Merkle manifest against a tree built level by level, and the postorder positions against a walk."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from helpers import documents, empty
from pyspark.sql import functions as F

from credence.llm import merkle as M


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lowered=False):
    doc_id, text, lang, source, n = row
    if lowered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    path = []
    for nodes in tree[:-1]:
        run = i // 8 * 8
        path.append((nodes[run:i], nodes[i + 1:run + 8]))
        i //= 8
    return path


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    root = top[-1][0]
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = siblings(trees[g], i) + siblings(top, k)
            node = plain_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r[0], leaf, trees[g][-1][0], root, h(*[x for left, right in path for x in left + right]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 600])
def test_positions_of_a_postorder_log(leaves):
    height = M.height_of(leaves)
    digests = [h(str(i)) for i in range(leaves)]
    log = M.postorder(digests, height)
    tree = levels(digests)
    assert len(tree) == height + 1 and len(log) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        assert [log[M.position(level, i, leaves)] for i in range(len(nodes))] == nodes
    for i, path in enumerate(M.proofs(log, leaves, height)):
        assert path == [("".join(a), "".join(b)) for a, b in siblings(tree, i)]
        assert M.fold(digests[i], path) == tree[-1][0]


def rows_of(n, langs):
    return [(i, f"Text {i % 50} Ü", langs[i % len(langs)], "S" if i % 3 else None, i) for i in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(1, ["en"]), rows_of(9, ["en"]), rows_of(30, [f"l{i}" for i in range(11)] + [None, "É", ""]),
    rows_of(1400, ["en", "en", "de"]), rows_of(512, ["en"]) + rows_of(3, ["x"])])
def test_manifest_equals_a_tree_built_by_levels(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(map(tuple, M.manifest(docs).collect()), key=repr)
    assert got == plain(rows)


def test_defined_cases(spark):
    from helpers import awkward
    got = M.manifest(documents(spark))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(awkward())
    assert M.manifest(empty(spark)).collect() == []
    wide = documents(spark)
    for c in ("tree", "digest", "leaf", "place", "row", "part", "id", "other"):
        wide = wide.withColumn(c, F.lit(None).cast("int"))
    assert sorted(map(tuple, M.manifest(wide).collect()), key=repr) == plain(awkward())


def test_a_changed_letter_is_noticed(spark):
    rows = rows_of(40, ["en"])
    got = M.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    changed = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 0}
    assert {r["doc_id"] for r in got.collect() if not r["verified"]} == changed and 5 < len(changed) < 30


def test_whole_log_is_in_postorder(spark):
    """Two rounds of builders: positions are without gaps and hold the nodes of the tree built by levels."""
    n = 1100
    digests = [h(str(i)) for i in range(n)]
    leaves = spark.createDataFrame([("t", i, n, d, i, None) for i, d in enumerate(digests)],
                                   "tree string, place long, n long, digest string, id long, other string")
    rounds, roots = M.grow(leaves)
    assert len(rounds) == 2
    got = {r["position"]: r["digest"] for r in M.log(rounds, leaves.select("tree", "n").distinct()).collect()}
    tree = levels(digests)
    assert roots.first()["digest"] == tree[-1][0]
    assert [got[p] for p in range(len(got))] == M.postorder(digests, len(tree) - 1)
