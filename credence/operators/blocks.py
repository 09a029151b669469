"""Documents in blocks that number their own terms: what is counted, looked up or added up moves packed, once per block and term.

A block holds a million entries (document, term) or so, in which a term has a place. Its terms are dealt by a hash to groups, which grow in
number with the corpus and add up document frequencies by name. What a group finds goes back to the places of a block as an array, norms
and sums per class are taken inside the block, and the sums go to the groups again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from credence.functions.text import usable
from credence.operators.features import smooth_idf
from credence.operators.memory import release, released, released_pairs
from credence.operators.models import by_route
from credence.session import stage

ENTRIES = 1 << 20           # of a block, after which it is closed
GROUP_TERMS = 1 << 19       # of all blocks per group, about
SLICE_ROWS = 256            # of an Arrow batch that are Python objects at a time

_words = re.compile(r"\w{2,}", re.ASCII).findall


class _Codes(dict):
    """Numbers of words, in the order in which they come; -1 for stop words."""

    def __init__(self, stop: list[str]) -> None:
        super().__init__(dict.fromkeys(stop, -1))
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        return code


class _Open:
    """A block that still grows. Rows with the key and label of the row before are one document with it."""

    def __init__(self, route: str, stop: list[str]) -> None:
        self.route, self.codes, self.last = route, _Codes(stop), None
        self.keys, self.labels, self.sizes, self.ids, self.tf, self.entries = [], [], [], [], [], 0

    def add(self, key, label: int, text: str | None) -> None:
        words = _words(text or "")
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        codes = codes[codes >= 0]
        ids, tf = np.unique(np.concatenate([codes, (codes[:-1] + 1) << 32 | codes[1:]]), return_counts=True)
        self.ids.append(ids)
        self.tf.append(tf.astype(np.int32))
        if self.last == (key, label):
            self.sizes[-1] += len(ids)
        else:
            self.keys.append(key)
            self.labels.append(label)
            self.sizes.append(len(ids))
        self.last = key, label
        self.entries += len(ids)

    def row(self) -> dict:
        ids, places = np.unique(np.concatenate(self.ids), return_inverse=True)
        words, single, second, n = pa.array(self.codes.words, pa.string()), np.searchsorted(ids, 1 << 32), ids & 0xFFFFFFFF, len(ids)
        first = (ids[single:] >> 32) - 1
        pairs = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second[single:])), " ")
        tf, marks = np.concatenate(self.tf), np.array([crc32(w.encode()) for w in self.codes.words], np.uint32)
        mark = marks[second]
        mark[single:] ^= marks[first] * np.uint32(0x9E3779B1)
        sizes, df, cf = np.array(self.sizes, np.int32), np.bincount(places, minlength=n), np.bincount(places, tf, n)
        return {"route": self.route, "keys": self.keys, "labels": self.labels, "sizes": sizes.tobytes(), "places": places.astype(np.int32).tobytes(), "tf": tf.tobytes(),
                "terms": _packed(pa.concat_arrays([words.take(pa.array(second[:single])), pairs])), "mark": (mark ^ mark >> np.uint32(15)).tobytes(),
                "df": df.astype(np.int32).tobytes(), "cf": cf.astype(np.int64).tobytes(), "n": n}


def _packed(terms: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("t", terms.type)])) as out:
        out.write_batch(pa.record_batch([terms], ["t"]))
    return sink.getvalue().to_pybytes()


def _terms(x: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(x.as_buffer()).read_all().column(0).combine_chunks()


def _numbers(x: pa.Scalar, kind=np.int32) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(name)[i] for name in b.schema.names}


def _table(schema: StructType, rows: list[tuple]) -> pa.Table:
    arrow = to_arrow_schema(schema)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def term_blocks(docs: DataFrame, key: str = "id", stop_words: Iterable[str] = ()) -> DataFrame:
    """Staged blocks of (key, label, route, input): keys, labels and numbers of entries of the documents, the entries as place and tf, and
    per place the term, a hash of it, and its df and cf in the block. Rows of equal key, label and route are entries of one document."""
    stop, most = usable(stop_words), ENTRIES
    to = StructType.fromDDL(f"block long, route string, keys array<{docs.schema[key].dataType.simpleString()}>, labels array<int>, "
                            "sizes binary, places binary, tf binary, terms binary, mark binary, df binary, cf binary, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schema, block = TaskContext.get().partitionId() << 32, to_arrow_schema(to), None

        def out() -> pa.RecordBatch:
            row = {"block": number, **block.row()}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
        for b in batches:
            for start in range(0, b.num_rows, SLICE_ROWS):
                for k, label, route, text in zip(*[c.to_pylist() for c in b.slice(start, SLICE_ROWS).columns]):
                    if block and (block.route != route or block.entries >= most and block.last != (k, label)):
                        yield out()
                        number, block = number + 1, None
                    block = block or _Open(route, stop)
                    block.add(k, label, text)
        if block:
            yield out()
    rows = docs.select(key, F.col("label").cast("int").alias("label"), "route", "input")
    return stage(rows.repartition(key).sortWithinPartitions("route", key, "label").mapInArrow(released(run), to), "blocks")


@dataclass
class TermGroups:
    """Staged groups of the terms of ``blocks``: (route, g, terms, df, cf, blocks, codes). ``codes``: per block that has terms of the
    group, where they are among the group's ones."""

    blocks: DataFrame
    table: DataFrame
    count: int

    def terms(self) -> DataFrame:
        """(route, term, df, cf)."""
        to = StructType.fromDDL("route string, term string, df long, cf long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in _rows(batches):
                terms = _terms(r["terms"])
                yield pa.RecordBatch.from_arrays([pa.array([r["route"].as_py()] * len(terms), pa.string()), terms, pa.array(_numbers(r["df"], np.int64)),
                                                  pa.array(_numbers(r["cf"], np.int64))], schema=to_arrow_schema(to))
        return self.table.select("route", "terms", "df", "cf").mapInArrow(run, to)


def term_groups(blocks: DataFrame, sizes: dict[str, int], least: dict[str, int], max_df: float) -> TermGroups:
    """Terms in ``least`` documents of a route or more, and in ``max_df`` of its documents (``sizes``) at most."""
    count = max(1, -(-(blocks.agg(F.sum("n").alias("n")).first()["n"] or 0) // GROUP_TERMS))
    part = StructType.fromDDL("route string, g int, block long, terms binary, df binary, cf binary")
    to = StructType.fromDDL("route string, g int, terms binary, df binary, cf binary, blocks array<long>, codes array<binary>")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            terms, df, cf = _terms(r["terms"]), _numbers(r["df"]), _numbers(r["cf"], np.int64)
            for g, at in _dealt(r["mark"], count):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                    (r["route"].as_py(), g, r["block"].as_py(), _packed(terms.take(pa.array(at))), df[at].tobytes(), cf[at].tobytes()),
                    to_arrow_schema(part))], schema=to_arrow_schema(part))

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        route, g = key[0].as_py(), key[1].as_py()
        found = [_terms(x) for x in rows.column("terms")]
        coded = pa.concat_arrays(found).dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        df = np.bincount(codes, np.concatenate([_numbers(x) for x in rows.column("df")]), n)
        cf = np.bincount(codes, np.concatenate([_numbers(x, np.int64) for x in rows.column("cf")]), n)
        kept = (df >= least[route]) & (df <= max_df * sizes[route])
        place = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)[codes]
        ends = np.cumsum([0, *map(len, found)])
        return _table(to, [(route, g, _packed(coded.dictionary.filter(pa.array(kept))), df[kept].astype(np.int64).tobytes(), cf[kept].astype(np.int64).tobytes(),
                            rows.column("block").to_pylist(), [place[a:b].tobytes() for a, b in zip(ends, ends[1:])])])

    def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = merge(key, rows)
        release()
        return out

    parts = blocks.select("route", "block", "terms", "mark", "df", "cf").mapInArrow(released(deal), part)
    return TermGroups(blocks, stage(parts.groupBy("route", "g").applyInArrow(merged, to), "term-groups"), count)


def _dealt(mark: pa.Scalar, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each group, ascending."""
    group = _numbers(mark, np.uint32) % np.uint32(count)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(count + 1))
    return ((g, order[a:b]) for g, (a, b) in enumerate(zip(ends, ends[1:])) if b > a)


def _entries(sizes: np.ndarray, place: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, value) of the entries whose term has an idf, normalised per document."""
    known = ~np.isnan(idf[place])
    document, place = np.repeat(np.arange(len(sizes)), sizes)[known], place[known]
    x = (1 + np.log(tf[known])) * idf[place]
    return document, place, x / np.sqrt(np.bincount(document, x * x, len(sizes)))[document]


def group_sums(groups: TermGroups, sizes: dict[str, int]) -> DataFrame:
    """Staged (route, term, idf, s0, s1) of all terms of the groups: sums of the tf-idf values of every class."""
    count = groups.count
    down, up = StructType.fromDDL("to long, g int, idf binary"), StructType.fromDDL("route string, g int, block long, s0 binary, s1 binary")
    to = StructType.fromDDL("route string, term string, df long, s0 double, s1 double")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            idf = np.append(np.log((1 + sizes[r["route"].as_py()]) / (1 + _numbers(r["df"], np.int64))) + 1, np.nan)
            for block, codes in zip(r["blocks"].as_py(), r["codes"].values):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                    (block, r["g"].as_py(), idf[_numbers(codes)].tobytes()), to_arrow_schema(down))], schema=to_arrow_schema(down))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        block = {c: left.column(c)[0] for c in left.column_names}
        at, idf = dict(_dealt(block["mark"], count)), np.full(block["n"].as_py(), np.nan)
        for g, found in zip(right.column("g").to_pylist(), right.column("idf")):
            idf[at[g]] = _numbers(found, np.float64)
        document, place, value = _entries(_numbers(block["sizes"]), _numbers(block["places"]), _numbers(block["tf"]), idf)
        label = np.array(block["labels"].as_py())[document]
        sums = [np.bincount(place[label == y], value[label == y], len(idf)) for y in (0, 1)]
        return _table(up, [(block["route"].as_py(), g, block["block"].as_py(), *[s[places].tobytes() for s in sums]) for g, places in at.items()])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        r = {c: left.column(c)[0] for c in left.column_names}
        terms, parts = _terms(r["terms"]), {b: i for i, b in enumerate(right.column("block").to_pylist())}
        sums = np.zeros((2, len(terms)))
        for block, codes in zip(r["blocks"].as_py(), r["codes"].values):
            codes = _numbers(codes)
            for s, name in zip(sums, ("s0", "s1")):
                s[codes[codes >= 0]] += _numbers(right.column(name)[parts[block]], np.float64)[codes >= 0]
        return pa.table([pa.array([r["route"].as_py()] * len(terms), pa.string()), terms, pa.array(_numbers(r["df"], np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                        schema=to_arrow_schema(to))

    sent = groups.table.select("route", "g", "df", "blocks", "codes").mapInArrow(released(send), down)
    blocks = groups.blocks.select("block", "route", "labels", "sizes", "places", "tf", "mark", "n")
    parts = blocks.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(released_pairs(add), up)
    table = groups.table.select(F.col("route").alias("r"), F.col("g").alias("of"), "route", "terms", "df", "blocks", "codes")
    rows = table.groupBy("r", "of").cogroup(parts.groupBy("route", "g")).applyInArrow(released_pairs(total), to)
    return stage(rows.select("route", "term", smooth_idf(F.col("df"), by_route(sizes)).alias("idf"), "s0", "s1"), "nb-sums")


def block_vectors(blocks: DataFrame, vocabulary: DataFrame, key: str = "id") -> DataFrame:
    """Staged (key, label, route, indices, values): one L2-normalised sparse row per document, from a vocabulary with ``idx`` and ``idf``."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    place, to = StructType.fromDDL("to long, route string, place int, term string"), StructType.fromDDL(
        f"{key} {kind}, label int, route string, indices array<int>, values array<double>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            terms = _terms(r["terms"])
            yield pa.RecordBatch.from_arrays([pa.array([r["block"].as_py()] * len(terms)), pa.array([r["route"].as_py()] * len(terms), pa.string()),
                                              pa.array(np.arange(len(terms), dtype=np.int32)), terms], schema=to_arrow_schema(place))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = {c: left.column(c)[0] for c in left.column_names}
        idx, idf = np.zeros(block["n"].as_py(), np.int32), np.full(block["n"].as_py(), np.nan)
        at = right.column("place").to_numpy()
        idx[at], idf[at] = right.column("idx").to_numpy(), right.column("idf").to_numpy()
        document, places, value = _entries(_numbers(block["sizes"]), _numbers(block["places"]), _numbers(block["tf"]), idf)
        column, n = idx[places], len(block["labels"])
        order = np.lexsort((value, column, document))
        ends = pa.array(np.searchsorted(document[order], np.arange(n + 1)).astype(np.int32))
        return pa.table([block["keys"].values, block["labels"].values, pa.array([block["route"].as_py()] * n, pa.string()),
                         pa.ListArray.from_arrays(ends, pa.array(column[order])), pa.ListArray.from_arrays(ends, pa.array(value[order]))],
                        names=to.names).cast(to_arrow_schema(to))

    # The term first: rows are compared by their first column.
    places = blocks.select("block", "route", "terms").mapInArrow(released(unpack), place).join(
        vocabulary.select("term", "route", "idx", "idf"), ["term", "route"]).select("to", "place", "idx", "idf")
    rows = blocks.select("block", "route", "keys", "labels", "sizes", "places", "tf", "n")
    return stage(rows.groupBy("block").cogroup(places.groupBy("to")).applyInArrow(released_pairs(run), to), "vectors")
