"""Phrase collocations per language: best-first growth of phrases with admissible bounds.

A phrase of two to four words that occurs ``a >= 30`` times is cut after its first k words into parts that occur
l and r times; its score is the least floor(2000000 a / (l + r)) over its cuts. A phrase is dropped if some
longer candidate that holds it occurs at least 0.8 times as often.

1. Texts are cut into words once and written as blocks: the distinct words and the numbers of all tokens. Words
   are counted, then pairs of frequent words.
2. A pair (x, y) is a prefix that may be grown. Whatever starts with it occurs c = f(x y) times at most and is cut
   after x with a rest that occurs no less often than the whole, so 2000000 c / (f(x) + c) bounds the scores of
   everything below it. By the same reasoning 2000000 c / (f(y) + c) bounds all phrases that end in it.
3. The frontier holds the prefixes by their bound. Per language all whose bound reaches a trial score are grown
   in one pass, to three and four words; every phrase with that score or more is among what is counted, with its
   parts and its one-word extensions on both sides, and these decide whether it is dropped: a four-word phrase
   around a pair holds a three-word one that occurs as often or more.
4. A language is settled when 2000 phrases that survive reach its trial score: the 2000th score and its ties are
   then known. Other languages go on with a lower trial score, in the end zero, where nothing is left to grow.

What tasks know of frequent words, frequent pairs and grown prefixes are bitmaps of a fixed size over their hashes. A
false hit only counts more phrases than needed: which occurrences are counted depends on the phrase alone, so
every count of a phrase that has all its occurrences counted is exact. Words and pairs are first added up by hash, as
packed arrays; equal hashes can only make a sum too great, so whatever occurs often enough passes, and is
then counted by its words. Tasks add up some blocks before they emit anything.

Null languages are ``und``. Null and empty texts have no words. Rows, also repeated ones and those with null
ids, count as they stand; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import rows_of, small_batches
from credence.session import stage

LEAST = 30                   # occurrences of a candidate
TOP = 2000
LONGEST = 4
DROP = (80, 100)             # share of its occurrences inside a longer one that drops a phrase
SCALE = 2_000_000
FILTER_BITS = 26             # of the hashes that a bitmap tells apart: 8 MB
CHUNK = 1 << 20              # bytes of one language that become a block; of all languages that wait, 8 times as many
BLOCK_TOKENS = 2_000_000     # tokens whose phrases a task adds up before it emits them
BLOCK_WORDS = 500_000        # distinct words among them
GROUP_TOKENS = 4_000_000     # tokens of the corpus per group of hashes that is added up at once
GROWTH = 4                   # a further trial looks at so many times more pairs
SALTS = 32

_TOKEN = re.compile(rb"[.,;:!?\n-\r]|[^ \t.,;:!?\n-\r]+")
_SEPARATORS = [b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"]
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("c", pa.int64())])
COUNTS = "lang string, phrase string, words int, c long"
BLOCK = "lang string, n long, words binary, ids binary, wide boolean"


# ----------------------------------------------------------------------------- hashes, the same in tasks and in columns

def _turn(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _turned(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def mixed(lang: str, *hashes: np.ndarray) -> np.ndarray:
    """Hash of the phrase with these word hashes."""
    out = _turn(np.array([xxhash.xxh64_intdigest(lang.encode(), 42)], np.uint64), 42)
    for h in hashes:
        out = _turn(out, 21) ^ h
    return out


def slots(lang: str, *hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit of the phrase with these word hashes."""
    return mixed(lang, *hashes) & np.uint64((1 << bits) - 1)


def slot(lang: Column | str, words: Iterable[Column], bits: int) -> Column:
    out = _turned(F.xxhash64(lang), 42)
    for w in words:
        out = _turned(out, 21).bitwiseXOR(F.xxhash64(w))
    return out.bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(df: DataFrame, at: Column, bits: int) -> np.ndarray:
    """The bits at ``at``: 2**bits of them however many rows there are."""
    place = (at + 1).cast("long")
    parts = (df.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
             .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    out = np.zeros(max(1 << bits, 1 << 15) >> 3, np.uint8)
    for r in parts:
        start = (r["b"] - 1) * 4096
        out[start:start + 4096] |= np.frombuffer(bytes(r["m"]), np.uint8)[:len(out) - start]
    return out


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


# ----------------------------------------------------------------------------- blocks of tokens

class _Numbers(dict):
    """Numbers of words from 1, in the order in which they are first asked for; separators are 0."""

    def __init__(self) -> None:
        super().__init__(dict.fromkeys(_SEPARATORS, 0))
        self.words: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _encoded(lang: str, texts: list[bytes]) -> pa.RecordBatch:
    found, numbers = _TOKEN.findall(b"\n".join(texts)), _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
    wide = len(numbers.words) > 1 << 16
    return pa.RecordBatch.from_pydict({
        "lang": [lang], "n": [int(np.count_nonzero(ids))], "words": [b"\n".join(numbers.words[1:])],
        "ids": [ids.tobytes() if wide else ids.astype(np.uint16).tobytes()], "wide": [wide]})


def blocks(docs: DataFrame) -> DataFrame:
    """Staged (lang, n, words, ids, wide): about a megabyte of texts of one language, one text per line, lower-cased."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in rows_of(batches):
            if text:
                waiting.setdefault(lang, []).append(text.lower())       # bytes: A-Z only
                sizes[lang] = sizes.get(lang, 0) + len(text)
                full = list(sizes) if sum(sizes.values()) > 8 * chunk else [lang] if sizes[lang] > chunk else []
                for k in full:
                    yield _encoded(k, waiting.pop(k))
                    del sizes[k]
        for k, texts in waiting.items():
            yield _encoded(k, texts)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    small_batches(texts)
    return stage(texts.mapInArrow(run, BLOCK), "token-blocks")


class _Block:
    """Some blocks of one language as one: distinct words with their hashes, and the numbers of all tokens."""

    def __init__(self, lang: str) -> None:
        self.lang, self.numbers, self.runs = lang, _Numbers(), []

    def add(self, words: bytes, ids: bytes, wide: bool) -> int:
        place = np.fromiter(map(self.numbers.__getitem__, words.split(b"\n") if words else []), np.int32)
        run = np.frombuffer(ids, np.int32 if wide else np.uint16)
        self.runs += [np.concatenate([np.zeros(1, np.int32), place])[run], np.zeros(1, np.int32)]
        return len(run)

    def finish(self, known: np.ndarray | None, bits: int) -> None:
        """Words whose bit is not set become separators."""
        self.words = self.numbers.words
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.words), np.uint64, len(self.words))
        self.ids = np.concatenate(self.runs)
        if known is not None:
            keep = _has(known, slots(self.lang, self.hashes, bits=bits))
            keep[0] = False
            self.ids = np.where(keep[self.ids], self.ids, 0).astype(np.int32)

    def pairs(self) -> np.ndarray:
        return np.flatnonzero((self.ids[:-1] > 0) & (self.ids[1:] > 0))


def _merged(batches: Iterable[pa.RecordBatch], known: np.ndarray | None, bits: int, tokens: int, distinct: int) -> Iterator[_Block]:
    found: dict[str, _Block] = {}
    size = 0

    def out() -> Iterator[_Block]:
        for k in list(found):
            block = found.pop(k)
            block.finish(known, bits)
            yield block
    for b in batches:
        for i in range(b.num_rows):
            lang, words, ids, wide = (b.column(c)[i].as_py() for c in ("lang", "words", "ids", "wide"))
            block = found.setdefault(lang, _Block(lang))
            size += block.add(words, ids, wide)
            if size >= tokens or sum(len(x.numbers) for x in found.values()) > distinct:
                yield from out()
                size = 0
    yield from out()


def _over(work: Callable[[Iterable[_Block]], Iterable[pa.RecordBatch]], known: np.ndarray | None, bits: int) -> Callable:
    tokens, distinct = BLOCK_TOKENS, BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(_merged(batches, known, bits, tokens, distinct))
    return run


# ----------------------------------------------------------------------------- sums by hash

def _single(block: _Block) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(block.ids, minlength=len(block.words))
    counts[0] = 0
    at = np.flatnonzero(counts)
    return mixed(block.lang, block.hashes[at]), counts[at]


def _double(block: _Block) -> tuple[np.ndarray, np.ndarray]:
    at = block.pairs()
    key, counts = np.unique(block.ids[at].astype(np.int64) << 32 | block.ids[at + 1], return_counts=True)
    return mixed(block.lang, block.hashes[key >> 32], block.hashes[key & 0xFFFFFFFF]), counts


def frequent_slots(tokens: DataFrame, hashed: Callable[[_Block], tuple[np.ndarray, np.ndarray]], known: np.ndarray | None, least: int,
                   total: int, bits: int) -> np.ndarray:
    """A bitmap that has the bits of all that occur ``least`` times or more, and few others.

    Counts go as bytes, ``least`` at most, and hashes as 32 bits within groups; the groups grow in number with the corpus.
    """
    groups = max(1, -(-total // GROUP_TOKENS))
    if not 0 < least < 256 or bits > 32:
        raise ValueError("counts are kept in bytes and hashes in 32 bits")

    def packed(found: Iterable[_Block]) -> Iterator[pa.RecordBatch]:
        for block in found:
            h, counts = hashed(block)
            group = (h >> np.uint64(32)) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            h, counts, group = h[order].astype(np.uint32), np.minimum(counts[order], least).astype(np.uint8), group[order]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
            ends = [*starts[1:], len(group)]
            if len(group):
                yield pa.RecordBatch.from_pydict({
                    "g": group[starts].astype(np.int64), "h": pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    "c": pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column("h")])
        c = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in rows.column("c")])
        key, place = np.unique(h, return_inverse=True)
        sums = np.bincount(place, weights=c, minlength=len(key))
        return pa.table({"slot": (key[sums >= least] & np.uint32((1 << bits) - 1)).astype(np.int64)})

    sums = tokens.mapInArrow(_over(packed, known, bits), "g long, h binary, c binary").groupBy("g").applyInArrow(add, "slot long")
    return bitmap(sums, F.col("slot"), bits)


# ----------------------------------------------------------------------------- counts by words

def _tally(block: _Block, starts: np.ndarray, n: int) -> Iterator[tuple[str, int]]:
    """(phrase, occurrences) of the phrases of ``n`` words at ``starts``."""
    if not len(starts):
        return
    ids, words = block.ids, block.words
    key = ids[starts].astype(np.int64)
    for j in range(1, n):
        if j > 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * len(words) + ids[starts + j]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    columns = [ids[starts[first] + j].tolist() for j in range(n)]
    for c, *row in zip(counts.tolist(), *columns):
        yield b" ".join([words[i] for i in row]).decode("utf-8", "replace"), c


def _words(block: _Block) -> Iterator[tuple[str, int, int]]:
    for phrase, c in _tally(block, np.flatnonzero(block.ids), 1):
        yield phrase, 1, c


def _pairs(pairs: np.ndarray, bits: int) -> Callable[[_Block], Iterator[tuple[str, int, int]]]:
    """Pairs whose bit is set in ``pairs``."""
    def count(block: _Block) -> Iterator[tuple[str, int, int]]:
        at = block.pairs()
        h = block.hashes
        at = at[_has(pairs, slots(block.lang, h[block.ids[at]], h[block.ids[at + 1]], bits=bits))]
        for phrase, c in _tally(block, at, 2):
            yield phrase, 2, c
    return count


def _grown(pairs: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> Callable[[_Block], Iterator[tuple[str, int, int]]]:
    """Phrases of three and four words of frequent ``pairs``. ``starts``, ``ends``: those that may start or end a phrase."""
    def count(block: _Block) -> Iterator[tuple[str, int, int]]:
        h, ids = block.hashes, block.ids
        pair = block.pairs()
        at = slots(block.lang, h[ids[pair]], h[ids[pair + 1]], bits=bits)
        frequent = _has(pairs, at)
        pair, at = pair[frequent], at[frequent]
        known, start, end = (np.zeros(len(ids) + 3, bool) for _ in range(3))
        known[pair], start[pair], end[pair] = True, _has(starts, at), _has(ends, at)
        three = known[:-1] & known[1:] & (start[:-1] | end[1:])
        four = known[:-2] & known[1:-1] & known[2:] & ((start[:-2] & (end[1:-1] | end[2:])) | (start[1:-1] & end[2:]))
        for n, mask in ((3, three), (4, four)):
            for phrase, c in _tally(block, np.flatnonzero(mask), n):
                yield phrase, n, c
    return count


def count_phrases(tokens: DataFrame, count: Callable[[_Block], Iterable[tuple[str, int, int]]], known: np.ndarray, bits: int,
                  size: int = 65_536) -> DataFrame:
    """(lang, phrase, words, a) of what ``count`` finds in merged blocks."""
    def work(found: Iterable[_Block]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _COUNTS)], schema=_COUNTS)
        for block in found:
            for row in count(block):
                done.append((block.lang, *row))
                if len(done) >= size:
                    yield out()
                    done.clear()
        if done:
            yield out()
    return tokens.mapInArrow(_over(work, known, bits), COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("c").alias("a"))


# ----------------------------------------------------------------------------- scores

def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def _share(a: str, both: Column) -> Column:
    """floor(SCALE * a / both), in decimals: the product may pass 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * _exact(a), both)


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases all of whose parts are in ``counts``."""
    w = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit(1).alias("side"), F.array_join(F.slice(w, k + 1, F.col("words") - k), " ").alias("part"))))
    parts = phrases.select("lang", "phrase", "words", "a", F.explode(F.flatten(cuts)).alias("x")).select("lang", "phrase", "words", "a", "x.*")
    known = parts.join(counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("a").alias("f")),
                       (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_part")))
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{name}{k}")
             for k in range(1, LONGEST) for side, name in enumerate("lr")]
    rows = known.groupBy("lang", "phrase", "words", "a").agg(F.count("*").alias("parts"), *sides).where(
        F.col("parts") == 2 * (F.col("words") - 1))
    least = F.array_min(F.array_compact(F.array(*[
        F.when(F.col("words") > k, F.struct(_share("a", _exact(f"l{k}") + _exact(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                                            F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, LONGEST)])))
    return rows.withColumn("m", least).select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def surviving(candidates: DataFrame, longer: DataFrame) -> DataFrame:
    """Candidates without a one-word extension in ``longer`` that occurs too often."""
    w = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))
    most = (longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    share, of = DROP
    return candidates.join(most, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.lit(of) * _exact("most") < F.lit(share) * _exact("a"))).drop("most")


def trial_scores(pairs: DataFrame, langs: DataFrame, wanted: int) -> DataFrame:
    """(lang, tau): a thousand's edge that ``wanted`` pairs of the language reach, 0 where there are fewer."""
    bands = pairs.groupBy("lang", F.floor(F.col("score") / 1000).alias("band")).agg(F.count("*").alias("c"))
    above = Window.partitionBy("lang").orderBy(F.desc("band"))      # at most 1,001 bands
    edges = bands.withColumn("above", F.sum("c").over(above)).where(F.col("above") >= wanted).groupBy("lang").agg(F.max("band").alias("band"))
    return langs.join(edges, "lang", "left").select("lang", F.coalesce(F.col("band") * 1000, F.lit(0)).alias("tau"))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    By score, occurrences, and bytes of the phrase. ``docs`` has ``text`` and ``lang``.
    """
    tokens = blocks(docs)
    totals = tokens.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    usual = frequent_slots(tokens, _single, None, least, total, bits)
    single = stage(count_phrases(tokens, _words, usual, bits).where(F.col("a") >= least), "words")
    words = bitmap(single, slot("lang", [F.col("phrase")], bits), bits)
    usual = frequent_slots(tokens, _double, words, least, total, bits)
    double = stage(count_phrases(tokens, _pairs(usual, bits), words, bits).where(F.col("a") >= least), "pairs")
    shorter = single.unionByName(double)
    pairs = stage(scored(double, shorter), "scored-pairs")
    frequent = (words, bitmap(double, slot("lang", _both(), bits), bits))
    results: list[DataFrame] = []
    open_langs, wanted = totals.select("lang"), 2 * top
    while True:
        trial = stage(trial_scores(pairs, open_langs, wanted), "trial")
        candidates, longer = _grow(tokens, pairs, shorter, trial, frequent, least, bits)
        found = stage(surviving(candidates, longer), "survivors")
        reached = found.groupBy("lang").agg(F.count("*").alias("reached"))
        state = stage(trial.join(reached, "lang", "left").withColumn("settled", (F.col("tau") == 0) | (F.coalesce("reached", F.lit(0)) >= top)), "state")
        results.append(found.join(state.where("settled").select("lang"), "lang", "left_semi"))
        open_langs = state.where("NOT settled").select("lang")
        if not open_langs.limit(1).count():
            break
        wanted *= GROWTH
    return ranked(results, top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _both() -> list[Column]:
    return [F.split("phrase", " ")[0], F.split("phrase", " ")[1]]


def _grow(tokens: DataFrame, pairs: DataFrame, shorter: DataFrame, trial: DataFrame, frequent: tuple[np.ndarray, np.ndarray], least: int,
          bits: int) -> tuple[DataFrame, DataFrame]:
    """(candidates that reach their language's trial score, counted phrases of three and four words)."""
    judged = pairs.join(trial, "lang")

    def bound(part: str) -> Column:
        return _share("a", _exact(part) + _exact("a")) >= F.col("tau")
    starts, ends = (bitmap(judged.where(bound(part)), slot("lang", _both(), bits), bits) for part in "lr")
    words, usual = frequent
    longer = stage(count_phrases(tokens, _grown(usual, starts, ends, bits), words, bits).where(F.col("a") >= least), "longer")
    grown = scored(longer, shorter.unionByName(longer)).join(trial, "lang")
    reach = F.col("score") >= F.col("tau")
    return judged.where(reach).drop("tau").unionByName(grown.where(reach).drop("tau")), longer


def ranked(parts: list[DataFrame], top: int) -> DataFrame:
    """The first ``top`` rows of every language with their rank; first in salted groups, so that none is large."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= top).drop("salt", "place")
