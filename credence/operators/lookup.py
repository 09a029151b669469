"""Looking up terms in a table of any size.

A table up to ``BROADCAST_BYTES`` is broadcast. Of a larger one only its most frequent terms are, the head: they
are the keys that many documents hold, so none of them is shuffled. All other terms of the documents first pass a
filter of fixed size, one bit per hash of a tail term, so that terms which the table does not know stay where they
are; the rest meets the tail by a 64-bit id. Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.session import stage

BROADCAST_BYTES = 256 * 1024 * 1024
HEAD_BYTES = 64 * 1024 * 1024
FILTER_BITS = 27                # of the hash that the filter tells apart: at most 2**21 words of 64 bits
KEYS = ["route", "term"]


def term_id() -> Column:
    return F.xxhash64(*KEYS)


def filter_word(bits: int) -> Column:
    """Number of the word that holds the bit of ``_id``."""
    return F.shiftrightunsigned("_id", 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))


def filter_bit() -> Column:
    return F.col("_id").bitwiseAND(F.lit(63)).cast("int")


def filter_words(ids: DataFrame, bits: int, name: str) -> DataFrame:
    """A filter over a column ``_id``: (_word, _bits), marked for broadcast. It has 2**(bits - 6) rows at most."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), filter_bit())
    return F.broadcast(stage(ids.select(filter_word(bits).alias("_word"), one.alias("b")).groupBy("_word").agg(F.bit_or("b").alias("_bits")), name))


def passes() -> Column:
    return F.call_function("bit_get", F.col("_bits"), filter_bit()) == 1


@dataclass(frozen=True)
class TermLookup:
    """``head``: marked for broadcast. ``tail``: the other terms with their ``_id``, ``words``: the filter over
    these ids, marked for broadcast; both None where the head is the whole table."""

    head: DataFrame
    tail: DataFrame | None = None
    words: DataFrame | None = None
    bits: int = FILTER_BITS

    @property
    def whole(self) -> bool:
        return self.tail is None

    def select(self, *columns: Column | str) -> TermLookup:
        """Other columns of the same table; ``columns`` include route and term."""
        return replace(self, head=self.head.select(*columns), tail=None if self.tail is None else self.tail.select("_id", *columns))

    def table(self) -> DataFrame:
        return self.head if self.tail is None else self.head.unionByName(self.tail.drop("_id"))

    def match(self, terms: DataFrame) -> DataFrame:
        """``terms`` (route, term, ...) joined with the table on both; read twice where there is a tail."""
        near = terms.join(self.head, KEYS)
        if self.tail is None:
            return near
        return near.unionByName(self.candidates(terms).join(self.tail, ["_id", *KEYS]).drop("_id"))

    def candidates(self, terms: DataFrame) -> DataFrame:
        """Rows, with their ``_id``, that are shuffled: terms outside the head that the tail may know."""
        far = terms.join(F.broadcast(self.head.select(*KEYS)), KEYS, "left_anti").withColumn("_id", term_id()).withColumn("_word", filter_word(self.bits))
        return far.join(self.words, "_word").where(passes()).drop("_word", "_bits")


def term_bytes() -> Column:
    """Bytes of a row's term, with 100 for the numbers and the overhead of a row."""
    return F.octet_length("term") + 100


def lookup(table: DataFrame, limit: int | None = None, head_bytes: int | None = None, bits: int = FILTER_BITS) -> TermLookup:
    """Measures a table (route, term, idf, ...) once and cuts it where it is too large to be broadcast.

    The head takes the terms of least idf, that is of most documents, in bands of an eighth, up to ``head_bytes``.
    """
    limit, head_bytes = BROADCAST_BYTES if limit is None else limit, HEAD_BYTES if head_bytes is None else head_bytes
    band = F.floor(F.col("idf") * 8).cast("int")
    sizes = sorted((r["band"], r["b"]) for r in table.groupBy(band.alias("band")).agg(F.sum(term_bytes()).alias("b")).collect())    # some hundred bands
    if sum(b for _, b in sizes) <= limit:
        return TermLookup(F.broadcast(table), bits=bits)
    taken, first = 0, sizes[0][0]
    for at, size in sizes:
        if taken + size > head_bytes:
            break
        taken, first = taken + size, at + 1
    tail = stage(table.where(band >= first).withColumn("_id", term_id()), "tail-terms")
    words = filter_words(tail, bits, "tail-filter")
    return TermLookup(F.broadcast(table.where(band < first)), tail, words, bits)
