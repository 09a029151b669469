"""Text functions: cleaning, metadata tokens, routing and tokenising, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.schema import CLAIM_MAX_WORDS, LABELS, META_FIELDS, META_PREFIX

# Unicode whitespace as a regex class body; Java's own \s is ASCII only.
WS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# The same characters as a plain string.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                             0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Null to '', otherwise without leading and trailing Unicode whitespace."""
    return F.btrim(blank_null(c), F.lit(WS_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression that is named several times may be computed several times, per element if a lambda
    names it; a lambda variable is bound to its value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(c: Column | str) -> Column:
    """Lower case, no URLs, no tags, only ``[a-z0-9]`` words with inner apostrophes, single spaces.

    URLs and tags are looked for by regex only in texts that hold their first characters. The words
    are then extracted and joined: one pass, several times faster than replacing all that is between.
    """
    def when_it_has(marks: list[str], step: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda t: F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks]), step(t)).otherwise(t)

    no_urls = when_it_has(["http", "www."], lambda t: F.regexp_replace(t, rf"(?:https?://|www\.)[^{WS}]+", " "))
    no_tags = when_it_has(["<"], lambda t: F.regexp_replace(t, "<[^>]+>", " "))
    t = let(let(F.lower(blank_null(c)), no_urls), no_tags)
    return F.array_join(F.regexp_extract_all(t, F.lit("[a-z0-9]+(?:'[a-z0-9]+)*"), F.lit(0)), " ")


def model_input(title: Column | str, text: Column | str) -> Column:
    return clean_text(F.concat(blank_null(title), F.lit(" "), blank_null(text)))


def _field_tokens(field: str, prefix: str) -> Column:
    head = F.lit(prefix + "_")
    parts = F.transform(
        F.split(F.lower(blank_null(field)), ","),
        lambda p: F.concat(head, F.btrim(F.regexp_replace(p, "[^a-z0-9]+", "_"), F.lit("_"))),
    )
    return F.filter(parts, lambda p: p != head)


def meta_tokens() -> Column:
    """``speaker='Barack Obama', subject='economy,taxes'`` to ``spk_barack_obama subj_economy subj_taxes``."""
    return F.array_join(F.concat(*[_field_tokens(f, p) for f, p in META_PREFIX.items()]), " ")


def has_meta() -> Column:
    return reduce(lambda a, b: a | b, [strip(f) != "" for f in META_FIELDS])


def word_count(c: Column | str) -> Column:
    return F.regexp_count(blank_null(c), F.lit(f"[^{WS}]+"))


def has_words(c: Column | str, n: int) -> Column:
    """At least ``n`` whitespace-separated words; stops reading at the n-th one."""
    return blank_null(c).rlike(f"^[{WS}]*+(?:[^{WS}]++[{WS}]++){{{n - 1}}}[^{WS}]")


def route_for(title: Column | str = "title", text: Column | str = "text") -> Column:
    """Claim if there is claim metadata, or no title and a short text; otherwise article."""
    short = (strip(title) == "") & ~has_words(text, CLAIM_MAX_WORDS)
    return F.when(has_meta() | short, "claim").otherwise("article")


def prepare(route: Column | str, title: Column | str = "title", text: Column | str = "text",
            max_chars: int | None = None) -> Column:
    """Model input of a row under ``route``: whole texts, or their first ``max_chars`` cleaned characters.

    Claims get their metadata tokens, after the cut if there is one.
    """
    return with_meta(cut(model_input(title, text), max_chars), meta_tokens(), _col(route))


def cut(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def with_meta(base: Column, meta: Column, route: Column) -> Column:
    """The prepared text of a claim with its metadata tokens; any other text as it is."""
    return let(base, lambda t: F.when((route == "claim") & (meta != ""), F.trim(F.concat(t, F.lit(" "), meta))).otherwise(t))


def usable(stop_words: Iterable[str]) -> list[str]:
    """Stop words that may be tokens."""
    return [w for w in stop_words if w.replace("_", "a").isalnum()]


def tokens(c: Column | str, stop_words: Iterable[str]) -> Column:
    """Runs of two or more word characters, without stop words."""
    words = F.regexp_extract_all(_col(c), F.lit(r"\w{2,}"), F.lit(0))
    stop = usable(stop_words)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def _tail(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def ngrams(words: Column) -> Column:
    """Unigrams and adjacent pairs."""
    def both(w: Column) -> Column:
        head = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        return F.concat(w, F.zip_with(head, _tail(w), lambda a, b: F.concat(a, F.lit(" "), b)))
    return let(words, both)


def run_lengths(items: Column) -> Column:
    """Array of (term, tf) of an array: sort it, find where each run starts, subtract neighbours."""
    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda h: F.zip_with(
            h, F.concat(_tail(h), F.filter(F.array(F.size(s)), lambda n: n > 0)),
            lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("tf"))))
    return let(F.sort_array(items), runs)


def term_counts(c: Column | str, stop_words: Iterable[str]) -> Column:
    """Array of (term, tf) over the unigrams and bigrams of a prepared text.

    The counting happens inside the row, so it moves no data.
    """
    return run_lengths(ngrams(tokens(c, stop_words)))


def label_name(label: Column | str) -> Column:
    c = _col(label)
    return F.when(c == 1, LABELS[1]).when(c == 0, LABELS[0])


# Display names of the metadata prefixes.
PREFIX_LABEL = {"spk": "speaker", "party": "party", "subj": "topic", "ctx": "venue", "st": "state"}


def pretty_term(term: Column | str) -> Column:
    """``spk_barack_obama`` to ``speaker: barack obama``; words joined by a dot if any is metadata."""
    pattern = r"^(spk|party|subj|ctx|st)_(.+)$"
    names = F.create_map(*[F.lit(x) for kv in PREFIX_LABEL.items() for x in kv])
    words = F.split(_col(term), " ")
    shown = F.transform(words, lambda w: F.when(
        w.rlike(pattern),
        F.concat(F.element_at(names, F.regexp_extract(w, pattern, 1)), F.lit(": "),
                 F.replace(F.regexp_extract(w, pattern, 2), F.lit("_"), F.lit(" ")))).otherwise(w))
    return F.when(F.exists(words, lambda w: w.rlike(pattern)), F.array_join(shown, " · ")).otherwise(_col(term))
