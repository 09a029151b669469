"""Token ids of texts by a public tokenizer, with a memo for short pieces between safe boundaries.

The byte-level pre-tokenizer never joins a word with what stands before a space or newline that follows
a non-space character. A text may therefore be cut before such a character and the pieces encoded
alone; special strings hold no white space, so no cut divides one. Pieces repeat, so each worker keeps
the ids of recent ones.
"""

from __future__ import annotations

import json
import os
import re
import string
from itertools import chain
from typing import Any

import numpy as np

from credence.llm.common import kept

TOKENIZER = "byte_bpe_50k.json"
MEMO_PIECES = 400_000       # a generation; two are kept
JOIN_CHARS = 1_000          # unknown pieces are encoded in texts of about so many characters: the library takes longer for each of a long one
LONG_PIECE = 256            # longer pieces are not remembered
SEGMENT = 1_000_000         # longer texts are encoded in segments of about so many characters

_BESIDE = ("  ", " \n", "\n ", "\n\n", "\0")
_OTHER_SPACE = ["\t", "\x0b", "\x0c", "\r", *map(chr, range(0x1C, 0x20)), "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_boundary = re.compile(r"(?<=\S)(?=[ \n]\S)")
_word = re.compile("[ ][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch     # letters in every version of Unicode: one word to the pre-tokenizer


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries."""
    if any(x in text for x in _BESIDE) or any(x in text for x in _OTHER_SPACE):     # scans for one character are fast
        return _boundary.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def segments(text: str, limit: int) -> list[str]:
    """The text in order, cut at the first safe boundary after each ``limit`` characters; whole where there is none."""
    out, start = [], 0
    while len(text) - start > limit and (m := _boundary.search(text, start + limit)):
        out.append(text[start:m.start()])
        start = m.start()
    return [*out, text[start:]]


def _runs(parts: list[str]) -> list[list[str]]:
    """In order, cut after each ``JOIN_CHARS`` characters."""
    ends = np.cumsum([0, *map(len, parts)]) // JOIN_CHARS
    cuts = [*(np.flatnonzero(ends[1:] > ends[:-1]) + 1).tolist(), len(parts)]
    return [run for a, b in zip([0, *cuts], cuts) if (run := parts[a:b])]


class PieceEncoder:
    """Ids of each text as little-endian unsigned 32-bit numbers, as the library gives them for the whole text."""

    def __init__(self, path: str, memo: int = MEMO_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.zeros(size, dtype=bool)     # ids whose token begins with a space or a newline
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[i] = token[:1] in ("Ġ", "Ċ")
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.loose = "".join(c for c in string.punctuation if c not in special)     # punctuation that is in no special string
        self.memo, self.young, self.old = memo, {}, {}
        self.words = self._of_words(path)

    def _of_words(self, path: str) -> Any:
        """The same model for texts of words that are already cut, in the byte alphabet; None if the tokenizer does more than byte-level pre-tokenizing."""
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        if made["normalizer"] or made["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before["add_prefix_space"]:
            return None
        # The alphabet: printable bytes are themselves, the others follow 255.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in shown]
        self.alphabet = {**{b: chr(256 + i) for i, b in enumerate(others)}, 32: " Ġ"}
        words = Tokenizer.from_file(path)
        words.no_truncation()
        words.no_padding()
        words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return words

    def _alone(self, parts: list[str], into: dict[str, bytes]) -> None:
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            into[part] = np.array(e.ids, dtype="<u4").tobytes()

    def _joined(self, runs: list[list[str]], into: dict[str, bytes]) -> list[str]:
        """Runs of parts that begin with a space or newline: each is encoded as one text and cut at the ids that open a part.

        Returns the parts of runs in which something else holds a space or newline.
        """
        texts = ["".join(r) for r in runs]
        single = [t.count(" ") + t.count("\n") == len(r) for t, r in zip(texts, runs)]
        rest = [p for r, ok in zip(runs, single) if not ok for p in r]
        return rest + self._cut(self.tokenizer, [r for r, ok in zip(runs, single) if ok], [t for t, ok in zip(texts, single) if ok], into)

    def _cut(self, tokenizer: Any, runs: list[list[str]], texts: list[str], into: dict[str, bytes]) -> list[str]:
        if not runs:
            return []
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), "<u4", sum(map(len, found)))
        opens = self.opens[ids]
        first = np.cumsum([0, *map(len, found)])[:-1]
        agree = (np.add.reduceat(opens, first, dtype=np.int64) == [len(r) for r in runs]) & opens[first]
        if not agree.all():
            return [p for r, ok in zip(runs, agree) if not ok for p in r] + self._cut(
                tokenizer, [r for r, ok in zip(runs, agree) if ok], [t for t, ok in zip(texts, agree) if ok], into)
        raw = ids.tobytes()
        cuts = [*(np.flatnonzero(opens) * 4).tolist(), len(raw)]
        into.update(zip(chain.from_iterable(runs), (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
        return []

    def _learn(self, unknown: list[str], into: dict[str, bytes]) -> None:
        alone, words, joined = [], [], []
        for part in unknown:
            if len(part) > LONG_PIECE:
                alone.append(part)
            elif self.words and _word(part):
                words.append(part)
            elif len(part) > 1 and part[0] in " \n":
                joined.append(part)
            else:
                alone.append(part)
        runs = _runs(words)
        alone += self._cut(self.words, runs, ["".join(r).encode().decode("latin-1").translate(self.alphabet) for r in runs], into)
        alone += self._joined(_runs(joined), into)
        if alone:
            self._alone(alone, into)

    def encode(self, texts: list[str]) -> list[bytes]:
        if any(len(t) > SEGMENT for t in texts):
            return [b"".join(self._encode([part])[0] for part in segments(t, SEGMENT)) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts, ends = [], []
        for t in texts:
            if t:
                parts += pieces(t)
            ends.append(len(parts))
        ids = list(map(self.young.get, parts))
        if None in ids:
            self._fill(parts, ids)
        out, start = [], 0
        for end in ends:
            out.append(b"".join(ids[start:end]))
            start = end
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {}
        return out

    def _fill(self, parts: list[str], ids: list[bytes | None]) -> None:
        """Puts the ids of the pieces that the young generation does not know in their places.

        A piece that ends in punctuation after a letter or digit is its stem and its end: the pre-tokenizer always cuts there.
        """
        places = [i for i, x in enumerate(ids) if x is None]
        young, old, found, unknown, split = self.young, self.old, {}, {}, []
        for p in {parts[i] for i in places}:
            if (x := old.get(p)) is not None:
                found[p] = x
                continue
            stem = p.rstrip(self.loose)
            if 1 < len(stem) < len(p) and stem[-1].isalnum():
                split.append((p, stem, p[len(stem):]))
                for q in split[-1][1:]:
                    if q not in young:
                        if (x := old.get(q)) is None:
                            unknown[q] = None
                        else:
                            found[q] = x
            else:
                unknown[p] = None
        self._learn(list(unknown), found)
        for p, stem, end in split:
            found[p] = (found.get(stem) or young[stem]) + (found.get(end) or young[end])
        for i in places:
            ids[i] = found[parts[i]]
        for p in [p for p in found if len(p) > LONG_PIECE]:
            del found[p]
        young.update(found)


def encoder(path: str, memo: int = MEMO_PIECES) -> PieceEncoder:
    """One per Python worker."""
    return kept(("encoder", path, memo), lambda: PieceEncoder(path, memo))
