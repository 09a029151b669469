"""Token counts, packing and binary output against the library on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward, documents, empty, prose
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from credence.llm import binary_output, encoding, packing, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(encoding.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "the", "The", "'s", "I'll", "12", "3", "é", "ß", "中", "!", "...", "<|endoftext|>", "<|endo",
         "\x1c", "\x85", " ", "　", "\0", "🙂", "́"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_pieces_encode_as_the_whole(text):
    e = encoding.encoder(encoding.tokenizer_path())
    assert "".join(encoding.pieces(text)) == text
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_segments_and_a_small_memo(monkeypatch, library):
    monkeypatch.setattr(encoding, "SEGMENT", 50)
    e = encoding.PieceEncoder(encoding.tokenizer_path(), memo=20)
    texts = [prose(i, 200) + "\n" + "y" * 300 + " end" for i in range(4)] + ["z" * 500, ""]
    assert all(len(encoding.segments(t, 50)) > 1 for t in texts[:4])
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [ids_of(library, t) for t in texts]


def test_token_counts(spark, library):
    got = sorted(map(str, map(tuple, token_counts.token_counts(documents(spark)).collect())))
    want = sorted(str((k, len((t or "").encode()), n := len(ids_of(library, t)), n > 512)) for k, t, *_ in awkward())
    assert got == want
    assert token_counts.token_counts(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 300))]
    bins, free = [None] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):        # the first bin with room, by looking at all
        place = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if place is None:
            place = len(free)
            free.append(100)
        free[place] -= lengths[i]
        bins[i] = place
    assert packing.first_fit_decreasing(lengths, 100) == bins


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 300))]
    free, got = defaultdict(lambda: 100), binary_output.best_fit_decreasing(lengths, 100)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):        # no open bin that fits is fuller
        room = [f for f in free.values() if f >= lengths[i]]
        if got[i] in free:
            assert free[got[i]] == min(room)
        else:
            assert not room
        free[got[i]] -= lengths[i]
    assert min(free.values()) >= 0


def check_pieces(rows, library, texts, sequence):
    """rows: (key, start, length, crc, doc_tokens, sequence_id, offset)."""
    used = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        used[r[5]].append((r[6], r[2]))
        by_doc[r[0]].append(r)
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= sequence
    want = defaultdict(list)
    for k, t in texts:
        want[k].append(np.array(ids_of(library, t) + [1], "<u4"))
    got_pieces = sorted((str(k), r[1], r[2], r[3], r[4]) for k, l in by_doc.items() for r in l)
    want_pieces = sorted((str(k), s, min(sequence, len(i) - s), zlib.crc32(i[s:s + sequence].tobytes()), len(i))
                         for k, l in want.items() for i in l for s in range(0, len(i), sequence))
    assert got_pieces == want_pieces


def test_packing(spark, library):
    out = packing.pack(documents(spark), sequence=256, group=4)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces([tuple(r) for r in out.collect()], library, [r[:2] for r in awkward()], 256)
    assert packing.pack(empty(spark)).count() == 0


def test_packing_leaves_little_room(spark):
    rows = [(i, prose(i, 20 + i % 300), None, None, None) for i in range(400)]
    out = packing.pack(documents(spark, rows, clash=False), sequence=1024).collect()
    assert sum(r["length"] for r in out) / (1024 * len({r["sequence_id"] for r in out})) > 0.98


def test_equal_keys_and_texts_are_dealt_to_many_groups(spark):
    rows = [(7, "the same text", None, None, None)] * 500
    out = packing.pack(documents(spark, rows, clash=False), group=50).collect()
    groups = defaultdict(int)
    for r in out:
        groups[r["sequence_id"] >> 32] += 1
    assert len(out) == 500 and len(groups) >= 8 and max(groups.values()) < 120


def test_written_matrices_hold_every_document(spark, library, tmp_path):
    path = str(tmp_path / "packed")
    binary_output.write_packed(documents(spark), path, sequence=128, run_tokens=5_000, pad_id=9)
    found = defaultdict(list)
    for r in spark.read.parquet(path).collect():
        ids, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u2")
        ends = r["cu_seqlens"]
        assert len(ids) == len(positions) == 128 and ends[0] == 0 and len(ends) == len(r["segments"]) + 1
        assert (ids[ends[-1]:] == 9).all() and not positions[ends[-1]:].any()
        for s, a, b in zip(r["segments"], ends, ends[1:]):
            assert s["length"] == b - a and positions[a:b].tolist() == list(range(b - a))
            found[s["doc_id"]].append((s["start"], ids[a:b].tolist()))
    want = defaultdict(list)
    for k, t, *_ in awkward():
        ids = ids_of(library, t) + [1]
        want[k] += [(s, ids[s:s + 128]) for s in range(0, len(ids), 128)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_digests(spark, library):
    out = binary_output.digests(documents(spark)).collect()
    assert all(r["positions_ok"] and r["n_tokens"] == r["cu_seqlens"][-1] <= 2048 for r in out)
    assert sum(r["n_tokens"] for r in out) == sum(len(ids_of(library, r[1])) + 1 for r in awkward())
    assert binary_output.digests(empty(spark)).count() == 0


def test_unknown_words_are_not_cut_again():
    """Words of letters go to the model without the pre-tokenizer; their ids are those of the library."""
    encoder, library = encoding.PieceEncoder(encoding.tokenizer_path()), Tokenizer.from_file(encoding.tokenizer_path())
    words = [" zqxvan", " Straßenbähnle", " čřžýá", " ÀÖØöøɏ", " a", " Ġab", " ×x", " naïve", " éé", " word9", "\nnew", " it's"]
    seen = []
    encoder.tokenizer = type("Seen", (), {"encode_batch_fast": lambda _, texts, **o: seen.extend(texts) or library.encode_batch_fast(texts, **o)})()
    found = {}
    encoder._learn(words, found)
    assert found == {w: np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}
    assert "zqxvan" not in "".join(seen) and "čřžýá" not in "".join(seen)
