"""Token ids, Huffman files and packing: round trips and comparison with the library's own calls."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casagrid.llm import huffman, packing
from casagrid.llm.queries import tokenizer_path
from casagrid.llm.tokens import Encoder

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = ("a  b", "a\n\nb", "\n\n\nx", " lead", " trail ", "tab\tx", "it's we'll  x", "a b", "<|endoftext|> x<|endoftext|>", "é ́x", "ΑΣ ΣΑΣ", "x \n y", "123 456\n789", "\n", " ", "a \n", "\x01 \x02", "don't stop...!!\nÜber alles", "")


@pytest.fixture(scope="module")
def encoders():
    return [Encoder(tokenizer_path(f)) for f in FILES]


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n.,'aéß")), max_size=40))
def test_ids_equal_one_call_on_the_text(encoders, text):
    for e in encoders:
        assert e(text) == e.whole(text)


def test_ids_of_odd_texts(encoders):
    for e in encoders:
        for text in ODD:
            assert e(text) == e.whole(text)
        assert e(None) == b""


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 3999)
    counts = np.bincount(ids, minlength=4000)
    bits = huffman.code_lengths(counts)
    assert bits.max(initial=0) <= huffman.LIMIT and ((bits > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert (2.0 ** -bits[bits > 0]).sum() == 1
    codes = huffman.canonical_codes(bits)
    payload, checkpoints = huffman.pack_codes(ids, bits, codes)
    assert (huffman.unpack_codes(payload, checkpoints, n, huffman.lookup_table(bits, codes)) == ids).all()


def test_code_lengths_are_limited_and_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, tight = huffman.code_lengths(counts, 16), huffman.code_lengths(counts, 4)
    heap, best = counts.tolist(), 0
    while len(heap) > 1:  # the sum of all joined weights
        heap.sort()
        heap = [heap[0] + heap[1], *heap[2:]]
        best += heap[0]
    assert (free * counts).sum() == best and tight.max() == 4 and (2.0**-tight).sum() <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(20), 4)


def test_token_file_holds_all_rows(spark, make_docs, odd_rows, monkeypatch):
    path = tokenizer_path(FILES[0])
    encode = Encoder(path)
    written = huffman.write_token_file(make_docs(odd_rows), path, end_id=1)
    got = sorted(huffman.TokenFile(spark, written.path).read().collect(), key=lambda r: r["start"])  # a reader that knows the path only
    want = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for row, (doc_id, text, *_) in zip(got, want, strict=True):
        ids = encode.whole(text or "") + np.uint32(1).tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"], bytes(row["ids"])) == (doc_id, start, len(ids) // 4, ids)
        start += len(ids) // 4


def check_packing(rows, docs, capacity, encode, end):
    """Every id stands once, sequences are gapless and not too long; gives the number of sequences."""
    end = np.uint32(end).tobytes()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text, *_ in docs:
        want[doc_id].append(encode.whole(text or "") + end)
    for doc_id, texts in want.items():
        own = sorted(pieces.pop(doc_id), key=lambda r: r["start"])
        assert sorted(b"".join(sorted(bytes(r["ids"]) for r in own))) == sorted(b"".join(texts))
        if len(texts) == 1:
            assert b"".join(bytes(r["ids"]) for r in own) == texts[0] and [r["piece"] for r in own] == list(range(len(own)))
            assert all(r["length"] == capacity for r in own[1:])
    assert not pieces
    return len(sequences)


def test_packing_places_everything(spark, make_docs, odd_rows):
    path = tokenizer_path(FILES[1])
    rows = packing.pack(make_docs(odd_rows), path, end_id=2, capacity=64).collect()
    n = check_packing(rows, odd_rows, 64, Encoder(path), 2)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 64 + 2
    assert zlib.crc32(bytes(rows[0]["ids"])) is not None


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 30), min_size=1, max_size=120))
def test_plan_is_exact_about_counts_and_no_worse_than_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.make_plan(counts, 30)
    used = defaultdict(list)
    for length, entries in plan.entries.items():
        ends = [e[0] for e in entries[1:]] + [plan.used[length]]
        assert plan.used[length] == counts[length]
        for (rank, per_bin, first, offset), end in zip(entries, ends, strict=True):
            for i in range(end - rank):
                used[first + i // per_bin].append((offset + i % per_bin * length, length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
    assert len(used) == plan.bins <= best_fit_decreasing(lengths, 30) + 1


def test_empty_tables(spark, make_docs):
    empty = make_docs([]).limit(0)
    assert packing.pack(empty, tokenizer_path(FILES[1]), 2).count() == 0
    assert huffman.write_token_file(empty, tokenizer_path(FILES[0]), 1).read().count() == 0
