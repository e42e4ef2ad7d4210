import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewise.llm.packing import WordBpe, balanced, pack, windows_of
from tidewise.llm.tokens import ByteBpe, count_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "a  b", "a \n b", "\n\n", "  x", " \t\ny", "I'm don't 'S", "é́é", "<|endoftext|>ab<|endoftext|> c", "x<|startoftext|>y", "\x1c a\x1cb\x1c", "ΣΑΣ Σ", "İstanbul", "日本語 テスト１２３", "🙂🙂 a", "\x00b",
    "a b c", "'ll've", "12345 678", "_a_b", "՘x ࢏", "ﬁ ǅ", " ̈", "½² µ ß", "a\x85b", "word.\x1d", "don't! can't,", "A" * 300, "ab\rcd\x0bef\x0cgh", " x y",
]


def test_counts_and_ids_are_the_librarys():
    b, w = ByteBpe(BYTE, {" the": 1}), WordBpe(WORD)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    assert b.exact and w.exact
    rng = random.Random(0)
    for t in ODD + ["".join(rng.choice(ODD) + rng.choice(["", " ", "\n", "x", "1"]) for _ in range(8)) for _ in range(300)]:
        assert b.count(t) == len(byte.encode(t, add_special_tokens=False).ids), repr(t)
        assert w.text(t) == np.array(word.encode(t, add_special_tokens=False).ids, np.uint32).tobytes(), repr(t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    b, w = CACHED
    assert b.count(text) == b.count_by_library(text)
    assert w.text(text) == np.array(w.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


CACHED = (ByteBpe(BYTE, {}), WordBpe(WORD))


def test_count_query_edges(spark):
    rows = [(1, None), (2, ""), (3, "one two  three\n"), (3, "one two  three\n"), (None, "x" * 50_000), (4, "a b " * 2000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    byte = Tokenizer.from_file(BYTE)
    want = []
    for i, t in rows:
        n = len(byte.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(tuple, count_tokens(docs, BYTE).collect()), key=str) == sorted(want, key=str)
    assert count_tokens(docs.where("false"), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 9))
def test_differencing_keeps_every_item_and_balances(lengths, m):
    found = balanced(lengths, m)
    assert sorted(i for w in found for i in w) == list(range(len(lengths))) and len(found) == m
    sums = [sum(lengths[i] for i in w) for w in found]
    assert max(sums) - min(sums) <= max(lengths)


def plain_differencing(lengths, m):
    """Sums of the windows, by whole vectors of m sums; the earlier of equal spreads first."""
    parts = [(sorted([n, *[0] * (m - 1)], reverse=True), t) for t, n in enumerate(sorted(lengths, reverse=True))]
    tick = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[0][-1] - p[0][0], p[1]))
        (a, _), (b, _), *parts = parts
        parts.append((sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), tick))
        tick += 1
    return parts[0][0] if parts else [0] * m


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40) | st.integers(1, 2048), max_size=40), st.integers(1, 9))
def test_differencing_is_karmarkar_karps(lengths, m):
    assert sorted((sum(lengths[i] for i in w) for w in balanced(lengths, m)), reverse=True) == plain_differencing(lengths, m)
    assert sorted(sum(([100, 10, 9, 8][i] for i in w), 0) for w in balanced([100, 10, 9, 8], 2)) == [27, 100]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=60))
def test_the_count_rises_until_no_window_exceeds_the_capacity(lengths):
    found = windows_of(lengths, 2048)
    assert sorted(i for w in found for i in w) == list(range(len(lengths))) and all(sum(lengths[i] for i in w) <= 2048 for w in found)
    least = -(-sum(lengths) // 2048)
    assert all(max(plain_differencing(lengths, m)) > 2048 for m in range(max(1, least), len(found)))


def test_windows_are_as_few_as_the_sum_needs():
    assert windows_of([], 10) == [] and len(windows_of([5, 5, 5, 5], 10)) == 2


def test_pack_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta9", "é"]) for _ in range(rng.choice([0, 1, 5, 300, 700, 5000])))) for i in range(150)] + [(150, None), (150, None), (None, "tail here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").coalesce(2)
    word = Tokenizer.from_file(WORD)
    pieces = pack(docs, WORD, group_size=64).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for i, t in rows:
        ids = np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        own = sorted(by_doc[i], key=lambda p: p.start)
        if i == 150:
            assert [(p.start, p.length, p.doc_tokens) for p in own] == [(0, 1, 1)] * 2
            continue
        at = 0
        for p in own:
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fill = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        fill += at
    assert len(by_seq) <= 1.02 * fill / 2048 + 2  # each of two tasks may end with a window that is not full
    assert pack(docs.where("false"), WORD).count() == 0
