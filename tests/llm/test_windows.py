"""Packed windows against the library's ids, lossless and full, and the differencing on small sets."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import windows

SCHEMA = "doc_id long, text string, ids string, shard int, start int"
TEXTS = [None, "", "Word", "It's 42 isn't", "Éá 日本 🙂🙂\x00\x1cx y  z", "<|endoftext|> and<|startoftext|>x", "tab\tline\nfeed\x0bv\x0cf\rr", "x" * 5000, "A.B,c;d!!"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9))) + r.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(library, text):
    return (library.encode(text, add_special_tokens=False).ids if text else []) + [1]


@pytest.fixture(scope="module")
def rows():
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(100 + i, prose(i, 50 + i * 7 % 700)) for i in range(150)]
    return rows + [(None, "no id"), (7, "same id"), (8, prose(1, 80)), (8, prose(1, 80)), (9, prose(2, 30_000))]


def test_whole_and_full(spark, library, rows):
    docs = spark.createDataFrame([(*r, "i", 3, 4) for r in rows], SCHEMA).repartition(3)
    got = windows.pack(docs).collect()
    whole, held = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        whole[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        held[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc_id, text in rows:
        ids = plain(library, text)
        want[doc_id, len(ids)].append(ids)
    assert whole.keys() == want.keys()
    for key, pieces in whole.items():
        texts = sorted(want[key])
        assert sorted(x for _, p in pieces for x in p) == sorted(x for t in texts for x in t)
        if len(texts) == 1:
            at, joined = 0, []
            for start, piece in sorted(pieces):
                assert start == at
                at += len(piece)
                joined += piece
            assert joined == texts[0]
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(plain(library, t)) for _, t in rows)
    assert len(held) <= -(-total // 2048) + 1 + len(held) // 100


def test_digests_and_sequences(spark, rows):
    docs = spark.createDataFrame([(*r, "i", 3, 4) for r in rows[:60]], SCHEMA)
    packed = windows.pack(docs)
    key = lambda r: (r[5], r[6])
    got = sorted((tuple(r) for r in windows.digests(docs).collect()), key=key)
    want = sorted(((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in packed.collect()), key=key)
    assert got == want
    for s in windows.sequences(packed).collect():
        ids = np.frombuffer(s.ids, "<u4")
        assert len(ids) == 2048 and (ids[s.n_tokens :] == 1).all() and s.cu_seqlens[0] == 0 and s.cu_seqlens[-1] == s.n_tokens
        for r in (r for r in packed.collect() if r.sequence_id == s.sequence_id):
            assert ids[r.offset : r.offset + r.length].tobytes() == r.ids


def test_empty_table_and_text_ids(spark):
    assert windows.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    got = windows.digests(spark.createDataFrame([("a", None, 1)], "doc_id string, text string, place int")).collect()
    assert [tuple(r) for r in got] == [("a", 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0, 0)]


def test_ids_of_the_tables_texts(library):
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += ["H\u0331 H \u0331 École, ÉCOLE. été!? Straße; ÿ× ß, <|ENDOFTEXT|> <|endoftext|>, don't DON'T a,b ,c."]
    got, bounds = windows.words(windows.default_vocabulary()).encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert got[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAéÉHÀß×÷̱́̈ \t\n\r\x0b\x0c\x1c\x85 'sST19.,<|>Σσςß"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_the_librarys(text):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not hasattr(windows, "_for_tests") else windows._for_tests
    windows._for_tests = library
    got, bounds = windows.words(windows.default_vocabulary()).encode(pa.array([None, text, ""]))
    assert bounds.tolist() == [0, 0, len(got), len(got)] and got.tolist() == library.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 9))
def test_differencing_is_a_partition(sizes, k):
    found = windows.differencing(sizes, k)
    assert len(found) <= k and sorted(i for _, m in found for i in m) == list(range(len(sizes)))
    assert all(total == sum(sizes[i] for i in m) for total, m in found)


def test_differencing_as_told():
    # the two-way example of the method: 8, 7, 6, 5, 4 differ by 2 at the end
    assert sorted(t for t, _ in windows.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert sorted(t for t, _ in windows.differencing([1] * 12, 4)) == [3, 3, 3, 3]


def test_windows_rise_and_pieces_are_cut_finer():
    assert windows.windows([7, 7, 7], 10) == [[0], [1], [2]] or len(windows.windows([7, 7, 7], 10)) == 3
    assert windows.windows([7, 7, 7], 10, most=2) is None
    same = windows.packed([410] * 1000, 2048)  # five pieces of 410 are just above a window
    assert all(sum(n for *_, n in w) <= 2048 for w in same) and len(same) <= 410_000 / 2048 * 1.03
    assert sorted((i, at) for w in same for i, at, _ in w)[0] == (0, 0) and sum(n for w in same for *_, n in w) == 410_000
    assert windows.packed([], 2048) == []
