"""Fill-in-middle against plain Python strings, on odd rows, and back again."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import infill

SCHEMA = "doc_id long, text string, n int, form string, output string"
TEXTS = [None, "", "a", "é", "plain ascii text " * 40, "日本語 🙂 mixed é\x00text\n" * 30, "holds <P> here", "x<S>", "<M>", "a<b>P><", "🙂" * 999, "<", "P>" * 9]


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", x, y - x, f"<S>{t[y:]}<P>{t[:x]}<M>{t[x:y]}")
    return (doc_id, n, "psm", x, y - x, f"<P>{t[:x]}<S>{t[y:]}<M>{t[x:y]}")


@pytest.fixture(scope="module")
def rows():
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(None, "no id"), (None, None), (4, "same id"), (4, "same id")]
    return rows + [(1000, "long é text " * 100_000), (-7, "negative")]


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def test_as_plain_strings(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "f", "o") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in infill.transform(docs).collect()]
    want = [plain(*r) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {f for *_, f, _, _, _ in got} == {"plain", "psm", "spm"}


def test_digests_and_the_way_back(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "f", "o") for r in rows], SCHEMA)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in infill.digests(docs).collect()), key=key)
    want = sorted(((*plain(*r)[:5], sha(plain(*r)[5]), sha(r[1] or "")) for r in rows), key=key)
    assert got == want


def test_sql_has_the_same_rows(spark, rows):
    import pandas as pd

    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(infill.oracle()).fetchall()
    docs = spark.createDataFrame([(*r, 1, "f", "o") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in infill.digests(docs).collect()), key=key) == sorted(want, key=key)


def test_empty_table_and_text_ids(spark):
    assert infill.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    got = infill.transform(spark.createDataFrame([("a1", "some text", 3)], "doc_id string, text string, x int")).collect()
    assert [tuple(r) for r in got] == [plain("a1", "some text")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_index_of_exceptions(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    index = infill.Exceptions(data)
    assert np.diff(index.points(bounds)).tolist() == [len(t) for t in texts]
    whole = "".join(texts)
    every = np.arange(len(whole) + 1)
    assert index.bytes(every).tolist() == [len(whole[:i].encode()) for i in every]
    assert len(index.bytes_at) == sum(ord(c) > 127 for c in whole)
