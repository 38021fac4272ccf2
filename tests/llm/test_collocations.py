"""Mined phrases against plain counting, on odd rows, with groups so small that prefixes are extended, and against the SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomgraph.llm import collocations

SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, f int, depth int"


def plain(rows, least=10, share=50, top=2000):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for m in (1, 2, 3):
                for i in range(len(ws) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, words[lang], -score))
    return sorted(out)


def corpus(n=250):
    r = random.Random(3)
    vocabulary = ["the", "of", "New", "york", "city", "a|b", "é", "日本", "x\x00y", "in", "on", " ", "river", "\x1c"]
    out = []
    for _ in range(n):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " \r"]) for _ in range(r.randint(1, 150)))
        out.append((text, r.choice(["en", "en", "fr", None, "und"])))
    return [*out, (None, "en"), ("", "xx"), ("alone", "yy"), (". , ;", "zz"), *[("New York City new york city", "en")] * 12, ("the of " * 3000, "fr")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("few", [{}, {"group_bytes": 700, "heavy": 40}])
def test_as_plain_counting(spark, rows, few):
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, rows), **few).collect())
    assert got == plain(rows) and len(got) > 50


def test_flushes_within_a_text(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", 97)
    monkeypatch.setattr(collocations, "SLICE", 31)

    corpus, counts = collocations.Corpus(), Counter()

    def take(last):
        words, suffixes = corpus.take(last)
        for lang, three in suffixes.items():
            for a, b, c, n in zip(*(x.tolist() for x in collocations.leaves(*three)), strict=True):
                counts[lang, words[a], words[b] if b else None, words[c] if c else None] += n

    for text, lang in rows:
        for _ in corpus.add(lang or "und", (text or "").encode()):
            take(False)
    take(True)
    want = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)] + [None, None]
            for i in range(len(ws) - 2):
                want[lang or "und", ws[i], ws[i + 1], ws[i + 2]] += 1
    assert counts == want


def test_few_and_top(spark, rows):
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, rows), top=5, least=3, share=80).collect())
    assert got == plain(rows, 3, 80, 5)


def test_sql_has_the_same_rows(spark, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(rows)), "text": [t for t, _ in rows], "lang": [x for _, x in rows]}))
    assert sorted(con.sql(collocations.oracle()).fetchall()) == plain(rows)


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_products(spark):
    """A phrase of 3 * 10**9 occurrences: the squares pass 64 bits."""
    a = 3_000_000_007
    got = spark.sql(f"select (1000000 * (cast({a} as decimal(16, 0)) * cast({a} as decimal(16, 0)))) div (cast({a + 5} as decimal(18, 0)) * cast({a * 3} as decimal(18, 0))) as s").first().s
    assert got == 1_000_000 * a * a // ((a + 5) * a * 3)


def test_leaves_by_key_and_by_order():
    rng = np.random.default_rng(0)
    a, b, c, n = (rng.integers(0, 7, 500) for _ in range(4))
    for counts in (None, n):
        for x, y in zip(collocations.leaves(a, b, c, counts), collocations.leaves(a, b, c, counts, bits=1), strict=True):
            assert (x == y).all()


def test_heavy_prefixes_are_all_found(spark, rows):
    chosen = collocations._chosen(frame(spark, rows), "text", "lang")
    size = sum(len((t or "").encode()) + 1 for t, _ in rows)
    found = collocations.heavy_prefixes(chosen, 60, size // 2 + 1)
    counts = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)]
            counts.update((lang or "und", w) for w in ws)
            counts.update((lang or "und", *w) for w in zip(ws, ws[1:]))
    for (lang, *ws), n in counts.items():
        key = collocations._root(lang)
        for w in ws:
            key = collocations._below(key, collocations._hashes([w]))
        assert n < 60 or key[0] in found
        assert n >= 30 or key[0] not in found
