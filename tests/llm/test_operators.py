"""Each operator on nulls, empty and long texts, ties, repeated rows, extra columns and empty tables, and against brute force."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import fingerprints, gam, langid, licenses, mixing, neardup, packing, pieces, rules, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, size int, x string, row int"
WORDS = "the of and river stone house light green water under seven mountain paper window garden".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))


ROWS = [
    (1, prose(1, 120), "en", "a", 1), (2, prose(1, 120), "en", "a", 2), (3, prose(1, 120).replace("river", "brook", 1), "en", "b", 3), (4, None, None, None, None), (5, "", "en", "a", 0),
    (6, " \n\t ", "en", None, 3), (7, "stone", "en", "b", 5), (8, prose(8, 40_000), "de", "b", 9), (9, 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" ' + prose(9, 30), "en", "a", 7), (None, prose(10, 50), "fr", "c", 1), (1, prose(1, 120), "en", "a", 1),
    (11, "日本語 テキスト 🙂\x00 é", "ja", "c", 3), (12, "Released under the MIT License.\n" + prose(12, 20), "en", "a", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "f", 7, "x", 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ruff(text, size=5):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    out: dict = {}
    width = min(size, len(ws))
    for i in range(len(ws) - width + 1 if ws else 0):
        k = tuple(ws[i : i + width])
        out[k] = out.get(k, 0) + 1
    return out


def brute_similarity(a, b):
    a, b = ruff(a), ruff(b)
    common = sum(min(n, b.get(k, 0)) for k, n in a.items())
    whole = sum(a.values()) + sum(b.values()) - common
    return common / whole if whole else 0.0


def test_similarity_is_weighted_jaccard():
    texts = [prose(1, 80), prose(1, 80) + " " + prose(1, 20), prose(2, 80), "a b a b a b a b a b", "a b a b", "", None]
    sets = neardup.weighted_sets(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(neardup.similarity(sets[i], sets[j]) - brute_similarity(a, b)) < 1e-12


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    u = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    a = (u[:300], rng.integers(1, 6, 300))
    weights = dict(zip(a[0].tolist(), a[1].tolist(), strict=True))
    b = (u[60:], np.array([weights.get(v, 3) for v in u[60:].tolist()]))
    s = neardup.dart_signatures([a, b], 1500)
    assert np.isfinite(s).all() and abs((s[0] == s[1]).mean() - neardup.similarity(a, b)) < 0.05


def test_near_duplicates(docs, empty, spark):
    got = {(r.doc_id, r.class_id, r.class_size) for r in neardup.classes(docs).collect()}
    assert {(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 1), (5, 5, 1), (6, 6, 1), (None, None, None)} <= {(a, b, c if a is not None else None) for a, b, c in got}
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, None, 11, 12]))


def test_fingerprints_that_never_peel_are_told_apart_by_their_sets(spark, monkeypatch):
    rows = [(0, [1, 2, 3], [3, 4]), (1, [], [7]), (2, [5], [5]), (3, list(range(100, 160)), list(range(130, 170)))]
    pairs = spark.createDataFrame(rows, "pair long, a array<long>, b array<long>")
    sized = fingerprints.stored(fingerprints.sized(pairs))
    want = {p: len(set(a) ^ set(b)) for p, a, b in rows}
    digests = {(p, x, 1 if x in a else -1) for p, a, b in rows for x in set(a) ^ set(b)}
    for tries in (0, 1, 16):
        monkeypatch.setattr(fingerprints, "MOST_TRIES", tries)
        got = {r.pair: r.d for r in fingerprints.differences(sized, 3).collect()}
        assert {p: got.get(p) or 0 for p in want} == want
        assert {tuple(r) for r in fingerprints.recovered(pairs, 3).collect()} == digests


def test_fingerprints_leave_no_table_behind(docs, spark, monkeypatch):
    def fails(_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(fingerprints, "_versions", fails)
    with pytest.raises(RuntimeError, match="stopped"):
        fingerprints.fingerprint(docs)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("in_order_")]


def test_links_of_near_duplicates(spark):
    """Every row that isn't alone has a link to its class, of the similarity that brute force finds."""
    r = random.Random(11)
    texts = []
    for g in range(5):
        base = prose(500 + g, 90).split()
        for _ in range(10):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [prose(600, 50), prose(601, 50), prose(601, 50), prose(601, 50), None]
    got = {x.doc_id: x for x in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for i, x in got.items():
        if x.linked_to is None:
            assert x.similarity is None and (x.class_size == 1 or len({texts[j] for j, y in got.items() if y.class_id == x.class_id}) == 1)
        else:
            assert x.linked_to != i and got[x.linked_to].class_id == x.class_id
            assert x.similarity >= 0.8 and abs(x.similarity - brute_similarity(texts[i], texts[x.linked_to])) < 1e-12
    assert got[51].linked_to is None and got[52].linked_to == got[53].linked_to == 51 and got[52].similarity == 1.0


@pytest.mark.parametrize("block_bytes", [512 << 10, 4000])
def test_near_duplicate_groups_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(neardup.links_between, "__defaults__", (block_bytes,))
    r = random.Random(5)
    texts = []
    for g in range(6):
        base = prose(100 + g, 90).split()
        for _ in range(14):  # copies of one base that are not all alike to each other
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [prose(300 + i, 60) for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in neardup.classes(df).collect()}
    label = list(range(len(texts)))
    distinct: dict = {}
    for i, t in enumerate(texts):
        label[i] = label[distinct.setdefault(t, i)]
    for _ in range(len(texts)):
        before = list(label)
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and brute_similarity(texts[i], texts[j]) >= 0.8:
                    low, high = sorted((label[i], label[j]))
                    label = [low if v == high else v for v in label]
        if before == label:
            break
    assert got == dict(enumerate(label))


def test_pieces_match_the_library():
    import sentencepiece

    p = pieces.pieces(pieces.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(3)
    alphabet = "abcdefghij ▁\n\t.,<>=()ABCéüñ0123456789日本🙂\x00　  "
    texts = [t[1] or "" for t in ROWS] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(500)] + ["<0x0A> </s> <s>", "a" * 5000, " " * 40]
    for t in texts:
        assert p.encode(t, end=False) == library.encode(t)
        assert p.decode(library.encode(t)) == library.decode(library.encode(t))
    for _ in range(500):
        ids = [r.choice([r.randrange(3, 259), r.randrange(0, 32000), r.randrange(0, 5)]) for _ in range(r.randint(0, 12))]
        assert p.decode(ids) == library.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pieces_on_any_text(text):
    import sentencepiece

    text = text.encode("utf-8", "ignore").decode()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert pieces.pieces(pieces.default_model()).encode(text, end=False) == library.encode(text)


def test_piece_columns(docs, empty):
    p = pieces.pieces(pieces.default_model())
    got = pieces.digests(docs).collect()
    assert len(got) == len(ROWS) and pieces.digests(empty).count() == 0
    for r, row in zip(ROWS, got, strict=True):
        ids = p.encode(r[1])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(p.decode(ids).encode()).hexdigest()
    both = pieces.decode(pieces.encode(docs, into="x"), "x", "back").collect()
    assert all((r.back or "") == (r.text or "") for r in both)


def test_language(docs, empty, spark):
    rows = [(i, f"der die das und nicht schön straße {i % 5}" if i % 2 else f"the and of with this that {i % 5}", "de" if i % 2 else "en") for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None, "en"), (301, "12 34", "de"), (302, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (300, 301, 302))
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs.withColumn("identified", docs.x))
    assert kept.columns[:5] == docs.columns[:5] and not {4, 5, 6} & {r.doc_id for r in kept.collect()}


def test_ngrams_against_brute_force():
    texts = ["Ab c", "", "é", "12"]
    buckets, bounds = langid.grams(texts)
    alone = [langid.grams([t])[0] for t in texts]
    assert all(sorted(buckets[a:b]) == sorted(x) for a, b, x in zip(bounds[:-1], bounds[1:], alone, strict=True))
    assert [b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [2 * len(p) - 3 for p in (" ab c ", "  ", " é ", "  ")]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size for r in got) and mixing.mix(empty).count() == 0
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    again = mixing.resample(docs)
    assert again.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in again.collect()) == sum(r.taken for r in got)


def test_mixing_reaches_its_targets(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, "w " * r.randint(1, 200), "s" + str(min(3, i % 9))) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.sample(df).collect()
    by: dict = {}
    for x in rows:
        by.setdefault(x.source, [x.target, 0])[1] += x.taken
    assert all(abs(taken - target) <= 0.01 * target + 200 for target, taken in by.values())
    sizes = sum(x.size for x in rows)
    assert abs(sum(t for t, _ in by.values()) - 1.5 * sizes) < 1e-6 * sizes


def brute_repeats(ws):
    seen: dict = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    return len({p + k for v in seen.values() if len(v) > 1 for p in v for k in range(5)})


def test_rules(docs, empty, spark):
    texts = [r[1] for r in ROWS] + ["a b c d e a b c d e", "a a a a a a a", "x\nx\nx\n#%\n", "one two three four five", "p q r s t u p q r s t u v"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for t, r in zip(texts, rules.judge(df).collect(), strict=True):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeats = brute_repeats(ws)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeats)
        assert r.base_failed == (len(ws) < 10 or 100 * repeats > 20 * len(ws)) and not (r.kept and r.base_failed)
    assert rules.judge(empty).count() == 0 and rules.judge(docs).count() == len(ROWS)


def test_classifier(spark, docs, empty):
    rows = [(i, prose(i, 60) if i % 3 else "!! ".join(prose(i, 60).upper().split())) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(400)] + [(5, None)], "doc_id long, quality int")
    got = gam.score(df, labels).collect()
    assert all(r.predicted == int(bool(r.doc_id % 3)) for r in got if r.held_out) and all(0 <= r.score <= 1 for r in got)
    assert len(gam.score(docs, labels).collect()) == len(ROWS)
    assert gam.score(empty, labels).count() == 0 and {r.score for r in gam.score(df.limit(3), labels.limit(0)).collect()} == {0.5}


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_secrets(docs, empty):
    got = {r.doc_id: r for r in secrets.findings(docs).collect() if r.doc_id is not None}
    assert got[9].n_secrets == 1 and got[9].starts == [9] and got[9].ends == [49] and got[4].n_candidates == 0
    assert sum(r.n_secrets for r in got.values()) == 1 and secrets.findings(empty).count() == 0
    clean = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert clean[9].text.startswith('token = "[REDACTED]" ') and clean[9].n_chars == len(clean[9].text) and clean[4].text is None and clean[8].text == ROWS[7][1]


@pytest.mark.parametrize("value", ["9233a8ecf7c5b09fe5949719b6b82bc439e9329b", "hT7kQ2mXz9RvLp4WsNc8YbGd3FjA", "hunter2xyz99"])
@pytest.mark.parametrize("form", ["API_TOKEN={}", "password={} ok", "password:{}", "url: token={}", '{{"password":"{}"}}', '{{"api_key": "{}", "x": 1}}', "https://x.org/a?token={}&id=5", "export SECRET_KEY='{}'", "auth: token={}"])
def test_assigned_secrets(form, value):
    text = form.format(value)
    ((a, b),) = secrets.candidates(text)
    score = secrets.default_forest().score(np.array([secrets.measure(text[a:b], text[:a], text[b:])], np.float64))
    assert text[a:b] == value and score[0] >= secrets.THRESHOLD


def test_long_candidates_are_measured_whole():
    at = secrets.MEASURES.index("digit_share")
    assert secrets.measure("a" * 5000 + "1" * 5000, "", "")[at] == 0.5


def test_spans_of_runs():
    of = lambda t: [t[a:b] for a, b in secrets.candidates(t)]
    assert of("sha256:9233a8ecf7c5b09f id=12345678901234567") == ["9233a8ecf7c5b09f", "12345678901234567"] and of("abc123:def456:ghi789") == ["abc123:def456:ghi789"]
    assert of("abcd1234efgh5678abcd==") == ["abcd1234efgh5678abcd=="] and of("a" * 20 + "1://x token=abcdefgh") == ["a" * 20 + "1://x", "abcdefgh"]


def test_forest_on_other_findings():
    f, found = secrets.default_forest(), secrets.default_findings(60, 99)
    score = f.score(np.array([secrets.measure(*x[:3]) for x in found], np.float64))
    assert ((score >= 0.5) == np.array([x[3] for x in found])).mean() > 0.98


def test_more_licenses(spark):
    bsd = licenses.MORE_TEXTS[0][1]
    rows = [(1, "Copyright (c) Acme Inc.\n\n" + bsd), (2, "© The Authors\n" + licenses.TEXTS[0][1]), (3, '# Licensed under the Apache License, Version 2.0 (the "License");\n# x'), (4, "Be kind to\nall.  Copyright notice\nkept"), (5, "x\nbe kind, please")]
    path = "/usr/share/common-licenses/Apache-2.0"
    if os.path.exists(path):
        rows.append((6, open(path).read().replace("[yyyy] [name of copyright owner]", "2020 A. Person")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[1].text_license == "BSD-3-Clause" and got[2].text_license == "MIT" and got[3].notices == "Apache-2.0" and got[4].text_license is None
    assert 6 not in got or got[6].text_license == "Apache-2.0"
    own = lambda *r: spark.createDataFrame(r, "license string, text string")
    got = {r.doc_id: r for r in licenses.scan(df, texts=own(("Kind", "be kind to all copyright notice kept")), notices=own(("Kind", "Be kind, please."))).collect()}
    assert got[4].text_license == "Kind" and got[5].notices == "Kind" and got[5].n_notices == 1 and got[1].text_license is None and got[3].notices == ""


def test_licenses(spark, docs, empty):
    name, text = licenses.TEXTS[0]
    other = "MIT LICENCE\n\nCopyright (c) 2021 Somebody Ltd.\n\n" + text.split("\n", 1)[1].upper().replace('"', "'")
    df = spark.createDataFrame([(1, text), (2, other), (3, None), (4, text + " more")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[1].digest == got[2].digest and got[1].text_license == got[2].text_license == "MIT" and got[3].text_license is None and got[4].text_license is None
    assert {r.doc_id: r.notices for r in licenses.scan(docs).collect()}[12] == "MIT" and licenses.scan(empty).count() == 0


def naive_best_fit(sizes, length):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        open_ = [(r, k) for k, r in enumerate(room) if r >= sizes[i]]
        if open_:
            k = min(open_)[1]
            rows[k].append(i)
            room[k] -= sizes[i]
        else:
            rows.append([i])
            room.append(length - sizes[i])
    return rows


def test_best_fit_against_brute_force():
    for seed in range(150):
        r = random.Random(seed)
        length = r.choice([7, 16, 31, 50])
        z = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        room = lambda rows: sorted(length - sum(z[i] for i in x) for x in rows)  # noqa: B023, E731
        assert room(packing.best_fit(z, length)) == room(naive_best_fit(z, length))


def test_packing_is_lossless(docs, empty):
    rows = packing.pack(docs, 64, shard_bytes=20_000).collect()
    got: dict = {}
    for r in rows:
        ids, positions = packing.matrix([r.ids], 64)[0], packing.matrix([r.positions], 64)[0]
        for j, (doc, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            a, b = r.cu_seqlens[j], r.cu_seqlens[j + 1]
            assert positions[a:b].tolist() == list(range(b - a))
            got.setdefault((doc, piece), []).append(ids[a:b].tolist())
    e = packing.encoder(packing.default_ranks())
    for doc, text, *_ in ROWS:
        whole, k = e.encode_ordinary(text or "") + [packing.END], 0
        while whole:
            assert whole[:64] in got[doc, k]
            whole, k = whole[64:], k + 1
    assert packing.pack(empty).count() == 0


def paragraphs(text):
    return {p for p in re.sub(r"([^ \n]+(?: +[^ \n]+){0,15} *)", "\\1\n", text or "").split("\n") if p}


def test_recovered_digests_against_brute_force(spark):
    r = random.Random(2)
    pairs = []
    for i, (shared, only_a, only_b) in enumerate([(0, 0, 0), (50, 1, 0), (3, 0, 9), (400, 120, 3), (0, 300, 280), (5, 2, 2)]):
        common = [r.randrange(-(2**63), 2**63) for _ in range(shared)]
        pairs.append((i, common + [r.randrange(-(2**63), 2**63) for _ in range(only_a)], [r.randrange(-(2**63), 2**63) for _ in range(only_b)] + common))
    df = spark.createDataFrame(pairs, "pair long, a array<long>, b array<long>")
    got = {(x.pair, x.digest, x.side) for x in fingerprints.recovered(df, 3).collect()}
    assert got == {(i, x, 1) for i, a, b in pairs for x in set(a) - set(b)} | {(i, x, -1) for i, a, b in pairs for x in set(b) - set(a)}


@pytest.mark.parametrize("task_bytes", [1 << 24, 3000])
def test_fingerprints_against_brute_force(spark, empty, monkeypatch, task_bytes):
    monkeypatch.setattr(fingerprints, "TASK_BYTES", task_bytes)
    rows = [(i, t) for i, t in enumerate([prose(1, 300), prose(1, 300), "", None, "one", prose(2, 40) + "\n" + prose(3, 40), prose(4, 3000), "日本🙂" * 9, " \n ", prose(5, 90)])]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    back = rows[::-1]
    for k, (i, t) in enumerate(back):
        t, following = t or "", back[(k + 1) % len(back)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(paragraphs(t), paragraphs(edited))) < 1e-12 and abs(r.near_next - like(paragraphs(t), paragraphs(following))) < 1e-12
    assert got[0].fingerprint == got[1].fingerprint and len({r.fingerprint for r in got.values()}) == 8
    assert fingerprints.fingerprint(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (1, "c d", "k"), (None, "c", "k"), (None, "c", None), (2, None, "k")], "doc_id long, text string, body string")
    assert fingerprints.fingerprint(odd).count() == 6
