"""The learned operators, near duplicates and the pipeline against plain versions of their own, and on odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import fingerprints, gam, langid, licenses, mixing, neardup, packing, pieces, rules, secrets

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone house light green water under seven mountain paper window garden".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))


def table(sf, name):
    return pq.read_table(f"{DATA}/{sf}/{name}.parquet").to_pylist()


def ruff(text, size=5):
    ws = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    ws = [w for w in ws if w]
    width = min(size, len(ws))
    return Counter(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)) if ws else Counter()


def alike(a, b):
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    whole = a.total() + b.total() - common
    return common / whole if whole else 0.0


def linked_pairs(texts, least):
    """All pairs of texts with a similarity of least or more, by an inverted index over all shingles."""
    sets, holders = [ruff(t) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            holders[k].append(i)
    out = {}
    for i, s in enumerate(sets):
        common = Counter()
        for k, n in s.items():
            for j in holders[k]:
                if j < i:
                    common[j] += min(n, sets[j][k])
        for j, c in common.items():
            if c >= least * (s.total() + sets[j].total() - c):
                out[j, i] = c / (s.total() + sets[j].total() - c)
    return out


def links_of_sets(texts, least):
    """The same for texts that hold no shingle twice, by one matrix product."""
    sets = [ruff(t) for t in texts]
    assert all(n == 1 for s in sets for n in s.values())
    at = {k: i for i, k in enumerate({k for s in sets for k in s})}
    held = np.zeros((len(texts), len(at)), np.float32)
    for i, s in enumerate(sets):
        held[i, [at[k] for k in s]] = 1
    common, size = held @ held.T, held.sum(1)
    return [(int(i), int(j)) for i, j in np.argwhere(np.triu(common >= least * (size[:, None] + size[None, :] - common), 1))]


# -- near duplicates


def class_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in neardup.classes(df).collect()}


def test_all_links_of_a_table_are_found(spark):
    docs = [d for d in table("sf0.01", "documents")]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect()}
    links = linked_pairs([d["text"] for d in docs], 0.8)
    assert len(links) > 50
    assert all(got[docs[i]["doc_id"]] == got[docs[j]["doc_id"]] for i, j in links)
    label = list(range(len(docs)))
    for _ in range(20):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert len(set(label)) == len(set(got.values()))  # nothing else is joined


@pytest.mark.parametrize("block_bytes", [512 << 10, 4000])
def test_a_large_group_near_the_threshold(spark, monkeypatch, block_bytes):
    """2,000 copies of one text, changed so that most pairs are at 0.65 to 0.8: every link, no other, in one or many blocks."""
    monkeypatch.setattr(neardup.links_between, "__defaults__", (block_bytes,))
    n = 2000 if block_bytes > 10_000 else 300
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for at in r.sample(range(150), r.randint(1, 5)):
            copy[at] = f"x{r.randrange(10**7)}"
        texts.append(" ".join(copy))
    got = class_of(spark, texts)
    links = links_of_sets(texts, 0.8)
    assert len(links) > n and all(got[i] == got[j] for i, j in links)
    touched = {x for pair in links for x in pair}
    assert len(touched) < n and all(got[i] == i for i in range(n) if i not in touched)


def test_bounds_keep_every_node_with_a_link(spark):
    r = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(r.randint(20, 120))]
        for _ in range(8):
            copy = list(base) + ["tail"] * r.randint(0, 12)
            for at in r.sample(range(len(base)), r.randint(0, 5)):
                copy[at] = f"x{r.randrange(40)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    sets = neardup.gram_sets(df)
    sets = neardup.stored(sets)
    members = spark.createDataFrame([(0, i, i) for i in range(len(texts))], "bucket long, node long, component long")
    kept = {x.node for x in neardup.may_link(members, sets, 0.8).collect()}
    assert {x for pair in linked_pairs(texts, 0.8) for x in pair} <= kept
    got = {(x.a, x.b) for x in neardup.links_between(members, sets, 0.8, 3000).collect()}
    assert got == set(linked_pairs(texts, 0.8))
    alone = {x.node: x.alone for x in neardup.unshared(sets, 2000).collect()}
    seen = Counter(k for t in texts for k in ruff(t))
    for i, t in enumerate(texts):
        assert alone.get(i, 0) == sum(n for k, n in ruff(t).items() if seen[k] == 1)


def test_buckets_with_blocks_of_their_own_lose_nothing(spark):
    """Many homes meet in one bucket: it is dealt to its own blocks, and every pair still meets."""
    rows = [(0, i) for i in range(60)] + [(1 + i, j) for i in range(60) for j in (i, *range(1000 + 70 * i, 1070 + 70 * i))]
    members = spark.createDataFrame([(b, n, n) for b, n in rows], "bucket long, node long, component long")
    nodes = sorted({n for _, n in rows})
    sets = spark.createDataFrame([(n, 5, b"x" * 80, b"y" * 40) for n in nodes], "node long, size long, grams binary, counts binary")
    placed = neardup.dealt(members, sets, 400).collect()
    homes = {(x.bucket, x.block) for x in placed if x.bucket == 0}
    assert {(x.bucket, x.node) for x in placed} == set(rows) and len(homes) < 60


def test_rows_of_one_id_with_different_texts_stay(spark):
    rows = [(1, prose(1, 80), "en", "a", 1), (1, prose(2, 80), "en", "a", 2), (1, prose(3, 80), "de", "b", 3), (2, prose(3, 80), "en", "a", 4), (None, prose(2, 80), "en", "c", 5), (None, prose(9, 70), "en", "c", 6), (None, prose(9, 70), "en", "d", 7), (3, prose(4, 60), "en", "a", 8), (3, prose(4, 60), "fr", "a", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted((r.n_chars, r.doc_id) for r in neardup.keep_first(docs.repartition(3)).collect())
    assert [k for k, _ in kept if k < 6] == [1, 2, 3] and len(kept) == 5
    sizes = sorted((r.class_id is None, r.class_id or 0, r.class_size) for r in neardup.classes(docs).collect())
    assert sizes.count((False, 1, 2)) == 4 and sizes.count((True, 0, 2)) == 2 and sizes.count((False, 3, 2)) == 2


def test_names_that_clash_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, 1, [1]), (2, 7, 2, [2]), (3, 7, 2, [2]), (4, 8, 1, [1]), (5, None, 0, [0])], "doc_id long, name long, other long, bands array<long>")
    got = {r.doc_id: r.node for r in neardup.named(rows).collect()}
    assert got[1] != got[2] == got[3] and got[4] == 8 and got[5] is None


# -- quality classifier


def naive_score(model, row):
    total = model.intercept
    for f, (edges, values) in enumerate(zip(model.edges, model.tables, strict=True)):
        total += values[sum(e <= row[f] for e in edges)]
    for (a, b), values in zip(model.pairs, model.pair_tables, strict=True):
        total += values[sum(e <= row[a] for e in model.pair_edges[a])][sum(e <= row[b] for e in model.pair_edges[b])]
    return 1 / (1 + math.exp(-total))


def naive_tree(xs, g, h, bins, cuts):
    """Leaf value of each bin: the best cut of all leaves, again and again, from sums taken afresh each time."""
    leaves = [(0, bins)]
    sums = lambda a, b: (sum(y for x, y in zip(xs, g, strict=True) if a <= x < b), sum(y for x, y in zip(xs, h, strict=True) if a <= x < b))
    worth = lambda a, b: (lambda s, t: s * s / (t + 1))(*sums(a, b))
    for _ in range(cuts):
        gains = [(worth(a, c) + worth(c, b) - worth(a, b), -i, a, c, b) for i, (a, b) in enumerate(leaves) for c in range(a + 1, b)]
        if not gains or max(gains)[0] <= 1e-9:
            break
        _, _, a, c, b = max(gains)
        leaves.remove((a, b))
        leaves += [(a, c), (c, b)]
    out = [0.0] * bins
    for a, b in leaves:
        s, t = sums(a, b)
        out[a:b] = [s / (t + 1)] * (b - a)
    return out


def test_scores_against_naive_tables():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=600) > 0).astype(float)
    model = gam.fit(x, y)
    assert np.allclose(model.score(x[:80]), [naive_score(model, row) for row in x[:80]], atol=1e-12)


def test_first_cycle_against_a_naive_booster(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0.2).astype(float)
    monkeypatch.setattr(gam, "ROUNDS", 2)
    monkeypatch.setattr(gam, "PAIR_ROUNDS", 0)
    model = gam.fit(x, y)
    share = (y.sum() + 1) / (len(y) + 2)
    total = np.full(len(y), math.log(share / (1 - share)))
    tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(2):
        for f, edges in enumerate(model.edges):
            bins = [int(sum(e <= v for e in edges)) for v in x[:, f]]
            p = 1 / (1 + np.exp(-total))
            step = np.array(naive_tree(bins, y - p, p * (1 - p), len(edges) + 1, gam.CUTS)) * gam.RATE
            tables[f] += step
            total += step[bins]
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(tables, model.tables, strict=True))


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = gam.score(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(found) > 30 and sum(r.predicted == r.quality for r in found) / len(found) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


# -- secrets


def naive_walk(forest, row):
    total = 0.0
    for feature, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
        at = 0
        while feature[at] >= 0:
            at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
        total += value[at]
    return total / len(forest.feature)


def test_forest_against_a_naive_walk():
    f = secrets.default_forest()
    x = np.array([secrets.measure(*found[:3]) for found in secrets.default_findings(20, 5)], np.float64)
    assert np.allclose(f.score(x), [naive_walk(f, row) for row in x], atol=1e-12)


@pytest.fixture(scope="module")
def detector(spark):
    words = secrets.dictionary_of(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    forest = secrets.default_forest(words)

    def found(text):
        spans = secrets.candidates(text)
        if not spans:
            return []
        x = np.array([secrets.measure(text[a:b], text[max(0, a - secrets.AROUND) : a], text[b : b + secrets.AROUND], words) for a, b in spans], np.float64)
        return [text[a:b] for (a, b), s in zip(spans, forest.score(x), strict=True) if s >= secrets.THRESHOLD]

    return found


@pytest.mark.parametrize("text", [
    "see https://example.org/articles/2021/03/some-long-title-with-words-12345.html for more", "version 2024.10.31-build4711 of the river-stone-house-release",
    "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b fixes it", "order 4111111111111111 was shipped", "id 3f2504e0-4f89-11d3-9a0c-0305e82c3301 in the list",
    "/usr/local/share/doc/river2stone/house3light/readme1.txt", "thequickbrownfoxjumpsoverthelazydog2", "2021-03-04T10:20:30 2021-03-05T10:20:31", "ISBN 978-3-16-148410-0-2021-4711",
])
def test_look_alikes_are_left_alone(detector, text):
    assert detector(text) == []


@pytest.mark.parametrize("secret", ["AKIA" + "Q7ZT3M5XW2KJ9PLD", "ghp_" + "a8Kd93jFq0ZmXw7Rt5Yb2Nc6Vh1Lp4Gs8QeU", "sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc"])
def test_known_forms_are_found(detector, secret):
    assert detector(f"text before {secret} and after") == [secret]


def test_dictionary_counts_documents(spark, monkeypatch):
    rows = ["brook brook brook valley", "brook Valley meadow", "meadow1 valley", None, "", "forest_hill café"]
    got = secrets.dictionary_of(spark.createDataFrame([(t,) for t in rows], "text string"), most=2)
    assert set(got) - set(secrets.DICTIONARY) == {"brook", "valley"}
    assert secrets.covered_chars("xxbrookvalley1", got) == 11


def test_dictionary_is_the_same_rule_at_every_size(spark):
    """A word of 2 in 30,000 documents is in, as long as there is room."""
    docs = spark.range(30_000).selectExpr("case when id in (7, 20000) then 'common rarest' when id = 9 then 'common once' else 'common' end as text")
    assert {"common", "rarest", "once"} <= set(secrets.dictionary_of(docs))
    assert "once" not in secrets.dictionary_of(docs, most=2)


def test_planted_secrets_of_the_tables(spark):
    """Assigned tokens are the tables' secrets: every one is found, in every document, and little else is."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    planted = {(i, m) for i, t in texts.items() for m in re.findall(r'token = "([0-9a-f]{40})"', t)}
    found = {(r.doc_id, texts[r.doc_id][a:b]) for r in secrets.findings(docs).collect() for a, b in zip(r.starts or [], r.ends or [], strict=True)}
    recall, precision = len(planted & found) / len(planted), len(planted & found) / len(found)
    assert len(planted) > 5 and recall == 1.0 and precision >= 0.9


def test_unclosed_key_blocks_take_linear_time():
    assert not [x for x in secrets.candidates("-----BEGIN PRIVATE KEY-----\n" * 20_000) if x[1] - x[0] > 100]
    block = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert [(a, b) for a, b in secrets.candidates("x " + block + " y")] == [(2, 2 + len(block))]


# -- language


def naive_bayes(train, text):
    """Log likelihoods from dictionaries of counts, one n-gram at a time."""
    def buckets(t):
        p = langid.plain(t)
        return [int(b) for n in langid.ORDERS for i in range(len(p) - n + 1) for b in langid._hashed(langid._codes(p[i : i + n]), n)]

    counts, docs = defaultdict(Counter), Counter()
    for t, lang in train:
        counts[lang].update(buckets(t))
        docs[lang] += 1
    out = {}
    for lang in sorted(docs):
        whole = counts[lang].total() + langid.SMOOTHING * langid.BUCKETS
        prior = (docs[lang] + 1) / (docs.total() + len(docs))
        out[lang] = math.log(prior) + sum(math.log((counts[lang][b] + langid.SMOOTHING) / whole) for b in buckets(text))
    top = max(out.values())
    shares = {k: math.exp(v - top) for k, v in out.items()}
    return {k: v / sum(shares.values()) for k, v in shares.items()}


def test_language_against_naive_counts(spark):
    r = random.Random(1)
    said = {"en": "the and of with this that river".split(), "de": "der die und nicht schön straße".split(), "fr": "les des une été pour avec".split()}
    train = [(" ".join(r.choice(said[k]) for _ in range(6)), k) for k in said for _ in range(20 if k == "en" else 5)]
    model = langid.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id long, text string, lang string"))
    texts = ["the", "un de", "straße river", "zzz qq", "é"]
    best, score = model.score(texts)
    for t, b, s in zip(texts, best, score, strict=True):
        want = naive_bayes(train, t)
        assert b == max(sorted(want), key=want.get) and abs(s - want[b]) < 1e-4


def test_language_of_long_texts_and_odd_letters(monkeypatch):
    texts = ["½ ② ²", "12 34", "", None, "ª", "the and of " * 50]
    model = langid.Model(["de", "en"], np.log(np.random.default_rng(0).random((langid.BUCKETS, 2)) + 0.1).astype(np.float32), np.log(np.array([0.5, 0.5])))
    best, score = model.score(texts)
    assert best[:4] == ["und"] * 4 and score[:4].tolist() == [0] * 4 and best[4] != "und"
    monkeypatch.setattr(langid, "SLICE", 37)
    assert np.allclose(model.score(texts[5:])[1], score[5:], atol=1e-9)


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").where("held_out and lang is not null and n > 40").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9


# -- licences, packing, mixing


def test_planted_licence_texts(spark):
    apache = "/usr/share/common-licenses/Apache-2.0"
    whole = [(n, t) for n, t in licenses.TEXTS + licenses.MORE_TEXTS] + ([("Apache-2.0", open(apache).read())] if os.path.exists(apache) else [])
    rows = [(i, "Copyright 1999-2021 Someone Else\n\n" + re.sub(r"\bLICENSE\b", "LICENCE", t.upper()).replace(" ", "   ").replace("\n", "\n\t* ")) for i, (_, t) in enumerate(whole)]
    rows += [(100 + i, t + "\nand one more term") for i, (_, t) in enumerate(whole)] + [(200, "licence licence LICENCE"), (201, "license license license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].text_license for i in range(len(whole))] == [n for n, _ in whole]
    assert all(got[100 + i].text_license is None for i in range(len(whole))) and got[200].digest == got[201].digest


def test_every_notice_of_the_list_is_found(spark):
    known = licenses.NOTICES + licenses.MORE_NOTICES
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame([(i, "x\n# " + t.upper() + "\ny") for i, (_, t) in enumerate(known)], "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(len(known)))


def test_packs_do_not_depend_on_partitions(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 10 + i % 90)) for i in range(300)] + [(None, None), (7, "")], "doc_id long, text string")
    key = lambda df: sorted((r.pack_id, r.doc_ids, r.pieces, bytes(r.ids)) for r in df.collect())
    first = packing.pack(docs.repartition(2), 128, shard_bytes=8000)
    assert key(first) == key(packing.pack(docs.repartition(7), 128, shard_bytes=8000))
    packing.write(first, f"{tmp_path}/packs")
    back = spark.read.parquet(f"{tmp_path}/packs").orderBy("pack_id").collect()
    want = first.orderBy("pack_id").collect()
    assert (packing.matrix([r.ids for r in back], 128) == packing.matrix([r.ids for r in want], 128)).all() and [r.cu_seqlens for r in back] == [r.cu_seqlens for r in want]


def test_mixing_with_clashing_columns(spark):
    rows = [(i % 40 if i % 7 else None, prose(i, i % 30), "en", f"s{i % 3}" if i % 11 else None, i, "o", 1, 2, 3, "w") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA + ", of_source_ string, size int, place int, copies int, whole string")
    again = mixing.resample(docs)
    assert again.columns == docs.columns
    taken = {}
    for r in again.collect():
        taken[r.n_chars] = taken.get(r.n_chars, 0) + 1
    assert sum(len((t or "").split()) * taken.get(i, 0) for i, (_, t, *_) in enumerate(rows)) == sum(r.taken for r in mixing.mix(docs).collect())
    assert max(taken.values()) <= 2 and taken == {k: n for k, n in Counter(r.n_chars for r in mixing.resample(docs.repartition(6)).collect()).items()}


# -- names


def test_clashing_columns_are_left_alone(spark):
    names = "name other node plain_ of_id of_null key body place part row size whole tie x found scores score ids copies bands bucket label quality y words lines digest".split()
    rows = [(i, prose(i, 30) + (' token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"' if i == 2 else ""), "en", "s", 1, *names) for i in range(6)] + [(1, prose(1, 30), "en", "s", 1, *names)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    for kept, n in ((neardup.keep_first(docs), 6), (secrets.redact(docs), 7), (langid.keep_identified(docs), 7), (mixing.resample(docs), None)):
        assert kept.columns == docs.columns
        got = kept.collect()
        assert (n is None or len(got) == n) and all([r[c] for c in names] == names for r in got)
    counts = [gam.score(docs, labels).count(), packing.pack(docs).count() > 0, rules.judge(docs).count(), licenses.scan(docs).count(), fingerprints.fingerprint(docs).count(), pieces.digests(docs).count()]
    assert counts == [7, True, 7, 7, 7, 7]
    encoded = pieces.encode(docs, into="ids_").select(*docs.columns).collect()
    assert all([r[c] for c in names] == names for r in encoded)


# -- the pipeline

ROWS = [
    *[(i, prose(i, 40 + i), ("en", "de")[i % 2], ("a", "b", None)[i % 3], 1) for i in range(40)], (40, prose(3, 43), "en", "a", 1), (41, prose(4, 44) + " more", "de", "b", 1), (42, None, "en", "a", None),
    (43, "", None, "a", 0), (44, " \n ", "de", None, 3), (None, prose(90, 50), "en", "c", 1), (5, prose(5, 45), "de", "c", 1), (46, 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" ' + prose(46, 60), None, "a", 1), (47, prose(47, 30_000), "en", "b", 1), (48, "12 34", "en", "a", 5),
]


def run_stages(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, "nowhere"))
        out.append((name, docs))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    return dict(run_stages(spark, spark.createDataFrame(ROWS, SCHEMA)))


def test_pipeline_stages_on_odd_rows(stages):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    assert list(stages) == ["language_id", "near_duplicates", "secret_scan", "mix_sources", "token_ids"] and all(df.columns == columns for n, df in stages.items() if n != "token_ids")
    rows = {n: df.collect() for n, df in stages.items()}
    assert {r.doc_id for r in rows["language_id"]} == {r[0] for r in ROWS} - {42, 43, 44, 48}
    kept = {r.doc_id for r in rows["near_duplicates"]}
    assert 3 in kept and 4 in kept and not {40, 41} & kept and None in kept and len(rows["near_duplicates"]) == len(kept)
    redacted = next(r for r in rows["secret_scan"] if r.doc_id == 46)
    assert redacted.text.startswith('token = "[REDACTED]" ') and redacted.n_chars == len(redacted.text) and len(rows["secret_scan"]) == len(rows["near_duplicates"])
    assert Counter(r.doc_id for r in rows["mix_sources"]).most_common(1)[0][1] <= 2
    p = pieces.pieces(pieces.default_model())
    ids = {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in rows["token_ids"]}
    assert ids == {(r.doc_id, len(p.encode(r.text)), tuple(p.encode(r.text))) for r in rows["mix_sources"]} and len(rows["token_ids"]) == len(rows["mix_sources"])


def test_pipeline_on_an_empty_table(spark):
    assert [df.count() for _, df in run_stages(spark, spark.createDataFrame([], SCHEMA))] == [0] * 5


def test_pipeline_run_agrees_with_its_stages(spark, stages, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda df: sorted((str(r.doc_id), r.n_tokens, hashlib.md5(str(r.ids).encode()).hexdigest()) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, str(tmp_path))) == digest(stages["token_ids"])
