"""Snapshots that change while they are read, and compiled graphs that are kept, damaged and evicted."""

import os

import pytest

from loomgraph.plans import cache
from loomgraph.plans import compile as compile_plan
from loomgraph.sources import files, snapshot


def put(root, path, text):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)


def test_listing(spark, tmp_path):
    for path in ("a.txt", "d/b.txt", "d/e/c.txt", "d/e/f/g/h.txt", "node_modules/x/y.js", ".ci/_x.yml"):
        put(tmp_path, path, path)
    os.makedirs(tmp_path / "empty/in")
    os.symlink("a.txt", tmp_path / "link")
    got = {r.path: (r.kind, r.length) for r in snapshot.capture(spark, str(tmp_path)).collect()}
    assert {p: n for p, (k, n) in got.items() if k == "file"} == {"a.txt": 5, "d/b.txt": 7, "d/e/c.txt": 9, "d/e/f/g/h.txt": 13, ".ci/_x.yml": 10}
    assert {r.path: r.text for r in files.inputs(spark, str(tmp_path)).collect()} == {p: p for p, (k, _) in got.items() if k == "file"}
    assert {p for p, (k, _) in got.items() if k == "dir"} == {"d", "d/e", "d/e/f", "d/e/f/g", "empty", "empty/in", ".ci"} and got["link"][0] == "link"
    ignored = spark.createDataFrame([("d/e",)], "path string")
    assert {r.path for r in snapshot.capture(spark, str(tmp_path), ignored).collect()} == {"a.txt", "d", "d/b.txt", "empty", "empty/in", "link", ".ci", ".ci/_x.yml"}


def test_a_change_between_the_reads_is_seen_once_and_refused_twice(spark, tmp_path):
    put(tmp_path, "a.txt", "one")
    turns = []

    def read(change):
        def inputs(spark, root, ignored):
            found = spark.createDataFrame(files.inputs(spark, root, ignored).collect(), "path string, length long, sha256 string, text string, is_utf8 boolean")
            turns.append(1)
            change(len(turns))
            return found

        return inputs

    found, listing = snapshot.stable_inputs(spark, str(tmp_path), read=read(lambda n: put(tmp_path, "a.txt", "two") if n == 1 else None))
    assert len(turns) == 2 and [r.text for r in found.collect()] == ["two"] and listing.count() == 1
    turns.clear()
    with pytest.raises(snapshot.Unstable):
        snapshot.stable_inputs(spark, str(tmp_path), read=read(lambda n: put(tmp_path, f"n{n}.txt", "x")))
    assert len(turns) == 2


def test_what_was_read_must_be_what_was_listed(spark, tmp_path):
    """The file is changed and put back, so both listings agree, but not with what was read in between."""
    put(tmp_path, "a.txt", "one")

    def read(spark, root, ignored):
        put(tmp_path, "a.txt", "two")
        rows = files.inputs(spark, root, ignored).collect()
        put(tmp_path, "a.txt", "one")
        return spark.createDataFrame(rows, "path string, length long, sha256 string, text string, is_utf8 boolean")

    with pytest.raises(snapshot.Unstable):
        snapshot.stable_inputs(spark, str(tmp_path), read=read)


def test_store(spark, tmp_path):
    base = str(tmp_path / "store")
    one = {"t": spark.createDataFrame([(1, {"a": "b"}, ["x"]), (2, None, None)], "k int, m map<string,string>, l array<string>"), "e": spark.createDataFrame([], "k int")}
    store = cache.Store(spark, base)
    made = []
    listing = spark.createDataFrame([("a", "file", "1")], "path string, kind string, sha256 string")
    make = lambda: made.append(1) or one
    first, hit = cache.cached(store, listing, make)
    again, hit_again = cache.cached(store, listing, make)
    assert (hit, hit_again, len(made)) == (False, True, 1)
    assert sorted(map(str, again["t"].collect())) == sorted(map(str, one["t"].collect())) and again["e"].count() == 0
    assert cache.cached(store, listing, make, "other")[1] is False and cache.cached(store, listing.limit(0), make)[1] is False
    key = cache.listing_key(listing)
    store.spark.createDataFrame([(1, {"a": "c"}, ["x"]), (2, None, None)], "k int, m map<string,string>, l array<string>").write.mode("overwrite").parquet(f"{base}/{key}/t")
    assert store.read(key) is None and cache.cached(store, listing, make)[1] is False and store.read(key) is not None
    small = cache.Store(spark, base, most_bytes=1)
    assert len(small.evict(keep=key)) == 2 and small.read(key) is not None and small.evict() == [key]


def test_an_unchanged_checkout_is_not_compiled_again(spark, tmp_path, monkeypatch):
    put(tmp_path, "repo/a/package.json", '{"name": "a", "dependencies": {"b": "1"}}')
    put(tmp_path, "repo/b/package.json", '{"name": "b"}')
    store, root = cache.Store(spark, str(tmp_path / "store")), str(tmp_path / "repo")
    first, hit = compile_plan.compile_cached(spark, root, store)
    edges = {(r.type, r.source_ref, r.target_ref) for r in first["relations"].collect()}
    assert not hit and len(edges) == 2

    def never(*_):
        raise AssertionError("compiled")

    monkeypatch.setattr(compile_plan, "compile_inputs", never)
    again, hit = compile_plan.compile_cached(spark, root, store)
    assert hit and {(r.type, r.source_ref, r.target_ref) for r in again["relations"].collect()} == edges
    put(tmp_path, "repo/b/x.ts", "")
    with pytest.raises(AssertionError):
        compile_plan.compile_cached(spark, root, store)
