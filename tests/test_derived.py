"""Findings of several extractors about one unit, merged by the kind of each field."""

import random

from loomgraph.operators import indexes

PARTIAL = "unit string, ord int, langs array<string>, notes array<string>, links map<string,string>, shape string"


def test_merge_by_kind(spark):
    r = random.Random(4)
    some = lambda x: x if r.random() < 0.7 else None
    rows = [(f"u{i}", o, some(r.sample("abc", 2)), some(r.choices("xyz", k=3)), some({k: f"{o}{k}" for k in r.sample("pqr", 2)}), some(f"s{o}")) for i in range(40) for o in r.sample(range(9), r.randrange(1, 5))]
    rows += [("none", 1, None, None, None, None), ("empty", 1, [], [], {}, "")]
    want: dict = {}
    for u, _, langs, notes, links, shape in sorted(rows, key=lambda x: x[:2]):
        w = want.setdefault(u, [None, None, None, None])
        w[0] = w[0] if langs is None else sorted({*(w[0] or []), *langs})
        w[1] = w[1] if notes is None else (w[1] or []) + notes
        w[2] = w[2] if links is None else (w[2] or {}) | links
        w[3] = w[3] if shape is None else shape
    got = indexes.merge_derived(spark.createDataFrame(rows, PARTIAL), "unit", sets=("langs",), lists=("notes",), maps=("links",), scalars=("shape",))
    assert {x.unit: [x.langs, x.notes, x.links, x["shape"]] for x in got.collect()} == want
