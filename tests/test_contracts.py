"""Contracts in source text: every place and length against plain containment, and how many pairs are looked at."""

import random

from loomgraph.operators import contracts


def test_containment_at_every_place(spark):
    r = random.Random(3)
    part = lambda n: "".join(r.choice("ab/é😀.") for _ in range(n))
    refs = {part(n) for n in [*range(1, 30), 46, 47, 48, 94, 95, 96, 130] for _ in range(2)}
    known = [(ref, f"u{i % 3}") for i, ref in enumerate(sorted(refs))] + [(None, "u0"), ("", "u1")]
    texts = [(f"u{i % 4}", f"f{i}", part(r.randrange(40)) + r.choice(sorted(refs)) + part(r.randrange(9)) + "\n" + r.choice(sorted(refs))) for i in range(300)] + [("u1", "none", None), ("u1", "empty", "")]
    got = contracts.consumers(spark.createDataFrame(texts, "unit string, path string, text string"), spark.createDataFrame(known, "ref string, provider string"))
    want = {(ref, u, p) for u, p, t in texts for ref, by in known if t is not None and ref is not None and ref in t and u != by}
    assert {(x.ref, x.unit, x.path) for x in got.collect()} == want and len(want) > 600


def test_contracts_of_one_folder_meet_few_texts(spark):
    """Five thousand contracts share all but four digits of their path; each text names one of them."""
    refs = spark.range(5000).selectExpr("concat('services/shared/contracts/v1/c-', lpad(id, 4, '0'), '.proto') as ref")
    files = spark.range(5000).selectExpr("concat('u', id) as unit", "concat('f', id) as path", "concat(repeat('x', int(id % 24)), ' load(\"services/shared/contracts/v1/c-', lpad(id, 4, '0'), '.proto\")') as text")
    assert contracts.candidates(files, refs).count() < 15 * 5000
    assert contracts.consumers(files, refs.selectExpr("ref", "'p' as provider")).count() == 5000


def test_short_contracts_share_few_runs(spark):
    """Nine thousand contracts of seven characters, which have a thousand runs of three digits."""
    refs = spark.range(10000, 100000, 10).selectExpr("concat('x.', id) as ref")
    files = spark.range(10000, 100000, 10).selectExpr("concat('u', id) as unit", "concat('f', id) as path", "concat(repeat('-', int(id div 10 % 12)), ' \"x.', id, '\"') as text")
    assert contracts.candidates(files, refs).count() < 10 * 9000
    assert contracts.consumers(files, refs.selectExpr("ref", "'p' as provider")).count() == 9000
