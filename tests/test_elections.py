"""Elections against a decision table that sees every row of a group, one group with a third of all facts."""

import random

from loomgraph.operators import audit, elect

FACT = "ord long, subject string, key string, value_json string, evidence_class string, confidence string, observed_at string, normative boolean, supersedes string, list array<string>"
CLASSES = ["AUTHORED", "DERIVED", "OBSERVED_RUNTIME", "REVIEWED_OVERRIDE"]
RULES = [(1, "runtime", "a", ["OBSERVED_RUNTIME"]), (2, "both", "b", ["DERIVED", "AUTHORED"]), (3, "review", "c", ["REVIEWED_OVERRIDE"])]


def decided(rows, allowed):
    firm = [r for r in rows if r["confidence"] is not None and r["confidence"] != "candidate"]
    values = {r["value_json"] for r in rows}
    normative = any(r["normative"] for r in rows)
    if normative and all(r["normative"] or r["confidence"] == "candidate" for r in rows):
        return "normative", None
    if len(values) == 1:
        return ("agreement" if firm else "candidate-only"), None
    over = [r for r in firm if r["evidence_class"] == "REVIEWED_OVERRIDE"]
    if not normative and allowed == ["REVIEWED_OVERRIDE"] and len(over) == 1:
        return "override", over[0]["ord"]
    there = [c for c in allowed if any(r["evidence_class"] == c for r in firm)]
    chosen = [r for r in firm if there and r["evidence_class"] == there[0]]
    if not normative and len(there) == 1 and len(chosen) == 1:
        return "rule", chosen[0]["ord"]
    whole = [c for c in firm if c["list"] is not None and all(o is c or (o["list"] is not None and set(o["list"]) <= set(c["list"]) and len(o["list"]) < len(c["list"])) for o in firm)]
    if not normative and len(firm) > 1 and whole:
        return "superset", whole[0]["ord"]
    dated = [r for r in firm if r["evidence_class"] == "OBSERVED_RUNTIME" and r["observed_at"] is not None]
    if not normative and "OBSERVED_RUNTIME" in allowed and len(dated) >= 2:
        return "recency", max((r["observed_at"], r["ord"]) for r in dated)[1]
    return "open", None


def test_groups_as_the_table_decides_them(spark):
    r = random.Random(5)
    facts, names = [], [f.split()[0] for f in FACT.split(", ")]
    for i in range(900):
        hot = i % 3 == 0
        subject, key = ("hot", "a") if hot else (f"s{r.randrange(120)}", r.choice("abcd"))
        items = [str(x) for x in range(r.randrange(1, 5))] if r.random() < 0.6 else None
        value = str(items) if items else str(r.randrange(2))
        facts.append((i, subject, key, value, r.choice(CLASSES), r.choice(["deterministic", "deterministic", "candidate", None] if i % 50 == 1 else ["deterministic", "deterministic", "candidate"]),
                      f"2024-01-{r.randrange(10, 30)}" if r.random() < 0.8 else None, r.random() < 0.05 and not hot, None, items))
    rules = spark.createDataFrame(RULES, "ord int, id string, key_pattern string, elect array<string>")
    groups = {}
    for f in facts:
        groups.setdefault((f[1], f[2]), []).append(dict(zip(names, f, strict=True)))
    # a pattern matches `subject key`, of which only the key has a letter of a rule
    want = {g: decided(rows, {"a": RULES[0][3], "b": RULES[1][3], "c": RULES[2][3]}.get(g[1], [])) for g, rows in groups.items()}
    got = elect.elect(spark.createDataFrame(facts, FACT), rules)
    assert "sort_array" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert {(x.subject, x.key): (x.case, x.elected_ord) for x in rows} == want
    assert {case for case, _ in want.values()} >= {"agreement", "open", "rule", "superset", "recency", "override", "candidate-only"}
    assert {(x.subject, x.key): (x.n_rows, x.n_values) for x in rows} == {g: (len(v), len({y["value_json"] for y in v})) for g, v in groups.items()}


def test_classes_as_a_fold_in_order(spark):
    r = random.Random(8)
    kinds = ["DERIVED", "DERIVED", "OBSERVED", "CONFIRMED", "CONFLICT", "UNRESOLVED"]
    notes = [("hot" if i % 3 == 0 else f"f{r.randrange(150)}", r.randrange(40), r.choice(kinds[: 6 if i % 5 else 4]), r.choice([None, f"w{i % 7}"])) for i in range(900)]
    notes += [(f"d{i}", 1, "DERIVED", None) for i in range(5)] + [("c", 1, "DERIVED", "x"), ("c", 2, "CONFIRMED", "y"), ("o", 1, "OBSERVED", "x"), ("o", 2, "CONFIRMED", "y")]
    want = {}
    for fact in {n[0] for n in notes}:
        rows = sorted((n[1:] for n in notes if n[0] == fact), key=lambda x: (x[0], x[1], x[2] or ""))
        cls = rows[0][1]
        for _, c, _ in rows:
            cls = c if c in ("CONFLICT", "UNRESOLVED") or (c == "CONFIRMED" and cls == "DERIVED") else cls
        want[fact] = (cls, [w for _, _, w in rows if w is not None][:4])
    got = audit.classify(spark.createDataFrame(notes, "fact string, ord int, cls string, why string"))
    assert {x.fact: (x["class"], x.why) for x in got.collect()} == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()
