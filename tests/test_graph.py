"""Graph operators on hand-built cases, and every query against DuckDB."""

import os
import random
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph import queries as graph
from loomgraph.operators import closure, elect, packets, relations, validate
from loomgraph.plans import context as context_plan
from loomgraph.plans.compile import Catalog, compile_checkout
from loomgraph.sources import files, parsers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def queue_search(edges, seeds):
    """Breadth-first search with one queue over sorted edges."""
    out = {s: (0, s, None) for s in sorted(seeds)}
    queue = deque(out)
    down: dict = {}
    for a, b in sorted(set(edges)):
        down.setdefault(a, []).append(b)
    while queue:
        at = queue.popleft()
        for b in down.get(at, []):
            if b not in out:
                out[b] = (out[at][0] + 1, out[at][1], at)
                queue.append(b)
    return out


def worklist_scope(edges, seeds):
    scope, queue = {s: False for s in seeds}, deque(seeds)
    while queue:
        at = queue.popleft()
        for a, b, unit in edges:
            if a == at:
                only = scope[at] or unit
                if b not in scope or (scope[b] and not only):
                    scope[b] = only
                    queue.append(b)
    return scope


@pytest.mark.parametrize(("seed", "one_task"), [(0, 100_000), (1, 100_000), (2, 0)])
def test_closures_on_cyclic_graphs(spark, monkeypatch, seed, one_task):
    monkeypatch.setattr(closure, "ONE_TASK", one_task)
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    edges = list({(r.choice(names), r.choice(names), r.random() < 0.3) for _ in range(30)})
    r.shuffle(edges)
    seeds = r.sample(names, 2)
    rev = spark.createDataFrame(edges, "dependency string, dependent string, unit_only boolean").repartition(3)
    s = spark.createDataFrame([(x,) for x in seeds], "ref string")
    assert {x.ref: x.unit_only for x in closure.dependent_scope(rev, s).collect()} == worklist_scope(edges, seeds)
    assert {x.ref: (x.distance, x.seed, x["next"]) for x in closure.dependent_distance(rev, s).collect()} == queue_search([(a, b) for a, b, _ in edges], seeds)


FACT = "ord long, subject string, key string, value_json string, evidence_class string, confidence string, observed_at string, normative boolean, list array<string>"


@pytest.mark.parametrize(
    ("rows", "case", "elected"),
    [
        ([("1", "AUTHORED"), ("1", "DERIVED")], "agreement", None),
        ([("1", "AUTHORED"), ("2", "REVIEWED_OVERRIDE")], "open", None),
        ([("1", "AUTHORED"), ("2", "OBSERVED_RUNTIME")], "rule", 1),
        ([("1", "OBSERVED_RUNTIME"), ("2", "OBSERVED_RUNTIME")], "recency", 1),
        ([("1", "DERIVED"), ("2", "DERIVED")], "open", None),
        ([("1", "DERIVED", "candidate"), ("1", "DERIVED", "candidate")], "candidate-only", None),
    ],
)
def test_elections(spark, rows, case, elected):
    facts = [(i, "s", "k.x", r[0], r[1], r[2] if len(r) > 2 else "deterministic", f"2024-01-0{i + 1}", False, None) for i, r in enumerate(rows)]
    rules = spark.createDataFrame([(1, "r", "k", ["OBSERVED_RUNTIME"]), (2, "short", "", ["AUTHORED"])], "ord int, id string, key_pattern string, elect array<string>")
    got = elect.elect(spark.createDataFrame(facts, FACT), rules).first()
    assert (got.case, got.elected_ord) == (case, elected)


def test_override_superset_and_normative(spark):
    rules = spark.createDataFrame([(1, "r", r"o\.x", ["REVIEWED_OVERRIDE"])], "ord int, id string, key_pattern string, elect array<string>")
    row = lambda o, k, v, c, n=False, x=None: (o, "s", k, v, c, "deterministic", None, n, x)
    facts = [row(1, "o.x", "1", "AUTHORED"), row(2, "o.x", "2", "REVIEWED_OVERRIDE"), row(3, "l.x", "[1]", "DERIVED", x=["1"]), row(4, "l.x", "[1,2]", "DERIVED", x=["1", "2"]), row(5, "n.x", "1", "AUTHORED", True)]
    got = {r.key: (r.case, r.elected_ord) for r in elect.elect(spark.createDataFrame(facts, FACT), rules).collect()}
    assert got == {"o.x": ("override", 2), "l.x": ("superset", 4), "n.x": ("normative", None)}


def test_pages_make_the_whole(spark):
    rows = [("p", i, 10 * (i % 4) + 1) for i in range(25)]
    df = spark.createDataFrame(rows, "packet string, id int, cost long")
    seen, offset = [], 0
    while page := sorted(r.id for r in packets.page(df, "packet", ["id"], "cost", 60, offset).collect()):
        seen += page
        offset += len(page)
    assert seen == list(range(25))


def test_merge_keeps_the_class_of_single_edges(spark):
    e = spark.createDataFrame([("t", "a", "b", "", "x", "AUTHORED", 1), ("t", "a", "c", "", "x", "AUTHORED", 1), ("t", "a", "c", "", "y", "DERIVED", 2)], "type string, source_ref string, target_ref string, attrs_key string, via string, evidence_class string, prov long")
    assert {r.target_ref: (r.evidence_class, r.via) for r in relations.merge(e).collect()} == {"b": ("AUTHORED", ["x"]), "c": ("DERIVED", ["x", "y"])}


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"$ref": "#/$defs/s"}}, "$defs": {"s": {"type": "string", "pattern": "^x"}}}
    found = lambda d: sorted((v["instance_path"], v["keyword"]) for v in validate.schema_violations(d, schema))
    assert found({"a": 3, "b": "xy"}) == [] and found({"a": 1, "b": "y", "c": 0}) == [("", "additionalProperties"), ("/a", "minimum"), ("/b", "pattern")] and found({}) == [("", "required")]


@pytest.mark.parametrize("text", ["a: &x 1", "a: *x", "a: !!str 1", "a: 1\na: 2", "a:\n\t- b", "<<: {a: 1}", "a: 9007199254740993"])
def test_yaml_refuses(text):
    with pytest.raises(parsers.Refused):
        parsers.parse_yaml(text)


def test_parsers():
    assert parsers.parse_yaml("a: yes\nb: [1, 0x10, .5, ~]\n---\nc: 'd'\n") == [(0, 1, {"a": "yes", "b": [1, 16, 0.5, None]}), (1, 4, {"c": "d"})]
    assert parsers.parse_toml("a = 1979-05-27\nb = [1, {c = true}]") == {"a": "1979-05-27", "b": [1, {"c": True}]}
    assert parsers.parse_jsonc('{"a": "//x", /* y */ "b": [1,], // z\n}') == {"a": "//x", "b": [1]}
    assert parsers.protobuf("service A { rpc B (stream C) returns (D) {} }") == [("A", "B", "C", True)]
    assert parsers.shell_commands("npm test && go vet ./...\nmake x | tee") == [] and [c[1] for c in parsers.shell_commands("npm test && go vet ./...")] == ["npm test", "go vet ./..."]
    assert parsers.js_imports("import type {A} from 'x'; import {b} from 'y'; // import 'z'\nimport {c} from 'x'") == [("x", False), ("y", False)]
    assert parsers.python_imports("import os, a.b as c\nfrom d.e import f\n") == ["a", "d", "os"] and parsers.requirement("Foo_Bar[x]>=1.2 ; python_version > '3'") == "foo-bar"
    assert files.parse_status("R  new\0old\0?? x\0") == [("R ", "new", "old"), ("??", "x", None)]


def test_a_checkout(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(text)

    put("web/package.json", '{"name": "@x/web", "dependencies": {"@x/lib": "*"}, "scripts": {"test": "jest TOKEN=abc", "dev": "x"}}')
    put("lib/package.json", '{"name": "@x/lib"}')
    put("svc/go.mod", "module example.com/svc\nrequire (\n  example.com/common v1\n)\n")
    put("common/go.mod", "module example.com/common\n")
    put("svc/main.go", 'publish("orders.created")\n')
    put("web/node_modules/z/package.json", '{"name": "z"}')
    put("svc/api/openapi.yaml", "paths:\n  /a:\n    get:\n      operationId: getA\n")
    g = compile_checkout(spark, str(tmp_path))
    assert {(r.type, r.source_ref, r.target_ref) for r in g["relations"].where("type like '%On'").collect()} == {("buildDependsOn", "component:default/web", "component:default/lib"), ("buildDependsOn", "component:default/svc", "component:default/common")}
    assert {r.id: r.command for r in g["verification"].collect()}["web:test"] == "jest TOKEN=[REDACTED]"
    assert relations.missing_inverses(g["relations"]).isEmpty() and [tuple(r)[1:] for r in g["operations"].collect()] == [("openapi", None, "GET", "/a")]
    assert [(r.pattern, r.producers) for r in g["events"].collect()] == [("orders.created", ["component:default/svc"])]
    version = files.write_graph({"units": g["units"]}, str(tmp_path / "out"), "v1")
    assert version == "v1" and files.read_graph(spark, str(tmp_path / "out"), ["units"])["units"].count() == 4


def _plain(v):
    return "null" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(graph.queries()))
def test_query(spark, name):
    rows = graph.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in rows.collect())
    sql = graph.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_whole_queries_take_every_id(spark, tmp_path):
    parts = [(3, "a", "b1", 1), (4, "b", "b1", 3), (500, "b", "b2", 3), (1164, "c", "b2", 3), (70000, "d", "b3", 2)]
    lines = [(k, n, s, p) for k in (2, 601, 90000, 90001) for n, s, p in ((1, 6, 500), (2, 7, 3), (4, 8, 70000))]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(2, 5), (601, 800), (90000, 800), (90001, 5000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = lambda name: {tuple(r) for r in graph.queries()[name](spark, str(tmp_path)).collect()}

    odd, even, key = set(), set(), {2: 5, 601: 800, 90000: 800, 90001: 5000}
    for k, _, s, _ in lines:
        (odd if k % 2 else even).add((f"component:tpch/supplier-{s}", f"resource:tpch/customer-{key[k]}"))
    assert rows("graph_diff") == {("usesResource", *e, "shared" if e in odd & even else "left" if e in even else "right") for e in odd | even}
    problems = {(k, n, p) for k, n, _, _ in lines for p, on in (("transport", n % 3 == 0), ("contract-ref", n % 2 == 1), ("attribute:colour", n == 4)) if on}
    assert rows("attribute_violations") == problems
    used = {(s, k) for k, _, s, _ in lines if s > 6}
    calls = {(s, k + s % 2) for s, k in used}
    assert rows("contract_duplicate_calls") == {(f"component:tpch/supplier-{s}", f"api:tpch/order-{k}", (s, k) in used) for s, k in calls}
    assert rows("unique_name_lookup") == {("a", 3, False), ("b", -1, True), ("c", 4, False), ("d", 0, False)}
    assert rows("unit_shapes") == {("b1", True, False, True, False, True), ("b2", False, False, False, True, True), ("b3", False, True, True, False, True)}
    near, found = [(p, q) for p, *_ in parts for q in [p // 2] + [p // 3] * (p % 5 == 0)], {3}
    while more := {b for x in near for a, b in (x, x[::-1]) if a in found} - found:
        found |= more
    assert rows("undirected_closure") == {(f"component:tpch/part-{p}",) for p in found}


def test_entry(spark):
    assert __spark_entry__.entry(spark).where(F.col("rank") >= 0).count() == 25 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_compile_with_a_catalog(spark, tmp_path):
    def put(path, text):
        at = tmp_path / "repo" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)

    head = "kind: {}\nmetadata:\n  name: {}\n  description: D.\n"
    put("web/package.json", '{"name": "@x/web", "dependencies": {"@x/lib": "1", "stripe": "1"}, "scripts": {"test": "jest"}}')
    put("lib/package.json", '{"name": "@x/lib"}')
    put("web/src/a.ts", "import b from '@x/lib';\nload('api/orders.proto');\nserve({ port: 3000 });\npublish('order.made');\n")
    put("web/README.md", "api/orders.proto on port 9")
    put("api/orders.proto", 'syntax = "proto3";\nservice Orders {\n  rpc Get(A) returns (B);\n}\n')
    put("web/component.yaml", head.format("Component", "shop") + "spec:\n  type: service\n  system: sales\n  context:\n    docs:\n      - notes/shop.md\n")
    put("lib/component.yaml", head.format("Component", "base") + "spec:\n  type: library\n  system: sales\n")
    put("catalog/apis.yaml", head.format("API", "orders") + "spec:\n  type: protobuf\n  provider: component:default/base\n  contract:\n    ref: api/orders.proto\n---\n" + head.format("System", "sales"))
    put("catalog/journeys.yaml", "journeys:\n  - id: buy\n    description: x\n    components:\n      - component:default/shop\n      - component:default/none\n")
    put("catalog/observations/prod.yaml", "kind: ObservationSet\nmetadata:\n  name: s\n  environment: prod\n  capturedAt: x\n  evidenceBundle: catalog/apis.yaml\nspec:\n  facts:\n    - id: a\n      subject: component:default/shop\n      key: component.port\n      value: 4000\n")
    g = compile_checkout(spark, str(tmp_path / "repo"), catalog=Catalog(externals=[("^stripe$", "Payments", "sdk", "dependency")], capabilities=[("orders", "order[.]made")]))
    edges = {(r.type, r.source_ref.split("/")[1], r.target_ref.split("/")[1]) for r in g["relations"].collect()}
    assert {("buildDependsOn", "shop", "base"), ("partOf", "shop", "sales"), ("hasPart", "sales", "base"), ("providesApi", "base", "orders"), ("consumesApi", "shop", "orders"), ("apiConsumedBy", "orders", "shop")} <= edges
    assert {(r.subject, r.kind, r.status) for r in g["conflicts"].collect()} == {("component:default/shop", "contradiction", "unresolved")}
    assert {(r.code, r.subject, r.message) for r in g["diagnostics"].collect()} == {("JOURNEY_REF", "buy", "component:default/none")}
    assert [tuple(r) for r in g["externals"].select("component", "name").collect()] == [("component:default/shop", "Payments")]
    found = context_plan.query(spark, g, "notes/shop.md", {"relations": 2})
    by: dict = {}
    for r in found.collect():
        by.setdefault(r.section, []).append(r)
    assert '"name":"shop"' in by["entity"][0].item and len(by["relations"]) == 2 and by["relations"][0].truncated and {"events", "apis", "verification", "externals", "capabilities", "conflicts", "assertions"} <= set(by)
    assert {r.section for r in context_plan.cut_sections(found).collect()} == {"relations"}
    context_plan.assert_no_secrets(found)
    assert "## events" in context_plan.markdown(found, "shop")
    with pytest.raises(KeyError):
        context_plan.query(spark, g, "nowhere/else.txt")
    assert context_plan.check_fresh(g, g["inputs"]).isEmpty()
