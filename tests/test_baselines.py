"""Retrieval systems on a hand-built tree of several languages, and their scores."""

from loomgraph.operators import baselines
from loomgraph.plans.context import whole

TREE = {
    "go.work": "use ./svc", "svc/go.mod": "module ex.org/svc\nrequire ex.org/common v1.0.0\nrequire github.com/x/y v2\n", "svc/main.go": 'import "ex.org/common/log"\nsql.Open("postgres", dsn)\npb.RegisterOrdersServer(s)\n',
    "common/go.mod": "module ex.org/common\n", "common/log/log.go": "package log\n", "api/orders.proto": 'service Orders {\n}\n', "web/package.json": '{"name": "web", "scripts": {"lint": "eslint .", "dev": "x"}}',
    "web/src/c.ts": "load('../../api/orders.proto'); const q = { bucket: 1 }; bucket = 'Raw_Files'\nfetch('/api/pay')\n", "pay/app/api/pay/route.ts": "export {}\n", "pay/notes.txt": "n", "pay/RUNBOOK.md": "r",
    "py/pyproject.toml": '[project]\nname = "tool"\ndependencies = ["requests>=2"]\n', "py/tool/__init__.py": "import pytest\nimport alone\n", "py/uv.lock": "", "alone/Cargo.toml": '[package]\nname = "alone-x"\n[dependencies]\nserde = "1"\n', "alone/src/lib.rs": "use tool::x;\n",
    ".github/workflows/ci.yml": "jobs:\n  a:\n    steps:\n      - run: |\n          make check\n          npm test --filter=web\n          pytest tool\n", "lone/x.md": "x",
}
UNITS = ["svc", "common", "web", "pay", "py", "alone", "lone"]


def test_search_of_a_tree(spark):
    files = spark.createDataFrame(sorted(TREE.items()), "path string, text string")
    components = spark.createDataFrame([(f"component:default/{u}", u, u, ["lone/x.md"] if u == "pay" else []) for u in UNITS], "ref string, name string, root string, docs array<string>")
    touched = spark.createDataFrame([("go", "common/log/log.go"), ("contract", "./api/orders.proto"), ("ref", "component:default/alone"), ("none", "api/other.txt")], "scenario string, touch string")
    facts, common, reached = baselines.search(files, components, touched)
    near: dict = {}
    for r in reached.collect():
        near.setdefault(r.scenario, set()).add(r.ref.split("/")[1])
    one = {"svc", "common", "web", "pay"}
    assert near == {"go": one, "contract": one, "ref": {"alone", "py"}}
    got: dict = {}
    for r in facts.collect():
        got.setdefault(r.scenario, set()).add(r.fact)
    own = {f"component:default/{u}" for u in one}
    want = own | {
        "external:github.com/x/y", "verify:go test ./...", "verify:go vet ./...", "verify:eslint .", "verify:npm test --filter=web", "resource:default/svc-postgres", "uses:resource:default/svc-postgres", "resource:default/raw-files", "uses:resource:default/raw-files",
        "doc:pay/notes.txt", "runbook:pay/RUNBOOK.md", "doc:lone/x.md", "api:default/orders", "provides:api:default/orders", "consumes:api:default/orders", "provider:component:default/svc", "consumer:component:default/web",
    }
    assert got["go"] == want and got["contract"] == want
    assert got["ref"] == {"component:default/alone", "component:default/py", "external:serde", "external:requests", "verify:cargo test -p alone-x", "verify:cargo clippy -p alone-x", "verify:uv run pytest", "verify:pytest tool"}
    assert [r.fact for r in common.collect()] == ["verify:make check"]


def test_graph_systems_and_scores(spark):
    ref = lambda u: f"component:default/{u}"
    graph = whole(spark, {
        "entities": spark.createDataFrame([(ref("a"), "Component", "a", ["a/d.md"], ["a/c.md"]), (ref("a-in"), "Component", "a/in", [], []), ("api:default/x", "API", None, [], [])], "ref string, kind string, source_path string, docs array<string>, constraints array<string>"),
        "relations": spark.createDataFrame([("consumesApi", ref("a"), "api:default/x"), ("partOf", ref("a"), "system:default/s")], "type string, source_ref string, target_ref string"),
        "capabilities": spark.createDataFrame([(ref("a"), "push")], "component string, name string"),
    })
    facts, common = baselines.targeted(graph, spark.createDataFrame([(1, ref("a"))], "scenario int, ref string"))
    assert {r.fact for r in facts.collect()} == {ref("a"), ref("a-in"), "api:default/x", "consumes:api:default/x", "system:default/s", "doc:a/d.md", "constraint:a/c.md"}
    assert [r.fact for r in common.collect()] == ["doc:a/d.md"]
    every = {r.fact for r in baselines.inventory(graph).collect()}
    assert every == {ref("a"), ref("a-in"), "api:default/x", "provides:api:default/x", "consumes:api:default/x", "consumer:component:default/a", "system:default/s", "doc:a/d.md", "constraint:a/c.md", "capability:push"}
    truth = spark.createDataFrame([(1, ref("a")), (1, "doc:a/d.md"), (1, "event:none")], "scenario int, fact string")
    scenarios = spark.createDataFrame([(1,), (2,)], "scenario int")
    got = {r.scenario: tuple(r)[1:] for r in baselines.scored(truth, facts, common, scenarios).collect()}
    assert got == {1: (3, 7, 2, 0.6667, 0.2857, 0.7143), 2: (0, 1, 0, 1.0, 0.0, 1.0)}
    assert {r.scenario: r.n_retrieved for r in baselines.scored(truth, None, None, scenarios).collect()} == {1: 0, 2: 0}
