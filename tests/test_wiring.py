"""Events and modules against plain versions: constants by a walk of the units, module resolution and patterns file by file."""

import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import events, imports, modules

FILES = "unit string, path string, text string, is_test boolean"


# -- events


def seen(unit, depends):
    out, stack = {unit}, [unit]
    while stack:
        at = stack.pop()
        for a, b in depends:
            if a == at and b not in out:
                out.add(b)
                stack.append(b)
    return out


def test_constants_of_visible_units(spark):
    """The same name in a unit that isn't visible plays no part; of visible ones the last replaces the unit's own."""
    files = [
        ("a", "a/x.ts", "publish(MADE_SUBJECT)", False), ("b", "b/x.ts", "export const MADE_SUBJECT = 'b.made.v1'", False), ("c", "c/x.ts", "const MADE_SUBJECT: string = 'c.made.v1'", False),
        ("d", "d/x.ts", "const MADE_SUBJECT = 'd.made.v1'; consume(MADE_SUBJECT)", False), ("e", "e/x.ts", "emit(MADE_SUBJECT)", False), ("f", "f/x.ts", "MADE_SUBJECT", False),
        ("d", "d/tests/y.ts", "publish('d.test.v1')", True), ("d", "d/z.md", "publish('d.doc.v1')", False),
    ]
    depends = spark.createDataFrame([("a", "m"), ("m", "b"), ("d", "c"), ("c", "d")], "src string, dst string")
    got = {(r.unit, r.pattern, r.role) for r in events.roles(spark.createDataFrame(files, FILES), depends).collect()}
    assert got == {("a", "b.made.v1", "producer"), ("d", "d.made.v1", "consumer"), ("d", "c.made.v1", "consumer")}


def test_constants_as_a_walk_finds_them(spark):
    r = random.Random(2)
    units = [f"u{i:02}" for i in range(14)]
    depends = [(r.choice(units), r.choice(units)) for _ in range(22)]
    declared = [(r.choice(units), f"p{i}", f"N{r.randrange(5)}", f"s.t{i}.v") for i in range(25)]
    wanted = [(u, f"N{i}") for u in units for i in range(5) if r.random() < 0.6]
    want = {}
    for u, name in wanted:
        found = [(h != u, h, path, pattern) for h, path, n, pattern in declared if n == name and h in seen(u, depends)]
        if found:
            want[u, name] = max(found)[3]
    at = F.struct(F.lit(0).alias("turn"), F.lit(0).alias("at")).alias("place")
    rows = spark.createDataFrame([(u, n, s, p) for u, p, n, s in declared], "unit string, name string, pattern string, path string").select("*", at)
    got = events.seen_constants(spark.createDataFrame(wanted, "unit string, name string"), rows, spark.createDataFrame(depends, "src string, dst string"))
    assert {(x.unit, x.name): x.pattern for x in got.collect()} == want and len(want) > 15


def test_contracts_of_events(spark):
    rows = [("a.b.c", ["x"], ["y"], "doc/events"), ("a.b.d", [], ["y", "z"], "doc/events/one.json"), ("a.b.e", ["x"], [], "doc/gone.json"), ("a.b.f", ["x"], [], None)]
    interfaces = spark.createDataFrame(rows, "pattern string, producers array<string>, consumers array<string>, contract_ref string")
    files = spark.createDataFrame([("doc/events/one.json",)], "path string")
    index, problems = events.checked(interfaces, files)
    assert sorted((r.pattern, r.resolution) for r in index.collect()) == [("a.b.c", "resolved"), ("a.b.d", "unresolved")]
    assert sorted(tuple(r) for r in problems.collect()) == [("error", "EVENT_CONTRACT", "a.b.e", "doc/gone.json"), ("error", "EVENT_CONTRACT", "a.b.f", "none"), ("warning", "EVENT_UNRESOLVED", "a.b.d", "y, z")]


# -- modules


def plain_file(files, base):
    base = posixpath.normpath(base)
    if base == "." or base.startswith(".."):
        return None
    tried = [base, *[base + e for e in modules.EXTENSIONS]]
    ext = re.search(r"\.[^./]*$", base)
    if ext and ext[0] in modules.EMITTED:
        tried += [base[: -len(ext[0])] + e for e in modules.EMITTED[ext[0]]]
    tried += [base + "/index" + e for e in modules.EXTENSIONS]
    return next((f for f in tried if f in files), None)


def plain_match(pairs, spec):
    best = None
    for pattern, targets in pairs:
        if "*" not in pattern:
            if pattern == spec:
                return targets, ""
            continue
        a, b = pattern.split("*", 1)
        if len(spec) >= len(a) + len(b) and spec.startswith(a) and spec.endswith(b) and (best is None or len(a) > len(best[0])):
            best = (a, targets, spec[len(a) : len(spec) - len(b)])
    return best and best[1:]


def plain_routes(path, spec, config, aliases, subpaths):
    if re.match(r"^\.\.?(/|$)", spec):
        return [("relative-import", [posixpath.join(posixpath.dirname(path), spec)], False)]
    if spec.startswith("/") or re.match(r"(?i)^[a-z][a-z0-9+.-]*:", spec):
        return []
    out, hit = [], plain_match(config["paths"], spec)
    if hit:
        out.append(("path-alias", [posixpath.join(config["base"], t.replace("*", hit[1], 1)) for t in hit[0]], False))
    for find, target in aliases:
        if spec == find or spec.startswith(find + "/"):
            out.append(("bundler-alias", [target + spec[len(find) :]], False))
            break
    if spec.startswith("#"):
        hit = plain_match(subpaths, spec)
        if hit:
            out.append(("subpath-import", [t.replace("*", hit[1]) for t in hit[0]], True))
    return [*out, ("path-alias", [posixpath.join(config["base"], spec)], False)]


def plain_resolve(files, path, spec, *settings):
    for via, bases, every in plain_routes(path, spec, *settings):
        found = []
        for base in bases:
            f = plain_file(files, base)
            if f and f not in found:
                found.append(f)
            if f and not every:
                break
        if found:
            return {(f, via) for f in found}
    return set()


@pytest.fixture(scope="module")
def tree():
    r = random.Random(4)
    dirs = ["src", "src/a", "src/a/b", "lib", "lib/x.js", "gen"]
    names = ["m", "n", "index", "m.d", "x", "x.js"]
    return sorted({f"{r.choice(dirs)}/{r.choice(names)}{r.choice([*modules.EXTENSIONS, '.json'])}" for _ in range(120)})


def test_routes_and_endings_as_tried_one_by_one(spark, tree):
    r = random.Random(6)
    config = {"base": "src", "paths": [("@/*", ["none/*", "a/*", "../lib/*"]), ("@/a/*", ["../gen/*"]), ("one", ["gone", "m"]), ("five/*", ["1/*", "2/*", "3/*", "4/*", "a/*"]), ("*.css", ["a/m"])]}
    aliases = [("@al", "src/a"), ("@al/b", "lib"), ("~", "gen")]
    subpaths = [("#lib/*", ["./lib/*", "./gen/*"]), ("#m", ["./src/m.js"])]
    stems = ["m", "n", "x", "x.js", "m.js", "m.jsx", "m.d.ts", "a", "a/b", "b/m", "index", ".", "m.mjs", "x.json", "x.json.ts"]
    froms = [f for f in tree if f.endswith((".ts", ".js"))][:12]
    specs = {(r.choice(froms), h + s) for _ in range(900) for h in ["./", "../", "../../", "@/", "@/a/", "five/", "@al/", "@al/b/", "~/", "#lib/", "", "lib/", "/", "node:"] for s in [r.choice(stems)]}
    specs |= {(f, s) for f in froms[:3] for s in ["one", "#m", "..", ".", "@al", "x.css", "lodash", "a"]}
    df = spark.createDataFrame(sorted(specs), "path string, specifier string")
    configs = spark.createDataFrame([("tsconfig.json", "src", dict(config["paths"]), ".")], "path string, base_url string, paths map<string,array<string>>, paths_base string")
    al = spark.createDataFrame([(".", n, f, False, t) for n, (f, t) in enumerate(aliases)], "dir string, ord int, find string, exact boolean, target string")
    sub = spark.createDataFrame([(".", p, n, t) for p, ts in subpaths for n, t in enumerate(ts)], "dir string, pattern string, ord int, target string")
    files = spark.createDataFrame([(f,) for f in tree], "path string")
    got: dict = {}
    for x in modules.resolve(modules.routes(df, configs, al, sub), files).collect():
        got.setdefault((x.path, x.specifier), set()).add((x.file, x.via))
    want = {s: f for s in specs if (f := plain_resolve(set(tree), *s, config, aliases, subpaths))}
    assert got == want and {v for f in want.values() for _, v in f} == {"relative-import", "path-alias", "bundler-alias", "subpath-import"}


def test_import_statements(spark):
    text = """
import def, { one } from 'a'
import type { T } from "b"; import { type U, type V } from 'c'
import { type W, x } from 'd'
export * from 'e';export type { Y } from "b"
import 'side'
const f = require('f'), g = import( `g` ), h = import(`./h/${x}`)
// import 'no1'
/* import no2 from 'no2' */ const s = "// import 'kept'"; import i from 'i' // tail
import type Z from 'a'
"""
    df = spark.createDataFrame([("u", "u/x.ts", text, False), ("u", "u/x.py", "import 'no'", False)], FILES)
    got = {(r.specifier, r.type_only) for r in modules.js_imports(df).collect()}
    assert got == {("a", False), ("b", True), ("c", True), ("d", False), ("e", False), ("side", False), ("f", False), ("g", False), ("i", False)} | {s for s in got if s[0] == "kept"}
    assert {(r.specifier, r.kind) for r in modules.patterns(df).collect()} == {("./h/*", "template")}


def test_long_texts_are_read_without_recursion(spark):
    text = "const a = `" + "x\\n" * 40_000 + "`;\nconst b = \"" + "\\\"" * 40_000 + "\";\nimport z from './z'\n/*" + "*" * 100_000 + "*/"
    got = modules.js_imports(spark.createDataFrame([("u", "u/x.ts", text, False)], FILES)).collect()
    assert [r.specifier for r in got] == ["./z"]


def plain_pattern(base, kind):
    code = r"(?:\.(?:ts|tsx|d\.ts|js|jsx|mts|cts|mjs|cjs|json))"
    if kind == "template":
        return "^" + ".*".join(map(re.escape, base.split("*"))) + f"(?:{code}|/index{code})?$"
    out, i = "", 0
    while i < len(base):
        c = base[i]
        if base.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif base.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "{":
            end = base.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, base[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def test_patterns_over_many_paths(spark):
    """Files of patterns are those of a plain search of 10,000 paths, found by hash joins alone."""
    r = random.Random(9)
    word = lambda: r.choice(["a", "b", "cc", "loc", "en", "de", "x.y", "p(1)"])
    paths = sorted({"/".join(word() for _ in range(r.randint(1, 5))) + "/" + word() + r.choice([".ts", ".tsx", ".json", "/index.ts", ".md", ""]) for _ in range(14_000)})[:10_000]
    found = [
        ("q/f.ts", "../loc/*.ts", "template"), ("q/f.ts", "../a/*/en", "template"), ("q/f.ts", "../*", "template"), ("q/f.ts", "../a/b*c/*", "template"), ("q/f.ts", "../a/**/*.{ts,json}", "glob"), ("q/f.ts", "../b/?/en.ts", "glob"),
        ("q/f.ts", "../cc/*", "glob"), ("q/f.ts", "../p(1)/*.ts", "template"), ("q/f.ts", "../{a,b}/*.ts", "glob"), ("q/f.ts", "../a/*/*/*/*/*/*/*.ts", "template"), ("q/f.ts", "*.ts", "template"), ("q/f.ts", "../none/*", "glob"),
        ("q/f.ts", "../a/**", "glob"), ("q/f.ts", "../x.y/*.json", "template"),
    ]
    df = modules.resolve_patterns(spark.createDataFrame(found, "path string, specifier string, kind string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {(x.specifier, x.kind, x.file) for x in df.collect()}
    want = set()
    for path, spec, kind in found:
        if len(re.findall(r"\*+|\?", spec)) > 6 or re.match(r"[*?{]", spec):
            continue
        form = re.compile(plain_pattern(posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)), kind))
        want |= {(spec, kind, p) for p in paths if form.search(p)}
    assert got == want and len({s for s, *_ in want}) >= 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_target_of_a_pattern_is_a_row(spark):
    specs = spark.createDataFrame([("a/x.ts", "@/m")], "path string, specifier string")
    configs = spark.createDataFrame([("tsconfig.json", ".", {"@/*": [f"t{i}/*" for i in range(7)]}, ".")], "path string, base_url string, paths map<string,array<string>>, paths_base string")
    assert sorted((r.ord, r.base) for r in imports.through_paths(specs, configs).collect()) == [(i, f"t{i}/m") for i in range(7)]


def test_inheritance_goes_on_to_its_end(spark):
    rows = [(f"c{i}.json", [f"./c{i + 1}.json"], "base" if i == 40 else None, None) for i in range(41)]
    configs = spark.createDataFrame(rows, "path string, extends array<string>, base_url string, paths map<string,array<string>>")
    assert {r.path: r.base_url for r in imports.inherited(configs).collect()} == {f"c{i}.json": "base" for i in range(41)}


def test_a_compile_resolves_modules_and_events(spark, tmp_path):
    from loomgraph.plans.compile import Catalog, compile_checkout

    def put(path, text):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)

    for name in ("web", "lib", "db", "util", "locale", "shared"):
        put(f"{name}/package.json", '{"name": "@x/%s"%s}' % (name, ', "imports": {"#db/*": {"node": "./../db/*", "default": "./src/*"}}' if name == "web" else ""))
    put("tsconfig.base.json", '{"compilerOptions": {"paths": {"@lib/*": ["gone/*", "lib/src/*"]}, /* c */ "baseUrl": ".",}}')
    put("web/tsconfig.json", '{"extends": "../tsconfig.base"}')
    put("web/src/a.ts", "import { x } from '@lib/m';\nimport type { D } from '../../db/index.js'\nimport('@x/util/deep');\nconst l = import(`../../locale/${lang}.json`);\nbus.publish(PAID_SUBJECT)\n")
    put("lib/src/m.tsx", "export const x = 1\n")
    put("db/index.ts", "export type D = 1\n")
    put("locale/en.json", "{}")
    put("lib/src/t.test.ts", "import s from '../../shared/src/names'\n")
    put("shared/src/names.ts", "export const PAID_SUBJECT = 'order.paid.v1'\n")
    put("util/src/names.ts", "export const PAID_SUBJECT = 'order.paid.v2'\n")
    put("db/wrangler.toml", 'name = "db"\n[[services]]\nbinding = "U"\nservice = "util-worker"\n[[services]]\nbinding = "G"\nservice = "gone"\n[triggers]\ncrons = ["5 * * * *"]\n[vars]\nJOB = "https://x.example/api/run"\nNO = "https://x.example/api/no"\n')
    put("util/wrangler.jsonc", '{"name": "util-worker"}')
    put("shared/app/api/run/route.ts", "export {}\n")
    put("util/src/s3.ts", "new S3(); put('raws-2024')\n")
    put("catalog/data.yaml", "kind: Resource\nmetadata:\n  name: raws-store\n  description: D.\nspec:\n  type: logical-dataset\n")
    put(".github/workflows/ci.yml", "jobs:\n  a:\n    steps:\n      - run: pnpm --filter @x/lib test\n      - run: pytest TOKEN=abc\n")
    put("events.json", '{"order.paid.v2": {}, "order.lost.v1": {}}')
    g = compile_checkout(spark, str(tmp_path), catalog=Catalog(event_contracts=[("events.json", "json", "component:default/lib"), ("gone.json", "json", "component:default/lib")]))
    unit = lambda ref: ref.split("/")[1]
    got = {(r.type, unit(r.source_ref), unit(r.target_ref), *r.via) for r in g["relations"].where("type like '%On'").collect()}
    assert got == {("buildDependsOn", "web", "lib", "path-alias"), ("buildDependsOn", "web", "db", "relative-import"), ("buildDependsOn", "web", "util", "source-import"), ("buildDependsOn", "web", "locale", "dynamic-import"), ("testDependsOn", "lib", "shared", "relative-import")}
    second = {(r.type, unit(r.source_ref), r.target_ref.split("/")[1]) for r in g["relations"].where("type in ('runtimeCalls', 'schedules', 'usesResource')").collect()}
    assert second == {("runtimeCalls", "db", "util"), ("schedules", "db", "shared"), ("usesResource", "util", "raws-store")}
    assert {(unit(r.subject), r.key, r.value) for r in g["assertions"].collect()} == {("db", "binding.declared", '["G","U"]'), ("db", "binding.kind", '["service-binding"]'), ("db", "schedule.cron", '"5 * * * *"'), ("db", "schedule.enabled", "true"), ("db", "schedule.target", '["/api/no","/api/run"]')}
    assert {(r.id, tuple(map(unit, r.component_refs)), r.tier) for r in g["verification"].collect()} == {("ci:ci.yml:a:0:0", ("lib",), "unit")}
    assert [tuple(r) for r in g["gates"].collect()] == [("ci:ci.yml:a:1:0", "unit", "pytest TOKEN=[REDACTED]")]
    # shared is seen through lib as well; util comes later in order of roots, so its value counts
    assert {(r.pattern, r.resolution, tuple(map(unit, r.producers))) for r in g["events"].collect()} == {("order.paid.v2", "resolved", ("web",)), ("order.lost.v1", "unresolved", ())}
    assert {(r.severity, r.code, r.subject) for r in g["diagnostics"].collect()} == {("warning", "EVENT_UNRESOLVED", "order.lost.v1"), ("error", "PATH_UNRESOLVED", "gone.json"), ("warning", "SERVICE_BINDING_UNRESOLVED", "component:default/db"), ("warning", "SCHEDULE_UNRESOLVED", "component:default/db")}
