"""Queries of parsers and extractors over manifests, contracts and source text that are written from the part table.

Part k is a unit `p/k`, which needs the parts k // 2 (to run) and k // 3 (to test).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, imports, own
from ..sources import authored, parsers
from ..sources.bindings import spread, table
from .registry import query

UNIT = "('p/' || a.p_partkey)"
#: Parts and the parts that they need.
NEEDS = "runs as (select a.p_partkey as k, b.p_partkey as m from part a join part b on b.p_partkey = a.p_partkey // 2 where a.p_partkey <> b.p_partkey), tests as (select a.p_partkey as k, b.p_partkey as m from part a join part b on b.p_partkey = a.p_partkey // 3 where a.p_partkey <> b.p_partkey)"


def _files(spark, d, name, text, is_test="false", **more):
    """(unit, path, text, is_test) of one file a part; in text and name, {k}, {half} and {third} stand for numbers."""
    k = F.col("p_partkey")
    number = {"k": k, "half": F.floor(k / 2).cast("long"), "third": F.floor(k / 3).cast("long"), **more}

    def filled(pattern):
        out = F.lit(pattern)
        for key, n in number.items():
            out = F.replace(out, F.lit(f"<{key}>"), n.cast("string"))
        return out

    p = spread(table(spark, d, "part"), "p_partkey")
    return p.select(filled("p/<k>").alias("unit"), filled(f"p/<k>/{name}").alias("path"), filled(text).alias("text"), F.expr(is_test).alias("is_test"))


def _two(run, test, via, package, source="'p/' || k", target="'p/' || m"):
    one = lambda of, rows: f"select '{of}' as type, {source} as source, {target} as target, '{via}' as via, {package} as package from {rows}"
    return f"with {NEEDS} {one(run, 'runs')} union {one(test, 'tests')}"


PACKAGE = '{"name": "@x/p-<k>", "dependencies": {"@x/p-<half>": "1", "lodash": "2"}, "devDependencies": {"@x/p-<third>": "*"}, "scripts": {"test": "t <k>", "lint:fix": "x", "dev": "d", "build": "b"}}'


@query(_two("buildDependsOn", "testDependsOn", "npm-manifest", "'@x/p-' || m"))
def node_edges(spark, d):
    return extract.node(_files(spark, d, "package.json", PACKAGE))[0]


@query(f"select {UNIT} || ':' || n as id, {UNIT} as unit, t as tier, replace(c, '#', a.p_partkey::varchar) as command from part a, (values ('test', 'unit', 't #'), ('build', 'build', 'b')) v(n, t, c)")
def node_checks(spark, d):
    return extract.node(_files(spark, d, "package.json", PACKAGE))[1]


GO_MOD = "module ex.org/p-<k>\n\ngo 1.21\n\nrequire (\n\tex.org/p-<half> v1.0.0\n\tgolang.org/x/net v0.1.0 // indirect\n)\nrequire ex.org/p-<third> v1.2.3\n"


@query(_two("buildDependsOn", "buildDependsOn", "go-module", "'ex.org/p-' || m"))
def go_edges(spark, d):
    return extract.go(_files(spark, d, "go.mod", GO_MOD))[0]


@query(f"select {UNIT} || ':go-' || n as id, {UNIT} as unit, t as tier, 'go ' || n || ' ./...' as command from part a, (values ('test', 'unit'), ('vet', 'static')) v(n, t)")
def go_checks(spark, d):
    return extract.go(_files(spark, d, "go.mod", GO_MOD))[1]


#: Every tenth part has one name with all other tenths.
SHARED = "case when {0} % 10 = 0 then 'same' else {0}::varchar end"
OWNED = f"names as (select {SHARED.format('p_partkey')} as name, count(*) as n, min(p_partkey) as m from part group by 1)"


def _shared(k):
    return F.when(k % 10 == 0, "same").otherwise(k.cast("string"))


def _crates(spark, d, name, text):
    k = F.col("p_partkey")
    return _files(spark, d, name, text, kn=_shared(k), hn=_shared(F.floor(k / 2)), tn=_shared(F.floor(k / 3)))


def _named_sql(run, test, via, package):
    part = lambda of, by: f"select '{of}' as type, 'p/' || p_partkey as source, 'p/' || m as target, '{via}' as via, {package} as package from part join names on name = {SHARED.format(by)} where n = 1 and m <> p_partkey"
    return f"with {OWNED} {part(run, '(p_partkey // 2)')} union {part(test, '(p_partkey // 3)')}"


PYPROJECT = '[project]\nname = "Py_Dist.<kn>"\ndependencies = ["py-dist-<hn>[extra]>=1.0", "requests ; python_version > \'3\'"]\n\n[dependency-groups]\ntest = ["py.dist_<tn>==2"]\n'


@query(_named_sql("buildDependsOn", "testDependsOn", "python-manifest", "'py-dist-' || name"))
def python_edges(spark, d):
    return extract.python(_crates(spark, d, "pyproject.toml", PYPROJECT))[0]


OPENAPI = '{"openapi": "3.0.0", "paths": {"/s/<k>": {"get": {"operationId": "get<k>"}, "post": {}}, "/s/<k>/x": {"parameters": [], "delete": {"operationId": "d"}}}}'
PROTO = 'syntax = "proto3";\n// service No { rpc A(B) returns (C); }\nservice Svc<k> {\n  rpc Get (GetReq) returns (stream GetRes);\n  rpc Put(PutReq) returns (PutRes) {}\n}\n'
GRAPHQL = "# type Query { no: Int }\ntype Query {\n  item<k>(id: ID!): Item\n}\ntype Item { id: ID! }\nextend type Mutation {\n  set<k>: Item\n}\n"


@query("""select 'p/' || p_partkey || '/' || f as path, kind, case when kind = 'protobuf' then 'Svc' || p_partkey else service end as service, replace(m, '#', p_partkey::varchar) as method, replace(r, '#', p_partkey::varchar) as route from part,
(values ('openapi.json', 'openapi', null, 'GET', '/s/#'), ('openapi.json', 'openapi', null, 'POST', '/s/#'), ('openapi.json', 'openapi', null, 'DELETE', '/s/#/x'), ('a.proto', 'protobuf', null, 'Get', null), ('a.proto', 'protobuf', null, 'Put', null),
 ('a.graphql', 'graphql', 'query', 'item#', null), ('a.graphql', 'graphql', 'mutation', 'set#', null)) v(f, kind, service, m, r)""")
def contract_operations(spark, d):
    files = _files(spark, d, "openapi.json", OPENAPI).unionByName(_files(spark, d, "a.proto", PROTO)).unionByName(_files(spark, d, "a.graphql", GRAPHQL))
    return extract.operations(files)




SCRIPT = "make test-<k> 'a b' \\\n  --fast && echo \"x\" # no\n\n# comment\ngo build ./<k>; true"


@query("select 'p/' || p_partkey as unit, n, replace(c, '#', p_partkey::varchar) as command, w as words from part, (values (0, 'make test-# ''a b'' --fast', 4), (1, 'echo \"x\"', 2), (2, 'go build ./#', 3), (3, 'true', 1)) v(n, c, w)")
def shell_split(spark, d):
    rows = parsers.rows(_files(spark, d, "s.sh", SCRIPT), "shell", "n int, command string, words array<string>")
    return rows.select("unit", "n", F.regexp_replace("command", " +", " ").alias("command"), F.size("words").alias("words"))


WRANGLER = 'name = "w<k>"\n\n[vars]\nLEVEL = "<k>"\n\n[[r2_buckets]]\nbinding = "B"\nbucket_name = "b-<k>"\n\n[[d1_databases]]\nbinding = "D"\ndatabase_name = "d-<half>"\n\n[[services]]\nbinding = "S"\nservice = "w<half>"\n\n[triggers]\ncrons = ["0 * * * *"]\n\n[[queues.producers]]\nbinding = "Q"\nqueue = "q-<third>"\n'


@query("select 'p/' || a.p_partkey as unit, kind, binding, replace(replace(replace(t, '#k', a.p_partkey::varchar), '#h', (a.p_partkey // 2)::varchar), '#t', (a.p_partkey // 3)::varchar) as target from part a, (values ('r2_buckets', 'B', 'b-#k'), ('d1_databases', 'D', 'd-#h'), ('queue', 'Q', 'q-#t'), ('service', 'S', 'w#h'), ('cron', '', '0 * * * *'), ('var', 'LEVEL', '#k')) v(kind, binding, t)")
def edge_manifest(spark, d):
    return parsers.rows(_files(spark, d, "wrangler.toml", WRANGLER), "wrangler", "kind string, binding string, target string").select("unit", "kind", "binding", "target")


PLAYBOOK = "- hosts: web<k>\n  roles:\n    - base\n  tasks:\n    - name: install\n      ansible.builtin.apt:\n        name: pkg-<half>\n    - block:\n        - service:\n            name: svc-<k>\n      when: x\n"


@query("select 'p/' || p_partkey as unit, 'web' || p_partkey as hosts, m as module, case n when 'h' then 'pkg-' || (p_partkey // 2) when 'k' then 'svc-' || p_partkey else n end as name from part, (values ('ansible.builtin.apt', 'h'), ('service', 'k'), ('role', 'base')) v(m, n)")
def playbook_tasks(spark, d):
    return parsers.rows(_files(spark, d, "site.yml", PLAYBOOK), "playbook", "hosts string, module string, name string").select("unit", "hosts", "module", "name")


@query("with w as (select p_partkey as k, 'pkg-' || p_partkey as installs from part), h as (select distinct 'pkg-' || (p_partkey // 2) as installs from part union select distinct 'svc-' || p_partkey from part) select k, installs, case when installs in (select installs from h) then 'provided' else 'absent' end as verdict from w")
def requirement_ladder(spark, d):
    tasks = parsers.rows(_files(spark, d, "site.yml", PLAYBOOK), "playbook", "hosts string, module string, name string")
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("pkg-"), F.col("p_partkey").cast("string")).alias("installs"))
    return extract.requirements_met(wanted, tasks).select("k", "installs", "verdict")


JS = "import a from '@x/p-<half>/lib';\nimport type { T } from \"@x/p-<third>\";\nconst z = require('./local');\n// import no from 'nope'\n/* import no2 from '@x/p-1' */\n"


def _names(spark, d, pattern="@x/p-"):
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(F.concat(F.lit(pattern), k).alias("name"), F.concat(F.lit("p/"), k).alias("unit"), F.col("p_partkey").alias("ord"))


def _imports_sql(via, package):
    return f"with {NEEDS} select case when k % 4 = 0 then 'testDependsOn' else 'buildDependsOn' end as type, 'p/' || k as source, 'p/' || m as target, '{via}' as via, {package} as package from (select * from runs union select * from tests)"


@query(_imports_sql("source-import", "'@x/p-' || m"))
def js_import_edges(spark, d):
    return extract.source_imports(_files(spark, d, "src/a.ts", JS, "p_partkey % 4 = 0"), _names(spark, d), "js")


@query("select 'p/' || p_partkey as unit, case s when 'h' then '@x/p-' || (p_partkey // 2) || '/lib' when 't' then '@x/p-' || (p_partkey // 3) else s end as name, s = 't' as type_only from part, (values ('h'), ('t'), ('./local')) v(s)")
def js_import_lines(spark, d):
    return parsers.rows(_files(spark, d, "src/a.ts", JS), "js_imports", "name string, type_only boolean").select("unit", "name", "type_only")


@query(_imports_sql("python-import", "'p_' || m"))
def python_import_edges(spark, d):
    text = "import p_<half>.x as y, os\nfrom p_<third> import z\nfrom . import q\n"
    return extract.source_imports(_files(spark, d, "a.py", text, "p_partkey % 4 = 0"), _names(spark, d, "p_"), "python")


@query("select 'p/' || p_partkey as unit, k as kind, replace(n, '#', p_partkey::varchar) as name, l as line, case when c < 0 then -c + length(p_partkey::varchar) else c end as col from part, (values ('declaration', 'f#', 1, 17), ('declaration', 'T#', 2, 11), ('reference', 'f#', 4, 1), ('reference', 'T#', 4, -3)) v(k, n, l, c)")
def typescript_symbols(spark, d):
    text = "export function f<k>() {}\ninterface T<k> { a: number }\n// f<k>\nf<k>(T<k>);\n"
    rows = parsers.rows(_files(spark, d, "src/b.ts", text), "symbols", "kind string, name string, line int, col int")
    return rows.select("unit", "kind", "name", "line", "col")


@query("select 'p/' || p_partkey as root, 'p/' || p_partkey || '/' || f as path, a as adapter, s as shape from part, (values ('package.json', 'node', 'importable'), ('Dockerfile', 'dockerfile', 'deployable'), ('k8s/deployment.yaml', 'deploy-config', 'deployable'), ('heroku.yml', 'deploy-config', 'deployable'), ('go.mod', 'go', 'both')) v(f, a, s)")
def unit_markers(spark, d):
    files = None
    for name in ("package.json", "Dockerfile", "k8s/deployment.yaml", "heroku.yml", "go.mod", "skaffold.yaml", "README.md"):
        one = _files(spark, d, name, "x")
        files = one if files is None else files.unionByName(one)
    return extract.markers(files)


SOURCE = "app.listen(<port>)\nrouter.get('/healthz')\npublish('order.<k>.made')\nsubscribe(\"order.<half>.made\")\nconst bucketName = 'data-<third>'\nconst x = '.well-known/openid-configuration'; use(access_token)\n<more>\n"


def _source(spark, d):
    k = F.col("p_partkey")
    return _files(spark, d, "src/s.ts", SOURCE, "p_partkey % 7 = 6", port=3000 + k % 9, more=F.when(k % 5 == 0, "EXPOSE 8080").otherwise(""))


@query("select 'p/' || p_partkey as unit, n as name from part, (values ('orders'), ('health')) v(n) where p_partkey % 7 <> 6")
def declared_capabilities(spark, d):
    return extract.capabilities(_source(spark, d), [("orders", r"order\.\d+"), ("health", "/healthz"), ("none", "nothing-of-this")])


def _deps(spark, d):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("pg", "ioredis", "@aws-sdk/client-s3", "stripe", "lodash")]), (k % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("p/"), (k % 50).cast("string")).alias("unit"), name.alias("name"))


@query("with d as (select distinct 'p/' || (p_partkey % 50) as unit, (['pg', 'ioredis', '@aws-sdk/client-s3', 'stripe', 'lodash'])[p_partkey % 5 + 1] as n from part) select unit, case n when 'pg' then 'resource:x/sql' else 'resource:x/cache' end as resource, n as client from d where n in ('pg', 'ioredis')")
def client_resources(spark, d):
    """Clients of a type with one resource; of the two buckets none is meant."""
    rows = (("sql", "sql"), ("cache", "cache"), ("bucket", "b1"), ("bucket", "b2"))
    resources = spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(f"resource:x/{r}").alias("ref")) for t, r in rows])))
    return extract.client_resources(_deps(spark, d), [("^pg$", "sql"), ("redis", "cache"), ("client-s3", "bucket")], resources)


@query("with d as (select distinct 'p/' || (p_partkey % 50) as unit, (['pg', 'ioredis', '@aws-sdk/client-s3', 'stripe', 'lodash'])[p_partkey % 5 + 1] as n from part) select unit, case n when 'stripe' then 'Payments' else 'Objects' end as name, 'dependency' as role, case n when 'stripe' then 'sdk' else 'api' end as mechanism from d where n in ('stripe', '@aws-sdk/client-s3')")
def external_matches(spark, d):
    return extract.externals(_deps(spark, d), [("^stripe$", "Payments", "sdk", "dependency"), ("^@aws-sdk/", "Objects", "api", "dependency")])


@query("select 'p/' || p_partkey as unit, 'resource:x/' || (p_partkey % 9) as resource from part where p_partkey % 2 = 0 and p_partkey % 3 = 0")
def database_uses(spark, d):
    k = F.col("p_partkey")
    unit = F.concat(F.lit("p/"), k.cast("string")).alias("unit")
    p = table(spark, d, "part")
    return extract.database_uses(p.where("p_partkey % 2 = 0").select(unit, F.concat(F.lit("resource:x/"), (k % 9).cast("string")).alias("resource")), p.where("p_partkey % 3 = 0").select(unit))


@query("select p_partkey as k, case p_partkey % 4 when 0 then 'm/' || p_partkey when 1 then 'm/' || p_partkey || '.ts' when 2 then 'm/' || p_partkey || '/index.js' end as file from part")
def module_candidates(spark, d):
    """The first of base, base with an ending, and an index file that exists."""
    k = F.col("p_partkey")
    base = F.concat(F.lit("m/"), k.cast("string"))
    p = table(spark, d, "part").select(k.alias("k"), base.alias("base"))
    files = p.select(F.explode(F.when(F.col("k") % 4 == 0, F.array("base", F.concat("base", F.lit(".js")))).when(F.col("k") % 4 == 1, F.array(F.concat("base", F.lit(".js")), F.concat("base", F.lit(".ts")))).when(F.col("k") % 4 == 2, F.array(F.concat("base", F.lit("/index.js"))))).alias("path"))
    return imports.resolve_candidates(p, files, [".ts", ".js"]).select("k", "file")


@query("select p_partkey as k, case p_partkey % 4 when 0 then 'src/lib/' || p_partkey when 1 then 'exact' when 2 then 'src/' || p_partkey end as resolved from part")
def alias_resolution(spark, d):
    k = F.col("p_partkey")
    n = k.cast("string")
    specs = table(spark, d, "part").select(k.alias("k"), F.when(k % 4 == 0, F.concat(F.lit("@/lib/"), n)).when(k % 4 == 1, F.lit("@/lib/one")).when(k % 4 == 2, F.concat(F.lit("@/"), n)).otherwise("other").alias("specifier"))
    aliases = spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("pattern"), F.lit(t).alias("target")) for a, t in (("@/*", "src/*"), ("@/lib/*", "src/lib/*"), ("@/lib/one", "exact"))])))
    return imports.alias_targets(specs, aliases).select("k", "resolved")


@query("with u as (select p_partkey % 40 as source, p_partkey % 23 as target, p_size % 3 = 0 as t from part) select source, target, case when bool_and(t) then 'testDependsOn' else 'buildDependsOn' end as type from u where source <> target group by 1, 2")
def import_edge_types(spark, d):
    k = F.col("p_partkey")
    return imports.build_and_test(table(spark, d, "part").select((k % 40).alias("source"), (k % 23).alias("target"), (F.col("p_size") % 3 == 0).alias("is_test")))


@query("select 'p' || p_partkey || '/' || x as path from part, (values ('a'), ('b/c')) v(x) where p_partkey % 2 = 0 and not (p_partkey % 6 = 0) and x = 'a'")
def workspace_members(spark, d):
    k = F.col("p_partkey")
    n = F.concat(F.when(k % 2 == 0, F.when(k % 6 == 0, "p6").otherwise("p")).otherwise("q"), F.lit("-"), k.cast("string"))
    dirs = table(spark, d, "part").select(F.explode(F.array(F.concat(n, F.lit("/a")), F.concat(n, F.lit("/b/c")))).alias("path"))
    return own.workspace_members(dirs, ["p*/*"], ["!p6*/*"]).select(F.concat(F.lit("p"), F.regexp_extract("path", "-([0-9]+)", 1), F.lit("/"), F.regexp_extract("path", "/(.*)$", 1)).alias("path"))


@query("select p_partkey as k, case when p_partkey % 3 = 0 then 'a/b' when p_partkey % 3 = 1 then 'a' else '.' end as config_dir from part")
def nearest_config(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 3 == 0, "a/b/c/").when(k % 3 == 1, "a/x/").otherwise("z/"), k.cast("string"))
    configs = spark.range(0, 1, 1, 1).select(F.explode(F.array(F.lit("."), F.lit("a"), F.lit("a/b"), F.lit("zz"))).alias("dir"))
    return own.nearest_config(table(spark, d, "part").select(k.alias("k"), path.alias("path")), configs).select("k", "config_dir")


@query("select 'r' || (p_partkey % 60) as root, bool_or(p_partkey % 60 % 7 = 0) as explicit from part where not (p_partkey % 60 in (5, 14, 21)) or p_partkey % 60 % 7 = 0 group by 1")
def candidate_units(spark, d):
    k = F.col("p_partkey") % 60
    root = F.concat(F.lit("r"), k.cast("string")).alias("root")
    p = table(spark, d, "part")
    roots = own.candidate_roots(p.select(root, F.lit(False).alias("explicit")), p.where("p_partkey % 60 % 7 = 0").select(root, F.lit(True).alias("explicit")))
    return own.not_units(roots, ["r5", "r14", "r21"])


@query("""select p_partkey as k, (p_partkey % 7 in (0, 4, 6)) as ok from part""")
def one_sentence(spark, d):
    k = F.col("p_partkey")
    ends = F.array(*[F.lit(x) for x in (".", "", ". And more.", ". and more.", "!", "\nmore.", "  ?")])
    t = F.concat("p_name", F.element_at(ends, (k % 7 + 1).cast("int")))
    return table(spark, d, "part").select(k.alias("k"), T.one_sentence(t).alias("ok"))


#: Configuration k extends that of k // 2, and a package's where k is a multiple of 7.
_TS = """c as (select p_partkey as k, p_partkey % 3 = 0 as has_base, p_partkey % 5 = 0 as has_paths from part),
up as (select k, k // 2 as m, 0 as turn from c where k > 0 and k // 2 in (select k from c) union all select k, k % 4, -1 from c where k % 7 = 0 and k > 4 and k % 4 in (select k from c)),
w as (select k, k as pos, []::int[] as place, [k] as trail from c union all select w.k, up.m, w.place || [up.turn], w.trail || [up.m] from w join up on up.k = w.pos where not list_contains(w.trail, up.m))"""


def _configs(spark, d):
    k = F.col("p_partkey")
    n = k.cast("string")
    half = F.when(k > 0, F.concat(F.lit("../"), F.floor(k / 2).cast("long").cast("string"), F.lit("/tsconfig")))
    package = F.when((k % 7 == 0) & (k > 4), F.concat(F.lit("@x/p-"), (k % 4).cast("string")))
    return table(spark, d, "part").select(
        F.concat(F.lit("p/"), n, F.lit("/tsconfig.json")).alias("path"), F.array_compact(F.array(half, package)).alias("extends"), F.when(k % 3 == 0, F.lit("./src/../lib")).alias("base_url"),
        F.when(k % 5 == 0, F.create_map(F.lit("~/*.js"), F.array(F.concat(F.lit("a"), n, F.lit("/*")), F.lit("b/*")), F.lit("one"), F.array(F.lit("only")))).alias("paths"),
    )


_CHAIN = f"{_TS}, b as (select k, arg_min(pos, place) filter (pos % 3 = 0) as base, arg_min(pos, place) filter (pos % 5 = 0) as paths from w group by 1)"


@query(f"with recursive {_CHAIN} select 'p/' || k || '/tsconfig.json' as path, 'p/' || base || '/lib' as base_url, 'p/' || paths as paths_base from b")
def config_chain(spark, d):
    return imports.inherited(_configs(spark, d), _names(spark, d).select("name", F.col("unit").alias("root"))).select("path", "base_url", "paths_base")


@query(f"""with recursive {_CHAIN} select k, o as ord, case when k % 2 = 0 then coalesce('p/' || base || '/lib', 'p/' || paths) || '/' || case o when 0 then 'a' || paths else 'b' end || '/x' || k else coalesce('p/' || base || '/lib', 'p/' || paths) || '/only' end as base
from b, (values (0), (1)) v(o) where paths is not null and (k % 2 = 0 or o = 0)""")
def path_mapping(spark, d):
    k = F.col("p_partkey")
    n = k.cast("string")
    specs = table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("p/"), n, F.lit("/src/a.ts")).alias("path"), F.when(k % 2 == 0, F.concat(F.lit("~/x"), n, F.lit(".js"))).otherwise("one").alias("specifier"))
    found = imports.inherited(_configs(spark, d), _names(spark, d).select("name", F.col("unit").alias("root")))
    return imports.through_paths(specs, found).select("k", "ord", "base")


@query("select p_partkey as k, case when p_partkey % 2 = 0 then 'p/' || p_partkey || '/lib/x' else 'p/' || p_partkey || '/db.js' end as base from part where p_partkey % 5 <> 0")
def own_subpaths(spark, d):
    k = F.col("p_partkey")
    unit = F.concat(F.lit("p/"), k.cast("string"))
    p = table(spark, d, "part")
    specs = p.select(k.alias("k"), unit.alias("unit"), F.when(k % 2 == 0, "#lib/x").otherwise("#db").alias("specifier"))
    maps = p.where("p_partkey % 5 <> 0").select(unit.alias("unit"), F.inline(F.array(F.struct(F.lit("#lib/*").alias("pattern"), F.lit("./lib/*").alias("target")), F.struct(F.lit("#db").alias("pattern"), F.lit("./db.js").alias("target")))))
    return imports.own_subpaths(specs, maps).select("k", "base")


DESCRIPTORS = """apiVersion: x/v1
kind: Component
metadata:
  name: part-<k>
  description: "Part number <k>."
spec:
  type: service
  system: sys-<s>
  context:
    docs:
      - docs/<k>.md
---
apiVersion: x/v1
kind: API
metadata:
  name: api-<k>
spec:
  type: openapi
  provider: component:default/part-<half>
  contract:
    ref: api/<k>.yaml
---
apiVersion: x/v1
kind: System
metadata:
  name: only-<k>
spec:
  domain: dom-<third>
"""


def _entities(spark, d):
    return authored.descriptors(_files(spark, d, "agent.yaml", DESCRIPTORS, s=F.col("p_partkey") % 9))[0]


@query("""select 'component:default/part-' || p_partkey as ref, 'p/' || p_partkey as source_path, 'docs/' || p_partkey || '.md' as docs, 1 as line from part union all select 'api:default/api-' || p_partkey, null, '', 13 from part union all select 'system:default/only-' || p_partkey, null, '', 23 from part""")
def descriptor_entities(spark, d):
    return _entities(spark, d).select("ref", "source_path", F.array_join("docs", ",").alias("docs"), "line")


@query("""select 'partOf' as type, 'component:default/part-' || p_partkey as source_ref, 'system:default/sys-' || (p_partkey % 9) as target_ref from part union all select 'partOf', 'system:default/only-' || p_partkey, 'domain:default/dom-' || (p_partkey // 3) from part
union all select 'providesApi', 'component:default/part-' || (p_partkey // 2), 'api:default/api-' || p_partkey from part""")
def authored_edges(spark, d):
    e = _entities(spark, d)
    provides = authored.providers(e).select(F.lit("providesApi").alias("type"), F.col("provider").alias("source_ref"), F.col("ref").alias("target_ref"))
    return authored.placements(e).select("type", "source_ref", "target_ref").unionByName(provides)


@query("select 'api:default/api-' || p_partkey as ref from part union all select 'system:default/only-' || p_partkey from part")
def descriptor_locations(spark, d):
    return authored.misplaced(_entities(spark, d), "agent.yaml", {"API": "catalog/apis.yaml"}).select("ref")


JOURNEYS = "journeys:\n  - id: j-<k>\n    description: x\n    components:\n      - component:default/part-<k>\n      - component:default/part-<next>\n"


@query("select 'j-' || p_partkey as id, 'component:default/part-' || (p_partkey + 3) as ref from part where p_partkey + 3 not in (select p_partkey from part)")
def journey_refs(spark, d):
    files = _files(spark, d, "journeys.yaml", JOURNEYS, next=F.col("p_partkey") + 3)
    return authored.journeys(files, _entities(spark, d))[1]


OBSERVED = """kind: ObservationSet
metadata:
  name: set-<k>
  environment: prod
  capturedAt: "2024-01-02T03:04:05Z"
  maxAgeDays: 30
  evidenceBundle: ev/<e>.json
spec:
  facts:
    - id: a
      subject: component:default/part-<next>
      key: port
      value: <k>
    - id: b
      subject: component:default/part-<k>
      key: <key>
      value: [1, 2]
"""


def _observed(spark, d):
    k = F.col("p_partkey")
    files = _files(spark, d, "obs.yaml", OBSERVED, e=k % 10, next=k + 2, key=F.when(k % 4 == 0, "port").otherwise("paths"))
    inputs = table(spark, d, "part").where("p_partkey % 10 <> 7").select(F.concat(F.lit("ev/"), (k % 10).cast("string"), F.lit(".json")).alias("path")).distinct()
    return authored.observations(files, _entities(spark, d), inputs)


@query("""select 'set-' || p_partkey as "set", 'port' as key, 'unresolved-subject' as problem from part where p_partkey + 2 not in (select p_partkey from part) union all select 'set-' || p_partkey, 'port', 'repeated-key' from part where p_partkey % 4 = 0 union all select 'set-' || p_partkey, null, 'absent-bundle' from part where p_partkey % 10 = 7""")
def observation_problems(spark, d):
    return _observed(spark, d)[1].select("set", "key", "problem")


@query("""select 'component:default/part-' || (p_partkey + 2) as subject, 'port' as key, p_partkey::varchar as value_json, 'OBSERVED_RUNTIME' as evidence_class, '2024-01-02T03:04:05Z' as observed_at from part union all select 'component:default/part-' || p_partkey, case when p_partkey % 4 = 0 then 'port' else 'paths' end, '[1, 2]', 'OBSERVED_RUNTIME', '2024-01-02T03:04:05Z' from part""")
def observation_facts(spark, d):
    return authored.fact_rows(_observed(spark, d)[0]).select("subject", "key", "value_json", "evidence_class", "observed_at")


OVERRIDES = """reviewedOverrides:
  - fact: runtime-call
    subject: component:default/part-<sub>
    target: component:default/part-<half>
    reason: seen
    reviewWhen: later
    evidence:
      - path: <where>
        sha256: <sum>
"""


@query("""with o as (select p_partkey as k, p_partkey % 6 as c from part) select 'p/' || k || '/config.yaml' as path, case when c = 0 then 'unresolved-subject' when c = 1 then 'absent-evidence' when c = 2 then 'changed-evidence' when c = 3 then 'outside-scope' end as problem from o where c < 4""")
def override_problems(spark, d):
    return _overridden(spark, d)[1].select("path", "problem")


@query("select 'component:default/part-' || p_partkey as subject, 'component:default/part-' || (p_partkey // 2) as target, 'later' as review_when from part where p_partkey % 6 >= 4")
def reviewed_overrides(spark, d):
    return _overridden(spark, d)[0].select("subject", "target", "review_when")


def _overridden(spark, d):
    """Overrides of six kinds: no subject, no evidence, changed evidence, evidence elsewhere, by the subject, by the target."""
    k, c = F.col("p_partkey"), F.col("p_partkey") % 6
    n, half = k.cast("string"), F.floor(k / 2).cast("long").cast("string")
    where = F.when(c == 1, F.concat(F.lit("gone/"), n)).when(c == 3, F.concat(F.lit("far/"), n)).when(c == 5, F.concat(F.lit("p/"), half, F.lit("/ev"))).otherwise(F.concat(F.lit("p/"), n, F.lit("/ev")))
    sums = F.sha2(F.when(c == 2, F.lit("other")).otherwise(where), 256)
    files = _files(spark, d, "config.yaml", OVERRIDES, sub=F.when(c == 0, F.concat(F.lit("none-"), n)).otherwise(n), where=where, sum=sums)
    p = table(spark, d, "part").select(where.alias("path"), c.alias("c")).where("c <> 1").select("path").distinct()
    return authored.overrides(files, _entities(spark, d), p.select("path", F.sha2("path", 256).alias("sha256")))


TURBO = '{"tasks": {"test": {}, "build": {}, "dev": {}, "e2e": {}}}'


def _graph_files(spark, d):
    """Manifests of all parts, a task graph at the root of all, and one of its own in every fourth part."""
    files = _files(spark, d, "package.json", PACKAGE)
    top = spark.range(0, 1, 1, 1).select(F.lit(".").alias("unit"), F.lit("turbo.json").alias("path"), F.lit(TURBO).alias("text"), F.lit(False).alias("is_test"))
    inner = _files(spark, d, "turbo.json", '{"pipeline": {"build": {}}}').where(F.regexp_extract("unit", "([0-9]+)$", 1).cast("long") % 4 == 0)
    return files.unionByName(top).unionByName(inner)


@query("""select 'tg:component:x/' || p_partkey || ':' || t as id, 'p/' || p_partkey as unit, tier, 'turbo run ' || t || ' --filter=@x/p-' || p_partkey as command, case when p_partkey % 4 = 0 then 'p/' || p_partkey || '/turbo.json' else 'turbo.json' end as config_path
from part, (values ('test', 'unit'), ('build', 'build')) v(t, tier) where p_partkey % 4 <> 0 or t = 'build'""")
def task_graph_checks(spark, d):
    refs = table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("unit"), F.concat(F.lit("component:x/"), F.col("p_partkey").cast("string")).alias("ref"))
    return extract.task_graph(_graph_files(spark, d), refs)[0]


@query("select 'p/' || p_partkey as root from part")
def workspace_roots(spark, d):
    top = spark.range(0, 1, 1, 1).select(F.lit(".").alias("unit"), F.lit("pnpm-workspace.yaml").alias("path"), F.lit('packages:\n  - "p/*"\n  - "../x/*"\n  - "*"\n  - q/**/*\n').alias("text"), F.lit(False).alias("is_test"))
    deep = _files(spark, d, "deep/package.json", "{}")
    return extract.workspace_roots(_files(spark, d, "package.json", PACKAGE).unionByName(deep).unionByName(top))
