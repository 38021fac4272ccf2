"""Queries of validation, index, provenance, context, impact and packet operators that have no query elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, contracts, elect, evaluate, impact, indexes, own, packets, provenance, validate
from ..sources import bindings as B
from .registry import EDGES, PART, query

def _k():
    return F.col("p_partkey")


def _parts(spark, d):
    return B.table(spark, d, "part")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(n, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


SCHEMA = {
    "type": "object", "required": ["name", "size"], "additionalProperties": False,
    "properties": {"name": {"type": "string", "maxLength": 12, "pattern": "^[a-z]"}, "size": {"$ref": "#/$defs/size"}, "tags": {"type": "array", "maxItems": 1, "items": {"enum": ["a", "b"]}}},
    "$defs": {"size": {"type": "integer", "minimum": 10}},
}


def _documents(spark, d):
    """One JSON document a part, of six kinds: right, too small, without a size, of a wrong type, with an odd key, broken."""
    name, k = F.lit('{"name": "part", '), _k() % 6
    doc = (
        F.when(k == 0, _text('{"name": "part", "size": ', _k() + 10, "}")).when(k == 1, F.lit('{"name": "part", "size": 3}')).when(k == 2, F.lit('{"name": "Part", "tags": ["a", "c"]}'))
        .when(k == 3, F.concat(name, F.lit('"size": 1.5}'))).when(k == 4, F.concat(name, F.lit('"size": 12, "colour": 1}'))).otherwise(F.lit("[1, 2]"))
    )
    return _parts(spark, d).select(_k().alias("k"), doc.alias("doc"))


@query("""select p_partkey as k, p as instance_path, w as keyword from part, (values (1, '/size', 'minimum'), (2, '', 'required'), (2, '/name', 'pattern'), (2, '/tags', 'maxItems'), (2, '/tags/1', 'enum'), (3, '/size', 'type'), (4, '', 'additionalProperties'), (5, '', 'type')) v(c, p, w) where p_partkey % 6 = c""")
def schema_violations(spark, d):
    found = validate.validate_json(_documents(spark, d), "doc", SCHEMA)
    return found.select("k", F.explode("violations").alias("v")).select("k", "v.instance_path", "v.keyword")


@query("select p_partkey as k, case p_partkey % 6 when 0 then '' when 1 then '/size must be 10 at least' when 3 then '/size must be integer' when 4 then ' must not have colour' when 5 then ' must be object' else ' must have size; /name must match ^[a-z]' end as summary from part")
def schema_summary(spark, d):
    found = validate.validate_json(_documents(spark, d), "doc", SCHEMA)
    return found.select("k", validate.summary(F.col("violations"), 2).alias("summary"))


@query("select p_partkey as k, (p_partkey % 2 = 0)::int + (p_partkey % 3 = 0)::int = 1 as ok from part")
def placement_exclusive(spark, d):
    return _parts(spark, d).select(_k().alias("k"), validate.exactly_one(F.when(_k() % 2 == 0, "system"), F.when(_k() % 3 == 0, "domain")).alias("ok"))


@query("select 'm/' || (p_partkey % 70) as path, count(distinct p_size % 4) as n from part group by 1 having count(distinct p_size % 4) > 1")
def multi_owned_paths(spark, d):
    return validate.multi_owned(_parts(spark, d).select(_text("m/", _k() % 70).alias("path"), (F.col("p_size") % 4).alias("owner")))


TYPES = ("service", "library", "job", "cli", "static-site", "contract-library", "web-app", "other")


@query(f"""with e as (select {PART}p_partkey as ref, ({list(TYPES)})[p_partkey % 8 + 1] as t, p_size % 2 = 0 as runs, p_size % 3 = 0 as loads from part),
x as (select *, t in ('service', 'job', 'static-site', 'web-app') as runner, t in ('library', 'cli', 'contract-library') as loader from e)
select ref, 'error' as severity from x where runner and not runs or loader and not loads union all select ref, 'warning' from x where loader and runs and not loads""")
def artifact_types(spark, d):
    p = _parts(spark, d)
    e = p.select(B.ref("component/part", "p_partkey").alias("ref"), _pick(_k() % 8, *TYPES).alias("component_type"), _k().alias("source_path"))
    return validate.artifact_types(e, p.select(_k().alias("root"), (F.col("p_size") % 2 == 0).alias("deployable"), (F.col("p_size") % 3 == 0).alias("importable")))


@query("""with c as (select 'c/' || (p_partkey % 90) as ref, p_partkey % 7 as api from part where p_partkey % 5 <> 0), f as (select distinct 'c/' || (p_partkey % 120) as ref from part), n as (select ref, count(distinct api) as n from c group by 1)
select ref, 'shared' as verdict from n where n > 1 union all select ref, 'unclaimed' from f where ref not in (select ref from n)""")
def contract_claims(spark, d):
    p = _parts(spark, d)
    return contracts.claims(p.where("p_partkey % 5 <> 0").select(_text("c/", _k() % 90).alias("ref"), (_k() % 7).alias("api_ref")), p.select(_text("c/", _k() % 120).alias("ref")))


ENDS = (".ts", ".md", "/docs/x.go", ".go", "/package.json", ".yaml", "/Makefile", ".rst")


@query(f"with f as (select 'u/' || p_partkey || ({list(ENDS)})[p_partkey % 8 + 1] as path, p_partkey % 8 as c from part) select path from f where c in (0, 3, 4, 6)")
def contract_reference_sites(spark, d):
    return contracts.reference_sites(_parts(spark, d).select(_text("u/", _k(), _pick(_k() % 8, *ENDS)).alias("path")))


@query("with e as (select p_partkey as k, (['order.', '.bad', 'user.x', 'order y', ''])[p_partkey % 5 + 1] || case when p_partkey % 5 < 4 then p_partkey::varchar else '' end as pattern from part) select k, pattern, p_ok as ok from (select *, k % 5 = 0 as p_ok from e)")
def plausible_events(spark, d):
    roles = _parts(spark, d).select(_k().alias("k"), F.concat(_pick(_k() % 5, "order.", ".bad", "user.x", "order y", ""), F.when(_k() % 5 < 4, _k().cast("string")).otherwise("")).alias("pattern"))
    good, bad = indexes.split_plausible(roles, ["order."])
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


@query("select 'g-' || (p_partkey % 60) as id, arg_min(p_name, p_partkey) as title, string_agg(distinct (p_size % 6)::varchar, ',' order by (p_size % 6)::varchar) as prov from part group by 1")
def gates_merge(spark, d):
    rows = _parts(spark, d).select(_text("g-", _k() % 60).alias("id"), F.col("p_name").alias("title"), _k().alias("ord"), (F.col("p_size") % 6).cast("string").alias("prov"))
    return indexes.first_wins(rows, ["id"]).select("id", "title", F.array_join("prov", ",").alias("prov"))


@query("select distinct p_brand as extractor, (p_size % 3)::varchar as version from part")
def extractor_set(spark, d):
    return provenance.extractors(_parts(spark, d).select(F.col("p_brand").alias("extractor"), (F.col("p_size") % 3).cast("string").alias("version"), _k()))


@query("with p as (select p_partkey % 20 as k from part) select 'same' as verdict, true as ok union all select 'changed', false union all select 'repeated', false")
def graph_byte_equality(spark, d):
    """A section equals itself in any order, not one with a row changed, nor one with a row more."""
    p = _parts(spark, d).select(_k(), "p_name")
    cases = {"same": p.orderBy(F.desc("p_partkey")), "changed": p.withColumn("p_name", F.when(_k() == 1, "x").otherwise(F.col("p_name"))), "repeated": p.unionByName(p.where(_k() == 1))}
    rows = [F.struct(F.lit(name).alias("verdict"), F.lit(provenance.same_rows(p, other)).alias("ok")) for name, other in cases.items()]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


@query(f"""with r as (select (['runtimeCalls', 'schedules', 'buildDependsOn', 'scheduledBy'])[p_partkey % 4 + 1] as type, p_partkey as s, p_size as t from part)
select {PART}t as ref, type || ' ' || {PART}s as reason from r where type <> 'buildDependsOn' and s in (select p_partkey from part where p_partkey % 3 = 0)""")
def first_degree_calls(spark, d):
    p = _parts(spark, d)
    r = p.select(_pick(_k() % 4, "runtimeCalls", "schedules", "buildDependsOn", "scheduledBy").alias("type"), B.ref("component/part", "p_partkey").alias("source_ref"), B.ref("component/part", "p_size").alias("target_ref"))
    return impact.first_degree(r, p.where("p_partkey % 3 = 0").select(B.ref("component/part", "p_partkey").alias("ref")))


@query(f"""with i as (select 'e' || (p_partkey % 80) as pattern, {PART}p_size as ref from part union select 'e' || (p_partkey % 80), {PART}(p_size + 1) from part where p_partkey % 2 = 0 union select distinct 'e' || (p_partkey % 80), 'component:o/' || (p_partkey % 80 % 9) from part)
select distinct ref, pattern from i where ref in (select {PART}p_partkey from part) or ref like 'component:o/%'""")
def event_ownership(spark, d):
    p = _parts(spark, d)
    size = lambda n: F.concat(F.lit("component:tpch/part-"), (F.col("p_size") + n).cast("string"))
    g = p.groupBy(_text("e", _k() % 80).alias("pattern")).agg(F.collect_set(size(0)).alias("producers"), F.collect_set(F.when(_k() % 2 == 0, size(1))).alias("consumers"), F.min(_text("c", _k() % 80)).alias("contract_ref"))
    owner = p.select(_text("c", _k() % 80).alias("contract_ref"), _text("component:o/", _k() % 80 % 9).alias("owner_ref")).distinct()
    subjects = p.select(B.ref("component/part", "p_partkey").alias("ref")).unionByName(owner.select(F.col("owner_ref").alias("ref"))).distinct()
    return context.event_owners(g, owner, subjects)


@query("select distinct p_brand as ref, unnest([p_size % 9, p_size % 5]) as prov_id from part union select distinct p_brand, p_size % 11 from part")
def section_provenance(spark, d):
    p = _parts(spark, d)
    n = F.col("p_size")
    return context.collected_provenance([p.select(F.col("p_brand").alias("ref"), F.array(n % 9, n % 5).alias("prov_ids")), p.select(F.col("p_brand").alias("ref"), F.array(n % 11).alias("prov_ids"))])


@query("select p_partkey as k, case p_partkey % 4 when 0 then 'db/migrations/old' when 1 then 'db/migrations' when 2 then 'svc/migrations' end as migration_dir, case p_partkey % 4 when 0 then 'declared' when 1 then 'declared' when 2 then 'detected' end as made_by from part")
def migration_hits(spark, d):
    files = _parts(spark, d).select(_k().alias("k"), _text(_pick(_k() % 4, "db/migrations/old/", "db/migrations/", "svc/migrations/", "src/"), _k(), ".sql").alias("path"))
    dirs = lambda *xs: spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(x) for x in xs])).alias("root"))
    return impact.migration_hits(files, dirs("db/migrations", "db/migrations/old"), dirs("svc/migrations", "db")).select("k", "migration_dir", "made_by")


@query("select p_brand as ref, 'checked by cfg/' || (p_partkey % 30) as reason from part where p_partkey % 30 % 4 = 0")
def config_change(spark, d):
    p = _parts(spark, d)
    checks = p.select(F.array("p_brand").alias("component_refs"), F.array(_text("cfg/", _k() % 30), F.lit("other")).alias("config_paths"))
    return impact.config_users(checks, p.where("p_partkey % 30 % 4 = 0").select(_text("cfg/", _k() % 30).alias("path")).distinct())


@query("select p_brand as ref, 'documented by doc/' || p_partkey || '.md' as reason from part where p_partkey % 5 = 0")
def document_change(spark, d):
    p = _parts(spark, d)
    return impact.document_users(p.select(F.col("p_brand").alias("ref"), _text("doc/", _k(), ".md").alias("path")), p.where("p_partkey % 5 = 0").select(_text("doc/", _k(), ".md").alias("path")))


@query(f"select 'j' || p_partkey as id from part where p_size in (select p_partkey from part where p_partkey % 7 = 1) or p_size + 1 in (select p_partkey from part where p_partkey % 7 = 1)")
def related_journeys(spark, d):
    p = _parts(spark, d)
    n = F.col("p_size").cast("long")
    journeys = p.select(_text("j", _k()).alias("id"), F.array(n, n + 1).alias("components"))
    return impact.related(journeys, p.where("p_partkey % 7 = 1").select(_k().alias("ref"))).select("id")


@query("select 'r' || (p_partkey % 70) as id, arg_max(p_name, p_partkey) as value from part group by 1")
def record_put(spark, d):
    return packets.put(_parts(spark, d).select(_text("r", _k() % 70).alias("id"), F.col("p_name").alias("value"), _k().alias("ord"))).select("id", "value")


@query("""select p_partkey as k, substr(sha256('["fact","part-' || p_partkey || '","' || p_brand || '"]'), 1, 24) as id, substr(sha256(p_name), 1, 24) as version from part""")
def record_identity(spark, d):
    return _parts(spark, d).select(_k().alias("k"), packets.record_id(F.lit("fact"), _text("part-", _k()), F.col("p_brand")).alias("id"), packets.record_version(F.col("p_name")).alias("version"))


@query(f"with {EDGES} select count(*) as n, count(distinct source_ref) as sources, false as stale from edges")
def stale_probe(spark, d):
    """A change of paths that are no inputs does not make the graph stale; the counts are of the edges it would keep."""
    e = B.part_edges(spark, d)
    stale = impact.will_be_stale(_parts(spark, d).select(_text("z/", _k()).alias("path")), _parts(spark, d).select(_text("a/", _k()).alias("path")))
    return e.agg(F.count("*").alias("n"), F.count_distinct("source_ref").alias("sources")).withColumn("stale", F.lit(stale))


CONTRACTS = [
    ("openapi", "openapi: 3.0.1\ninfo:\n  title: t\npaths: {}\ncomponents: {}\n", None), ("openapi", "swagger: 2\n", "missing 'openapi' version field"), ("openapi", '{"openapi": "2.0"}', "openapi must be 3.0 or 3.1, got 2.0"),
    ("openapi", '{"openapi": "3.1.0", "paths": {}, "info": {"title": "x"}}', "missing 'components' object"), ("asyncapi", "asyncapi: 2.0.0\nx: 1\n", "missing 'channels' object"), ("protobuf", 'syntax = "proto3";\nservice S {}', None),
    ("protobuf", "message M {}", "missing syntax or edition declaration"), ("graphql", "query { a }", "no GraphQL type definitions found"), ("thrift", "x", "unsupported contract type thrift"), ("oidc", "x", None),
]


@query("select 'c/' || p_partkey as path, p as problem from part, (values " + ", ".join(f"({i}, '{p.replace(chr(39), chr(39) * 2)}')" for i, (_, _, p) in enumerate(CONTRACTS) if p) + ") v(c, p) where p_partkey % 10 = c")
def contract_syntax(spark, d):
    k = (_k() % 10).cast("int")
    pick = lambda at: F.get(F.array(*[F.lit(c[at]) for c in CONTRACTS]), k)
    return contracts.syntax_problems(B.spread(_parts(spark, d), "p_partkey").select(_text("c/", _k()).alias("path"), pick(0).alias("type"), pick(1).alias("text")))


@query("select 'api:x/' || p_partkey as ref from part where p_partkey % 3 <> 0")
def oidc_without_discovery(spark, d):
    p = _parts(spark, d)
    routes = p.select(_k().alias("unit"), F.when(_k() % 3 == 0, "/auth/.well-known/openid-configuration").otherwise("/auth").alias("route"))
    return contracts.without_discovery(p.select(_text("api:x/", _k()).alias("ref"), _k().alias("unit")), routes)


@query("""select 'r' || (p_partkey // 2) as id, 'duplicate id' as problem from part group by 1 having count(*) > 1 union all select 'r' || (p_partkey // 2), 'cannot elect UNRESOLVED' from part where p_partkey % 5 = 0 union all select 'r' || (p_partkey // 2), 'invalid keyPattern' from part where p_partkey % 7 = 0""")
def rule_problems(spark, d):
    classes = F.array_compact(F.array(F.lit("DERIVED"), F.when(_k() % 5 == 0, "UNRESOLVED")))
    pattern = F.when(_k() % 7 == 0, "a(b").otherwise(r"^a\\(b[(]+(c|d)$")
    return elect.rule_problems(_parts(spark, d).select(_text("r", F.floor(_k() / 2).cast("long")).alias("id"), pattern.alias("key_pattern"), classes.alias("elect")))


@query("""select p_partkey as subject, 'req' as key, case when p_partkey % 6 = 1 then 'only a heuristic candidate exists' when p_partkey % 5 = 0 then 'no adapter is named as able to derive it' when p_partkey % 5 = 1 then 'not enabled: terraform' when p_partkey % 5 = 2 then 'nothing to look for' else 'no evidence derived' end as why
from part where p_partkey % 6 <> 0""")
def requirement_unverified(spark, d):
    p = _parts(spark, d)
    by = F.when(_k() % 5 == 0, F.array().cast("array<string>")).when(_k() % 5 == 1, F.array(F.lit("ansible"), F.lit("terraform"))).otherwise(F.array(F.lit("ansible")))
    wanted = p.select(_k().alias("subject"), F.lit("req").alias("key"), F.when(_k() % 5 != 2, "x").alias("expects"), by.alias("satisfied_by"))
    facts = p.where("p_partkey % 6 < 3").select(_k().alias("subject"), F.lit("req").alias("key"), F.when(_k() % 6 == 1, "candidate").otherwise("deterministic").alias("confidence"), (_k() % 6 == 2).alias("normative"))
    return elect.unverified_requirements(wanted, facts, ["ansible"])


@query("""with s as (select distinct p_brand as scenario, p_partkey as c from part where p_size % 3 > 0), i as (select p_partkey as c from part where p_partkey % 4 > 0), b as (select distinct p_brand as scenario from part union select 'none')
select scenario, count(c) as n_selected, round(case when count(c) = 0 then 0 else 1 - count(c) filter (c in (select c from i)) / count(c) end, 4) as irrelevant from b left join s using (scenario) group by 1""")
def selectivity(spark, d):
    p = _parts(spark, d)
    mine = p.where("p_size % 3 > 0").select(F.col("p_brand").alias("scenario"), _k().alias("check"))
    near = p.where("p_partkey % 4 > 0").select(F.col("p_brand").alias("scenario"), _k().alias("check"))
    all_ = p.select(F.col("p_brand").alias("scenario")).unionByName(spark.range(0, 1, 1, 1).select(F.lit("none").alias("scenario"))).distinct()
    return evaluate.selectivity(mine, near, all_)


@query("select p_brand as corpus, round(avg(p_size * 4))::bigint as full_size, case when round(avg(p_size * 4)) >= 100 then round(1 - sum(p_size)::double / sum(p_size * 4), 4) end as reduction from part group by 1")
def size_reduction(spark, d):
    n = F.col("p_size").cast("long")
    return evaluate.reduction(_parts(spark, d).select(F.col("p_brand").alias("corpus"), n.alias("n_retrieved"), (n * 4).alias("n_full")), "corpus")


@query("""select 'u/' || p_partkey as root, case n when 'README.md' then 'docs' else 'runbooks' end as kind, 'u/' || p_partkey || '/' || n as path from part, (values (0, 'README.md'), (1, 'ONCALL.md'), (2, 'README.md'), (2, 'RUNBOOK.md')) v(c, n) where p_partkey % 4 = c
union all select 'u/' || p_partkey, 'docs', 'far/' || p_partkey || '.md' from part where p_partkey % 4 = 3""")
def unit_documents(spark, d):
    p = _parts(spark, d)
    root = _text("u/", _k())
    names = F.when(_k() % 4 == 0, F.array(F.lit("README.md"), F.lit("other.md"))).when(_k() % 4 == 1, F.array(F.lit("ONCALL.md"))).when(_k() % 4 == 2, F.array(F.lit("README.md"), F.lit("RUNBOOK.md")))
    files = p.select(root.alias("root"), F.explode(names).alias("n")).select(F.concat_ws("/", "root", "n").alias("path"))
    declared = p.where("p_partkey % 4 = 3").select(root.alias("root"), F.lit("docs").alias("kind"), _text("far/", _k(), ".md").alias("path"))
    return own.unit_documents(p.select(root.alias("root")), files, {"docs": ["README.md"], "runbooks": own.RUNBOOKS}, declared)


@query("""select p_partkey as k, substr(sha256('["g' || (p_partkey % 3) || '","part-' || p_partkey || '","40"]'), 1, 24) as id, p_partkey % 3 <> 1 as stale, 'o1,o2' as old from part""")
def packet_freshness(spark, d):
    p = _parts(spark, d)
    ids = packets.packet_id(_text("g", _k() % 3), _text("part-", _k()), F.lit(40))
    sets = spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("captured_at"), F.lit(n).alias("max_age_days")) for i, t, n in (("o1", "2024-01-01 00:00:00", 5), ("o2", "2024-01-09 00:00:00", 1), ("o3", "2024-01-09 00:00:00", 9))])))
    found = packets.stale_packets(p.select(_k().alias("k"), ids.alias("id"), _text("g", _k() % 3).alias("graph_hash")), "g1", sets, F.lit("2024-01-11 12:00:00"))
    return found.select("k", "id", "stale", F.array_join("stale_observations", ",").alias("old"))


@query("""with r as (select (['declared', 'observed', 'guessed'])[p_partkey % 3 + 1] as class, 'f/' || (p_partkey % 60) as path, 's' || (p_partkey % 11) as subject from part), i as (select distinct 'f/' || (p_partkey % 50) as path from part)
select class, path, string_agg(distinct subject, ',' order by subject) as subjects, null as problem from r where class <> 'guessed' and path in (select path from i) group by 1, 2
union all select distinct class, path, null, case when class = 'guessed' then 'unknown-class' else 'no-input' end from r where class = 'guessed' or path not in (select path from i)""")
def provenance_records(spark, d):
    p = _parts(spark, d)
    raw = p.select(_pick(_k() % 3, "declared", "observed", "guessed").alias("class"), _text("f/", _k() % 60).alias("path"), F.lit("Docs Extractor").alias("extractor"), _text("s", _k() % 11).alias("subject"))
    inputs = p.select(_text("f/", _k() % 50).alias("path")).distinct().withColumn("sha256", F.sha2("path", 256))
    good, bad = provenance.records(raw, inputs)
    none = F.lit(None).cast("string")
    return good.select("class", "path", F.array_join("subjects", ",").alias("subjects"), none.alias("problem")).unionByName(bad.select("class", "path", none.alias("subjects"), "problem"))


@query("select 'f' || p_partkey as path, case when p_partkey % 2 = 0 then 'rel:' || p_partkey else 'ent:' || p_partkey end as subject from part")
def provenance_rebind(spark, d):
    p = _parts(spark, d)
    raw = p.select(_text("f", _k()).alias("path"), F.when(_k() % 2 == 0, "rel:pending").otherwise(_text("ent:", _k())).alias("subject"))
    return provenance.rebound(raw, p.select(_text("f", _k()).alias("path"), _text("rel:", _k()).alias("subject")))
