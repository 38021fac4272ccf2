"""Queries of whole contexts, gates and the union of relations over a graph that is bound from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure, indexes
from ..plans import context as plan
from ..sources import bindings as B
from .closures import DIST, RANKED, REACH
from .registry import CHECKS, EDGES, PART, REVERSE, query


def _graph(spark, d):
    p = B.table(spark, d, "part")
    r = B.ref("component/part", "p_partkey")
    k = F.col("p_partkey").cast("string")
    prov = lambda stem: F.array(F.concat(F.lit(stem), k)).alias("prov_ids")
    edges = B.part_edges(spark, d).withColumn("prov_ids", F.array(F.concat(F.lit("rel-"), "source_ref")))
    placed = p.select(F.lit("partOf").alias("type"), r.alias("source_ref"), F.concat(F.lit("system:tpch/"), F.col("p_size").cast("string")).alias("target_ref"), prov("place-"))
    return {
        "entities": p.select(r.alias("ref"), F.lit("Component").alias("kind"), F.concat(F.lit("part-"), k).alias("name"), F.col("p_name").alias("description"), F.concat(F.lit("p/"), k).alias("source_path"), F.array(F.concat(F.lit("doc/"), k, F.lit(".md"))).alias("docs"), prov("ent-")),
        "relations": edges.unionByName(placed),
        "verification": B.checks(spark, d).withColumn("prov_ids", F.array(F.concat(F.lit("chk-"), "id"))),
        "assertions": p.select(F.concat(F.lit("a-"), k).alias("id"), r.alias("subject"), F.lit("part.size").alias("key"), F.col("p_size").cast("string").alias("value"), F.lit("elected").alias("status"), prov("ass-")),
        "externals": p.select(r.alias("component"), F.col("p_brand").alias("name"), F.lit("dependency").alias("role"), prov("ext-")),
        "journeys": p.where("p_partkey % 10 = 0").select(F.concat(F.lit("j-"), k).alias("id"), F.array(r, B.ref("component/part", F.col("p_partkey") + 5)).alias("components")),
        "provenance": p.select(F.concat(F.lit("ent-"), k).alias("id"), F.lit("declared").alias("class"), F.concat(F.lit("p/"), k, F.lit("/x.yaml")).alias("path")),
        "inputs": p.select(F.concat(F.lit("p/"), k, F.lit("/x.yaml")).alias("path"), F.sha2("p_name", 256).alias("sha256")),
        "diagnostics": p.select(F.when(F.col("p_partkey") % 3 == 0, "warning").otherwise("error").alias("severity"), F.lit("X").alias("code"), r.alias("subject"), F.col("p_name").alias("message"), (F.col("p_partkey") % 2 == 0).alias("accepted")),
    }


#: Rows of the context of part 10, by section: keys, total.
CONTEXT = f"""with recursive {REVERSE}, seeds as (select {PART}10 as ref), build as (select ref, 0 as d from seeds union select r.dependent, 0 from build b join rev r on r.dependency = b.ref where not r.unit_only), {REACH}, {DIST}, {CHECKS}, {RANKED},
sys as (select {PART}p_partkey as source_ref, 'system:tpch/' || p_size as target_ref from part), me as (select {PART}10 as ref),
rel as (select type, 'out' as direction, target_ref as other from (select * from edges union all select 'partOf', * from sys) where source_ref = {PART}10 union all select type, 'in', source_ref from edges where target_ref = {PART}10 and source_ref <> {PART}10),
s as (select 'relations' as section, type || ' ' || direction || ' ' || other as item, row_number() over (order by type, direction, other) as position, 5 as n from rel
  union all select 'placement', other, row_number() over (order by other), 99 from (select distinct other from rel where type = 'partOf')
  union all select 'neighbours', other, row_number() over (order by other), 99 from (select distinct other from rel where direction = 'out' and other <> {PART}10)
  union all select 'verification', check_id, row_number() over (order by rank, check_id), 12 from ranked
  union all select 'assertions', 'part.size', 1, 25 from me union all select 'externals', p_brand, 1, 15 from part where p_partkey = 10 union all select 'constraints', 'doc/10.md', 1, 99 from me
  union all select 'journeys', id, row_number() over (order by id), 10 from (select 'j-' || p_partkey as id from part where p_partkey % 10 = 0 and (p_partkey = 10 or p_partkey + 5 = 10))
  union all select 'journey_peers', r, row_number() over (order by r), 99 from (select {PART}15 as r from part where p_partkey = 10 union select {PART}p_partkey from part where p_partkey % 10 = 0 and p_partkey + 5 = 10)
  union all select 'provenance', 'ent-10', 1, 20 from me union all select 'entity', ref, 1, 99 from me),
t as (select *, count(*) over (partition by section) as total from s)
select section, position::int as position, item, total, total > n as truncated from t where position <= n"""


@query(CONTEXT)
def context_query(spark, d):
    """The context of what `p/10/src/x.ts` lies in."""
    found = plan.query(spark, _graph(spark, d), "p/10/src/x.ts", {"relations": 5})
    of = lambda c: F.get_json_object("item", f"$.{c}")
    s = F.col("section")
    item = (
        F.when(s == "relations", F.concat_ws(" ", of("type"), of("direction"), of("other"))).when(s == "placement", of("other")).when(s.isin("neighbours", "journey_peers", "entity"), of("ref"))
        .when(s.isin("verification", "journeys", "provenance"), of("id")).when(s == "assertions", of("key")).when(s == "externals", of("name")).when(s == "constraints", of("path"))
    )
    return found.withColumn("item", item)


@query("select 'p/' || p_partkey || '/x.yaml' as path, case when p_partkey % 5 = 0 then 'removed' else 'changed' end as change from part where p_partkey % 5 = 0 or p_partkey % 3 = 0 union all select 'new/' || p_partkey, 'added' from part where p_partkey % 7 = 0")
def freshness_gate(spark, d):
    p, k = B.table(spark, d, "part"), F.col("p_partkey").cast("string")
    now = p.where("p_partkey % 5 <> 0").select(F.concat(F.lit("p/"), k, F.lit("/x.yaml")).alias("path"), F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("sha256"))
    fresh = p.where("p_partkey % 7 = 0").select(F.concat(F.lit("new/"), k).alias("path"), F.lit("x").alias("sha256"))
    return plan.check_fresh(_graph(spark, d), now.unionByName(fresh))


@query(f"select 'X' as code, {PART}p_partkey as subject, p_name as message from part where p_partkey % 3 = 0 and p_partkey % 2 <> 0")
def strict_gate(spark, d):
    return plan.strict_gate(_graph(spark, d))


@query("select 'entities' as section, count(*) as n from part union all select 'verification', count(*) from part union all select 'journeys', count(*) from part where p_partkey % 10 = 0")
def graph_stats(spark, d):
    g = _graph(spark, d)
    return plan.stats({k: g[k] for k in ("entities", "verification", "journeys")})


@query(f"with {EDGES} select row_number() over (order by type, source_ref, target_ref) as ord, type, source_ref, target_ref from edges")
def relation_order(spark, d):
    return plan.relation_order(B.part_edges(spark, d)).select("ord", "type", "source_ref", "target_ref")


@query(f"""with {EDGES}, a as (select 'partOf' as type, {PART}p_partkey as source_ref, 'system:tpch/' || p_size as target_ref, 'AUTHORED' as cls from part union all select 'providesApi', {PART}p_partkey, 'api:tpch/' || p_partkey, 'AUTHORED' from part
  union all select type, source_ref, target_ref, 'DERIVED' from edges union all select 'buildDependsOn', {PART}p_partkey, {PART}(p_partkey // 2), 'REVIEWED_OVERRIDE' from part where p_partkey % 4 = 0),
m as (select type, source_ref, target_ref, case when count(distinct cls) = 1 then min(cls) when bool_or(cls = 'REVIEWED_OVERRIDE') then 'REVIEWED_OVERRIDE' else 'DERIVED' end as evidence_class from a group by 1, 2, 3),
i(type, inverse) as (values ('partOf', 'hasPart'), ('providesApi', 'apiProvidedBy'), ('buildDependsOn', 'buildDependencyOf'), ('testDependsOn', 'testDependencyOf'))
select * from m union all select inverse, target_ref, source_ref, evidence_class from m join i using (type)""")
def relation_union(spark, d):
    p, k = B.table(spark, d, "part"), F.col("p_partkey")
    r = B.ref("component/part", "p_partkey")
    placed = p.select(F.lit("partOf").alias("type"), r.alias("source_ref"), F.concat(F.lit("system:tpch/"), F.col("p_size").cast("string")).alias("target_ref"), F.lit("d").alias("prov"))
    apis = p.select(F.concat(F.lit("api:tpch/"), k.cast("string")).alias("ref"), r.alias("provider"), F.lit("a").alias("prov"))
    found = B.part_edges(spark, d).select("type", "source_ref", "target_ref", F.expr("cast(map() as map<string,string>)").alias("attrs"), F.lit("x").alias("via"), F.lit("DERIVED").alias("evidence_class"), F.lit("e").alias("prov"))
    over = p.where("p_partkey % 4 = 0").select(F.lit("buildDependsOn").alias("type"), r.alias("source_ref"), B.ref("component/part", F.floor(k / 2).cast("long")).alias("target_ref"), F.lit("o").alias("prov"))
    return plan.all_edges(placed, apis, found, over).select("type", "source_ref", "target_ref", "evidence_class")


@query(f"""with {EDGES}, c as (select p_partkey as k from part where p_partkey % 40 = 3), s as (select {PART}k as ref, 'owns p/' || k || '/a.ts' as reason from c union all select {PART}k, 'documented by doc/' || k || '.md' from c)
select ref, string_agg(distinct reason, '; ' order by reason) as reasons from s group by 1""")
def change_reasons(spark, d):
    """Direct reasons of a change of files and of their documents; dependents have queries of their own."""
    p, k = B.table(spark, d, "part").where("p_partkey % 40 = 3"), F.col("p_partkey").cast("string")
    changed = p.select(F.explode(F.array(F.concat(F.lit("p/"), k, F.lit("/a.ts")), F.concat(F.lit("doc/"), k, F.lit(".md")))).alias("path"))
    g = _graph(spark, d)
    found = plan.impact_of(spark, {k: g[k] for k in ("entities", "verification", "inputs")}, changed)
    return found["affected"]


@query("""select p_partkey as unit, 'go' || case when p_partkey % 5 = 0 then ',rust' else '' end || case when p_partkey % 2 = 0 then ',ts' else '' end as langs,
  'a' || p_partkey || case when p_partkey % 2 = 0 then ',b' else '' end || case when p_partkey % 5 = 0 then ',a' || p_partkey else '' end as notes,
  'x=' || case when p_partkey % 2 = 0 then p_partkey + 1 else p_partkey end || case when p_partkey % 2 = 0 then ',y=1' else '' end || case when p_partkey % 5 = 0 then ',z=2' else '' end as links,
  case when p_partkey % 3 = 0 then 'importable' when p_partkey % 2 = 0 then 'deployable' end as shape from part""")
def derived_merge(spark, d):
    """Four extractors' findings about each part, merged by the kind of each field."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    none = {"langs": "array<string>", "notes": "array<string>", "links": "map<string,string>", "shape": "string"}

    def finding(on, n, **said):
        of = [F.lit(n).alias("ord"), *[(said[f] if f in said else F.lit(None).cast(kind)).alias(f) for f, kind in none.items()]]
        return F.when(on, F.struct(*of))

    many = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    note = F.concat(F.lit("a"), text)
    found = F.array_compact(F.array(
        finding(k % 5 == 0, 4, langs=many("rust"), notes=many(note), links=F.create_map(F.lit("z"), F.lit("2"))),
        finding(k >= 0, 1, langs=many("go"), notes=many(note), links=F.create_map(F.lit("x"), text)),
        finding(k % 3 == 0, 3, shape=F.lit("importable")),
        finding(k % 2 == 0, 2, langs=many("ts", "go"), notes=many("b"), links=F.create_map(F.lit("x"), (k + 1).cast("string"), F.lit("y"), F.lit("1")), shape=F.lit("deployable")),
    ))
    partials = B.table(spark, d, "part").select(k.alias("unit"), F.explode(found).alias("f")).select("unit", "f.*")
    m = indexes.merge_derived(partials, "unit", sets=("langs",), lists=("notes",), maps=("links",), scalars=("shape",))
    links = F.array_join(F.transform(F.array_sort(F.map_entries("links")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select("unit", F.array_join("langs", ",").alias("langs"), F.array_join("notes", ",").alias("notes"), links.alias("links"), "shape")
