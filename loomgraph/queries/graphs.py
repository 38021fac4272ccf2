"""Queries of relations, validation, context, events, checks, contracts and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, contracts, imports, indexes, own, provenance, relations, validate
from ..sources import bindings as B
from .closures import api_edges
from .registry import CHECKS, EDGES, SEGS, query


@query("""with o as (select o_orderkey, 'resource:tpch/customer-' || (o_custkey + 10) as target from orders), r as (select 'resource:tpch/customer-' || c_custkey as ref from customer)
select o_orderkey, target from o where target not in (select ref from r)""")
def dangling_refs(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", B.ref("resource", F.col("o_custkey") + 10).alias("target"))
    return validate.dangling(o, "target", B.table(spark, d, "customer").select(B.ref("resource", "c_custkey").alias("ref")))


@query("select doc_id from (select doc_id, row_number() over (partition by sha256(text) order by doc_id) as r from documents) where r > 1")
def duplicate_identity(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    return validate.duplicates(docs, ["identity"], "doc_id").select("doc_id")


LINE = "le as (select 'usesResource' as type, 'component:tpch/supplier-' || l_suppkey as source_ref, 'resource:tpch/part-' || (l_partkey % 50) as target_ref, 'client=\"' || l_linestatus || '\"' as attrs_key, l_returnflag as via, (['DERIVED', 'AUTHORED', 'DERIVED', 'DERIVED', 'REVIEWED_OVERRIDE'])[l_linenumber % 5 + 1] as cls, l_orderkey as prov from lineitem)"


def _line_edges(spark, d):
    cls = F.element_at(F.array(*[F.lit(x) for x in ("DERIVED", "AUTHORED", "DERIVED", "DERIVED", "REVIEWED_OVERRIDE")]), F.col("l_linenumber") % 5 + 1)
    attrs = F.create_map(F.lit("client"), "l_linestatus", F.lit("via"), "l_returnflag")
    e = B.table(spark, d, "lineitem").select(
        F.lit("usesResource").alias("type"), B.ref("component/supplier", "l_suppkey").alias("source_ref"), B.ref("resource/part", F.col("l_partkey") % 50).alias("target_ref"), attrs.alias("attrs"),
        F.col("l_returnflag").alias("via"), cls.alias("evidence_class"), F.col("l_orderkey").alias("prov"),
    )
    return relations.identity(e)


@query(f"with {LINE} select type, source_ref, target_ref, attrs_key, string_agg(distinct via, ',' order by via) as via, count(*) as n, count(distinct prov) as n_prov, case when count(distinct cls) = 1 then min(cls) when bool_or(cls = 'REVIEWED_OVERRIDE') then 'REVIEWED_OVERRIDE' else 'DERIVED' end as evidence_class from le group by 1, 2, 3, 4")
def relation_identity_merge(spark, d):
    m = relations.merge(_line_edges(spark, d))
    return m.select("type", "source_ref", "target_ref", "attrs_key", F.array_join("via", ",").alias("via"), "n", "n_prov", "evidence_class")


PLACED = "pl as (select 'partOf' as type, 'system:tpch/nation-' || n_nationkey as source_ref, 'domain:tpch/region-' || n_regionkey as target_ref from nation union all select 'partOf', 'component:tpch/supplier-' || s_suppkey, 'system:tpch/nation-' || s_nationkey from supplier)"


@query(f"with {PLACED} select * from pl union all select 'hasPart', target_ref, source_ref from pl")
def relation_inverse(spark, d):
    return relations.with_inverses(B.placement(spark, d))


@query(f"with {PLACED}, h as (select 'hasPart' as type, target_ref as source_ref, source_ref as target_ref from pl where length(source_ref) % 3 <> 0) select * from pl where (target_ref, source_ref) not in (select (source_ref, target_ref) from h) ")
def inverse_missing(spark, d):
    p = B.placement(spark, d)
    h = p.where("length(source_ref) % 3 <> 0").select(F.lit("hasPart").alias("type"), F.col("target_ref").alias("source_ref"), F.col("source_ref").alias("target_ref"))
    return relations.missing_inverses(p.unionByName(h))


@query(f"""with {PLACED}, odd as (select case when length(source_ref) % 4 = 0 then 'providesApi' when length(source_ref) % 7 = 0 then 'likes' else type end as type, source_ref, case when right(source_ref, 1) = '3' then target_ref || '9' else target_ref end as target_ref from pl),
refs as (select 'domain:tpch/region-' || r_regionkey as ref from region union all select 'system:tpch/nation-' || n_nationkey from nation union all select 'component:tpch/supplier-' || s_suppkey from supplier)
select *, 'unknown-type' as problem from odd where type = 'likes' union all select *, 'kind-pair' from odd where type = 'providesApi' union all select *, 'unresolved-target' from odd where target_ref not in (select ref from refs)""")
def kind_pair_violations(spark, d):
    n = F.length("source_ref")
    odd = B.placement(spark, d).select(F.when(n % 4 == 0, "providesApi").when(n % 7 == 0, "likes").otherwise(F.col("type")).alias("type"), "source_ref", F.when(F.col("source_ref").endswith("3"), F.concat("target_ref", F.lit("9"))).otherwise(F.col("target_ref")).alias("target_ref"))
    refs = B.entities(spark, d).where("kind in ('domain', 'system', 'component') and ref not like '%/part-%'")
    return relations.violations(odd, refs)


@query("""with c as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then 'carrier-pigeon' else 'grpc' end as transport, l_linenumber % 2 = 0 as has from lineitem)
select l_orderkey, l_linenumber, 'transport' as problem from c where transport <> 'grpc' union all select l_orderkey, l_linenumber, 'contract-ref' from c where not has union all select l_orderkey, l_linenumber, 'attribute:colour' from c where l_linenumber = 4""")
def attribute_violations(spark, d):
    return _attribute_violations(B.table(spark, d, "lineitem"))


def _attribute_violations(lines):
    n = F.col("l_linenumber")
    attrs = F.map_concat(F.create_map(F.lit("transport"), F.when(n % 3 == 0, "carrier-pigeon").otherwise("grpc")), F.when(n % 2 == 0, F.create_map(F.lit("contractRef"), F.lit("api:x/y"))).otherwise(F.expr("map()").cast("map<string,string>")), F.when(n == 4, F.create_map(F.lit("colour"), F.lit("red"))).otherwise(F.expr("map()").cast("map<string,string>")))
    c = lines.select(F.lit("runtimeCalls").alias("type"), F.col("l_orderkey").cast("string").alias("source_ref"), n.cast("string").alias("target_ref"), attrs.alias("attrs"))
    return relations.attribute_violations(c).select(F.col("source_ref").cast("long").alias("l_orderkey"), F.col("target_ref").cast("int").alias("l_linenumber"), "problem")


@query("""with e as (select distinct o_orderkey % 2 as odd, 'usesResource' as type, 'component:tpch/supplier-' || l_suppkey as source_ref, 'resource:tpch/customer-' || o_custkey as target_ref from lineitem join orders on l_orderkey = o_orderkey),
a as (select type, source_ref, target_ref from e where odd = 0), b as (select type, source_ref, target_ref from e where odd = 1) select *, 'shared' as side from (select * from a intersect select * from b) union all select *, 'left' from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a)""")
def graph_diff(spark, d):
    return _graph_diff(B.table(spark, d, "lineitem"), B.table(spark, d, "orders"))


def _graph_diff(lines, o):
    l = lines.select("l_orderkey", "l_suppkey")
    e = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select((F.col("o_orderkey") % 2).alias("odd"), F.lit("usesResource").alias("type"), B.ref("component/supplier", "l_suppkey").alias("source_ref"), B.ref("resource", "o_custkey").alias("target_ref"))
    return relations.diff(e.where("odd = 0"), e.where("odd = 1"))


@query("""with l as (select distinct l_orderkey, l_suppkey from lineitem), p as (select l_orderkey, min(l_suppkey) as s from l group by 1), c as (select l.l_orderkey, l_suppkey as s from l join p using (l_orderkey) where l_suppkey <> p.s),
calls as (select s, l_orderkey from c where s % 2 = 0 union all select s, l_orderkey + 1 from c where s % 2 = 1)
select 'component:tpch/supplier-' || s as source_ref, 'api:tpch/order-' || l_orderkey as contract, c.s is not null as dropped from (select distinct * from calls) left join c using (s, l_orderkey)""")
def contract_duplicate_calls(spark, d):
    return _duplicate_calls(api_edges(spark, d))


def _duplicate_calls(e):
    c = e.where("type = 'consumesApi'")
    s, k = F.split_part("source_ref", F.lit("-"), F.lit(-1)).cast("long"), F.split_part("target_ref", F.lit("-"), F.lit(-1)).cast("long")
    call = c.select(F.lit("runtimeCalls").alias("type"), "source_ref", B.ref("api", F.when(s % 2 == 0, k).otherwise(k + 1)).alias("contract")).distinct()
    both = call.select("type", "source_ref", F.lit("component:x/y").alias("target_ref"), F.create_map(F.lit("contractRef"), "contract").alias("attrs")).unionByName(c.withColumn("attrs", F.expr("cast(map() as map<string,string>)")))
    return relations.contract_duplicates(both).where("type = 'runtimeCalls'").select("source_ref", F.col("attrs")["contractRef"].alias("contract"), "dropped")


@query(f"""with {SEGS}, n as (select page_id, case page_id % 5 when 0 then 'system:tpch/nation-' || (page_id % 40) else path end as needle, path from paths),
ent as (select 'system:tpch/nation-' || n_nationkey as ref from nation), docs as (select path, min('component:d/' || lpad(page_id::varchar, 6, '0')) as ref from paths where page_id % 4 = 1 group by 1),
own as (select string_split(path, '/')[1] as root, min('component:o/' || lpad(page_id::varchar, 6, '0')) as ref from paths where page_id % 3 = 0 group by 1), con as (select path as cref, min('api:c/' || lpad(page_id::varchar, 6, '0')) as ref from paths where page_id % 7 = 2 group by 1),
h as (select needle, ref, 1 as p, 'ref' as how from n join ent on needle = ref union all select needle, d.ref, 2, 'doc' from n join docs d on d.path = needle union all select needle, o.ref, 3, 'owner' from n join own o on page_id % 5 <> 0 and (needle = root or starts_with(needle, root || '/'))
  union all select needle, c.ref, 4, 'contract' from n join con c on page_id % 5 <> 0 and (needle = cref or starts_with(needle, cref || '/')) union all select needle, 'component:o/root', 5, 'root-owner' from n where page_id % 5 <> 0),
b as (select needle, arg_min((ref, how), (p, ref)) as x from h group by 1)
select page_id, x[1] as ref, x[2] as how from n left join b using (needle)""".replace("arg_min((ref, how), (p, ref)) as x", "arg_min([ref, how], (p, ref)) as x"))
def resolve_precedence(spark, d):
    p = B.url_paths(spark, d)
    n = p.select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("system:tpch/nation-"), (F.col("page_id") % 40).cast("string"))).otherwise(F.col("path")).alias("needle"))
    pad = F.lpad(F.col("page_id").cast("string"), 6, "0")
    docs = p.where("page_id % 4 = 1").select("path", F.concat(F.lit("component:d/"), pad).alias("ref"), F.col("page_id").alias("ord"))
    roots = p.where("page_id % 3 = 0").groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).agg(F.min(F.concat(F.lit("component:o/"), pad)).alias("ref"))
    roots = roots.unionByName(spark.range(0, 1, 1, 1).select(F.lit(".").alias("root"), F.lit("component:o/root").alias("ref")))
    con = p.where("page_id % 7 = 2").groupBy(F.col("path").alias("ref")).agg(F.min(F.concat(F.lit("api:c/"), pad)).alias("api_ref"))
    return context.resolve(n, B.entities(spark, d).where("kind = 'system'"), docs, roots, con).select("page_id", "ref", "how")


@query(f"with {EDGES}, r as (select source_ref as ref, type, target_ref as other, 'out' as direction from edges union all select target_ref, type, source_ref, 'in' from edges), s as (select *, row_number() over (partition by ref order by type, direction, other) as position, count(*) over (partition by ref) as total from r) select ref, type, other, direction, position::int as position, total, total > 3 as truncated from s where position <= 3")
def context_budget(spark, d):
    e = B.part_edges(spark, d)
    subjects = B.table(spark, d, "part").select(B.ref("component/part", "p_partkey").alias("ref"))
    return context.section(context.relations_of(e, subjects), "ref", ["type", "direction", "other"], 3)


@query(f"with {EDGES} select distinct source_ref as ref, target_ref as other from edges where source_ref <> target_ref")
def neighbours(spark, d):
    return context.neighbours(B.part_edges(spark, d), B.table(spark, d, "part").select(B.ref("component/part", "p_partkey").alias("ref")))


@query(f"with {EDGES}, r as (select source_ref as ref, count(*) as n from (select source_ref from edges union all select target_ref from edges) group by 1) select ref, 'relations' as section, 3::bigint as shown, n as total from r where n > 3")
def truncation_report(spark, d):
    e = B.part_edges(spark, d)
    subjects = B.table(spark, d, "part").select(B.ref("component/part", "p_partkey").alias("ref"))
    return context.truncations({"relations": context.section(context.relations_of(e, subjects), "ref", ["type", "direction", "other"], 3)})


@query("select 'override' as source, 'part-' || p_partkey as subject, 'size ' || p_size as review_when from part where p_size > 45 union all select 'election', s_name, 'nation ' || s_nationkey from supplier where s_nationkey < 3 union all select 'acceptance', n_name, 'region ' || n_regionkey from nation where n_regionkey = 1")
def review_commitments(spark, d):
    when = lambda c, w, x: F.when(c, F.concat(F.lit(w), F.col(x).cast("string"))).alias("review_when")
    o = B.table(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("subject"), when(F.col("p_size") > 45, "size ", "p_size"))
    e = B.table(spark, d, "supplier").select(F.col("s_name").alias("subject"), when(F.col("s_nationkey") < 3, "nation ", "s_nationkey"))
    a = B.table(spark, d, "nation").select(F.col("n_name").alias("subject"), when(F.col("n_regionkey") == 1, "region ", "n_regionkey"))
    return context.commitments(o, e, a)


ROLES = "roles as (select event_type || '.' || (user_id % 7) || '.v' || (event_id % 3) as pattern, case when event_type in ('purchase', 'signup') then 'producer' else 'consumer' end as role, 'component:u/' || (user_id % 11) as component, event_id as ord from events)"


def _roles(spark, d):
    e = B.table(spark, d, "events")
    part = lambda c, m: (F.col(c) % m).cast("string")
    return e.select(F.concat("event_type", F.lit("."), part("user_id", 7), F.lit(".v"), part("event_id", 3)).alias("pattern"), F.when(F.col("event_type").isin("purchase", "signup"), "producer").otherwise("consumer").alias("role"),
                    F.concat(F.lit("component:u/"), part("user_id", 11)).alias("component"), F.lit(None).cast("string").alias("contract_ref"), F.col("event_id").alias("ord"))


@query(f"""with {ROLES}, f(family, ord) as (values ('click.*', 3), ('click.1*', 1), ('view.>', 2), ('purchase.3.*', 4)), p as (select distinct pattern from roles union select family from f)
select pattern, (select arg_min(family, ord) from f where not regexp_matches(pattern, '\\.[*>]$') and starts_with(pattern, regexp_replace(family, '[*>]$', ''))) as family from p""")
def event_family_fold(spark, d):
    fams = spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(o).alias("ord")) for f, o in (("click.*", 3), ("click.1*", 1), ("view.>", 2), ("purchase.3.*", 4))])))
    return indexes.fold_families(_roles(spark, d).select("pattern").distinct().unionByName(fams.select(F.col("family").alias("pattern"))), fams).select("pattern", "family")


@query(f"""with {ROLES}, r as (select case when ord % 50 = 0 then (['view.*', 'view.3.*', 'click.2.>'])[ord // 50 % 3 + 1] else pattern end as pattern, role, component, ord from roles),
f as (select pattern as family, min(ord) as o from r where regexp_matches(pattern, '\\.[*>]$') group by 1),
p as (select pattern, coalesce(arg_min(family, o), pattern) as folded from (select distinct pattern from r) left join f on not regexp_matches(pattern, '\\.[*>]$') and starts_with(pattern, regexp_replace(family, '[*>]$', '')) group by 1)
select folded as pattern, coalesce(string_agg(distinct component, ',' order by component) filter (role = 'producer'), '') as producers, coalesce(string_agg(distinct component, ',' order by component) filter (role = 'consumer'), '') as consumers from r join p using (pattern) group by 1""")
def event_families_merged(spark, d):
    """Interfaces of families take in the roles of the patterns that fold into them."""
    o = F.col("ord")
    family = F.element_at(F.array(*[F.lit(x) for x in ("view.*", "view.3.*", "click.2.>")]), (F.floor(o / 50) % 3 + 1).cast("int"))
    r = _roles(spark, d).withColumn("pattern", F.when(o % 50 == 0, family).otherwise(F.col("pattern")))
    i = indexes.event_interfaces(indexes.fold_roles(r))
    return i.select("pattern", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"))


@query(f"with {ROLES} select pattern, coalesce(string_agg(distinct component, ',' order by component) filter (role = 'producer'), '') as producers, coalesce(string_agg(distinct component, ',' order by component) filter (role = 'consumer'), '') as consumers, case when count(*) filter (role = 'producer') > 0 then 'resolved' else 'unresolved' end as resolution from roles group by 1")
def event_resolution(spark, d):
    i = indexes.resolve_events(indexes.event_interfaces(_roles(spark, d)))
    return i.select("pattern", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"), "resolution")


@query("""with c as (select 'c-' || (p_partkey % 200) as id, p_partkey as ord, 'component:tpch/part-' || p_partkey as ref, (['unit', 'static', 'integration'])[p_size % 3 + 1] as tier, 'run TOKEN=' || p_size as command from part)
select id, string_agg(distinct ref, ',' order by ref) as refs, arg_min(tier, ord) as tier, 'run TOKEN=[REDACTED]' as command from c group by 1""")
def verification_merge(spark, d):
    t = F.element_at(F.array(F.lit("unit"), F.lit("static"), F.lit("integration")), F.col("p_size") % 3 + 1)
    c = B.table(spark, d, "part").select(F.concat(F.lit("c-"), (F.col("p_partkey") % 200).cast("string")).alias("id"), F.col("p_partkey").alias("ord"), B.ref("component/part", "p_partkey").alias("component_ref"), t.alias("tier"), F.concat(F.lit("run TOKEN="), F.col("p_size").cast("string")).alias("command"))
    return indexes.merge_checks(c).select("id", F.array_join("component_refs", ",").alias("refs"), "tier", "command")


@query("""with c as (select case when p_partkey % 4 = 0 then 'tg:' when p_partkey % 4 = 1 then 'ci:' else '' end || 'c-' || p_partkey as id, (['unit', 'static', 'integration'])[p_size % 3 + 1] as tier, [p_partkey % 60, p_partkey % 45] as refs from part),
x as (select id, tier, unnest(refs) as ref from c), t as (select distinct ref, tier from x where starts_with(id, 'tg:')) select id, tier from c where id not in (select id from x join t using (ref, tier) where not starts_with(id, 'tg:') and not starts_with(id, 'ci:'))""")
def verification_shadow(spark, d):
    k = F.col("p_partkey")
    pre = F.when(k % 4 == 0, "tg:").when(k % 4 == 1, "ci:").otherwise("")
    t = F.element_at(F.array(F.lit("unit"), F.lit("static"), F.lit("integration")), F.col("p_size") % 3 + 1)
    c = B.table(spark, d, "part").select(F.concat(pre, F.lit("c-"), k.cast("string")).alias("id"), t.alias("tier"), F.array(k % 60, k % 45).alias("component_refs"))
    return indexes.shadow_checks(c).select("id", "tier")


@query("with x as (select 'component:u/' || (user_id % 20) as component, event_type as name, event_id as ord, props, event_id % 9 as prov from events) select component, name, arg_min(props, ord) as role, string_agg(distinct prov::varchar, ',' order by prov::varchar) as prov from x group by 1, 2")
def externals_first_wins(spark, d):
    e = B.table(spark, d, "events").select(F.concat(F.lit("component:u/"), (F.col("user_id") % 20).cast("string")).alias("component"), F.col("event_type").alias("name"), F.col("event_id").alias("ord"), F.col("props").alias("role"), (F.col("event_id") % 9).cast("string").alias("prov"))
    return indexes.first_wins(e, ["component", "name"]).select("component", "name", "role", F.array_join("prov", ",").alias("prov"))


@query("select item_id, doc_id from documents d join benchmark b on contains(d.text, b.text) where 'src' || (item_id % 20) <> d.source")
def contract_consumers(spark, d):
    files = B.table(spark, d, "documents").select(F.col("source").alias("unit"), F.col("doc_id").cast("string").alias("path"), "text")
    b = B.table(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("provider"))
    hit = contracts.consumers(files, b.select("ref", "provider"))
    return hit.join(b.select("item_id", "ref"), "ref").select("item_id", F.col("path").cast("long").alias("doc_id"))


@query("""with c as (select 'api/' || p_partkey || (['.proto', '/openapi.yaml', '/a/very/long/path/of/a/contract/file.graphql'])[p_partkey % 3 + 1] as ref, p_partkey % 20 as provider from part where p_partkey % 4 = 0 union all select 'x.' || p_partkey, 0 from part where p_partkey % 50 = 0),
f as (select p_partkey % 20 as unit, 'u/' || p_partkey || '.go' as path, 'load("api/' || (p_partkey // 2) || (['.proto', '/openapi.yaml', '/a/very/long/path/of/a/contract/file.graphql'])[p_partkey // 2 % 3 + 1] || '", "x.' || (p_partkey // 3) || '")' as text from part)
select ref, unit, path from f join c on contains(text, ref) and unit <> provider""")
def contract_consumers_by_length(spark, d):
    """Contracts of all lengths in source text."""
    k = F.col("p_partkey")
    end = lambda n: F.element_at(F.array(*[F.lit(x) for x in (".proto", "/openapi.yaml", "/a/very/long/path/of/a/contract/file.graphql")]), (n % 3 + 1).cast("int"))
    half, third = F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long")
    p = B.spread(B.table(spark, d, "part"), "p_partkey")
    files = p.select((k % 20).alias("unit"), F.concat(F.lit("u/"), k.cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit('load("api/'), half.cast("string"), end(half), F.lit('", "x.'), third.cast("string"), F.lit('")')).alias("text"))
    c = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("api/"), k.cast("string"), end(k)).alias("ref"), (k % 20).alias("provider"))
    c = c.unionByName(p.where("p_partkey % 50 = 0").select(F.concat(F.lit("x."), k.cast("string")).alias("ref"), F.lit(0).cast("long").alias("provider")))
    return contracts.consumers(contracts.reference_sites(files), c).select("ref", "unit", "path")


@query(f"""with {SEGS}, c as (select path as cref, min('api:c/' || lpad(page_id::varchar, 6, '0')) as api from paths where page_id % 6 = 0 group by 1), f as (select page_id, path || (['', '/v1/x.go', '.pb.go', '/y'])[page_id % 4 + 1] as path from paths)
select page_id, arg_max(cref, length(cref)) as contract_ref from f left join c on path = cref or starts_with(path, cref || '/') or (regexp_replace(path, '/[^/]*$', '') = regexp_replace(cref, '/[^/]*$', '') and starts_with(regexp_extract(path, '[^/]*$'), regexp_extract(cref, '[^/]*$') || '.')) group by 1""")
def contract_lookup(spark, d):
    p = B.url_paths(spark, d)
    ends = F.element_at(F.array(*[F.lit(x) for x in ("", "/v1/x.go", ".pb.go", "/y")]), (F.col("page_id") % 4 + 1).cast("int"))
    c = p.where("page_id % 6 = 0").groupBy(F.col("path").alias("ref")).agg(F.min(F.concat(F.lit("api:c/"), F.lpad(F.col("page_id").cast("string"), 6, "0"))).alias("api_ref"))
    return contracts.lookup(p.select("page_id", F.concat("path", ends).alias("path")), c).select("page_id", "contract_ref")


@query("with x as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) as specifier from pages) select page_id % 25 as unit, specifier, count(distinct page_id) as n_files from x group by 1, 2")
def import_index(spark, d):
    files = B.table(spark, d, "pages").select((F.col("page_id") % 25).alias("unit"), F.col("page_id").alias("path"), F.col("html").alias("text"))
    return imports.index(imports.specifiers(files, 'href="([^"]*)"'))


@query("""with x as (select distinct page_id % 25 as unit, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) as specifier from pages), n as (select specifier as name, min(unit) as target from x group by 1 having count(distinct unit) >= 2),
o as (select name, target from n) select distinct unit as source, target from x join o on specifier = name where unit <> target""")
def import_edges(spark, d):
    files = B.table(spark, d, "pages").select((F.col("page_id") % 25).alias("unit"), F.col("page_id").alias("path"), F.col("html").alias("text"))
    s = imports.specifiers(files, 'href="([^"]*)"')
    names = s.groupBy(F.col("specifier").alias("name")).agg(F.count_distinct("unit").alias("k"), F.min("unit").alias("unit")).where("k >= 2")
    return imports.edges(s, names)


@query(f"with {CHECKS}, p as (select id as path, tier as extractor, ref as s from checks) select (row_number() over (order by path, extractor, s)) as ord, path, extractor from p")
def provenance_order(spark, d):
    r = B.checks(spark, d).select(F.col("id").alias("path"), F.col("tier").alias("extractor"), F.col("component_refs").alias("subjects"))
    return provenance.ordered(r).select("ord", "path", "extractor")


@query("with s as (select 'entity' as prefix, s_name as key, '/entities/' || (row_number() over (order by s_name) - 1) as pointer from supplier), q as (select 'entity' as prefix, 'Supplier#' || lpad((s_suppkey * 2)::varchar, 9, '0') as key from supplier) select key, pointer from q left join s using (prefix, key)")
def provenance_pointers(spark, d):
    s = B.table(spark, d, "supplier")
    idx = provenance.numbered(s.select("s_name"), ["s_name"], 0).select(F.lit("entity").alias("prefix"), F.col("s_name").alias("key"), F.lit("entities").alias("section"), F.col("ord").alias("index"))
    q = s.select(F.lit("entity").alias("prefix"), F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") * 2).cast("string"), 9, "0")).alias("key"))
    return provenance.pointers(q, idx).select("key", "pointer")


@query("select doc_id, case when doc_id % 9 = 4 then 'MISSING' when doc_id % 3 = 0 then 'STALE' else 'CURRENT' end as status from documents")
def evidence_pin_status(spark, d):
    docs = B.table(spark, d, "documents")
    pins = docs.select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    now = docs.where("doc_id % 9 <> 4").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return provenance.pin_status(pins, now).select(F.col("path").alias("doc_id"), "status")


@query("select p_name as name, case when count(distinct p_partkey % 40) = 1 then min(p_partkey % 40) else -1 end as unit, count(distinct p_partkey % 40) > 1 as ambiguous from part group by 1")
def unique_name_lookup(spark, d):
    return _unique_names(B.table(spark, d, "part"))


def _unique_names(parts):
    n = parts.select(F.col("p_name").alias("name"), (F.col("p_partkey") % 40).alias("unit"), F.col("p_partkey").alias("ord"))
    return own.unique_names(n).select("name", F.coalesce("unit", F.lit(-1)).alias("unit"), "ambiguous")


@query("with m as (select p_brand as root, (['both', 'deployable', 'importable', 'other'])[p_size % 4 + 1] as shape, p_partkey % 97 = 0 as explicit from part) select root, bool_or(shape in ('both', 'deployable')) as deployable, bool_or(shape in ('both', 'importable')) as importable, bool_or(shape in ('both', 'deployable', 'importable')) as present, bool_or(explicit) as explicit, bool_or(shape in ('both', 'deployable', 'importable')) or bool_or(explicit) as eligible from m group by 1")
def unit_shapes(spark, d):
    return _unit_shapes(B.table(spark, d, "part"))


def _unit_shapes(parts):
    s = F.element_at(F.array(*[F.lit(x) for x in ("both", "deployable", "importable", "other")]), F.col("p_size") % 4 + 1)
    return own.shape_flags(parts.select(F.col("p_brand").alias("root"), s.alias("shape"), (F.col("p_partkey") % 97 == 0).alias("explicit")))


@query("with c as (select s_nationkey as root, count(*) as n from supplier where s_suppkey % 3 = 0 group by 1), u as (select n_nationkey as root, 1 as n from nation where n_nationkey % 2 = 0) select coalesce(c.root, u.root) as root, case when u.n is null then 'orphan' when c.n is null then 'undescribed' when c.n > 1 then 'shared' else 'matched' end as verdict from c full join u on c.root = u.root")
def component_match(spark, d):
    c = B.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("root"))
    return own.matched_components(c, B.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("root"))).select("root", "verdict")
