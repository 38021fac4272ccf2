"""Queries of scalar functions, paths and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions import values as V
from ..operators import own
from ..sources.bindings import table, url_paths
from .registry import SEGS, URLS, query

CANONICAL = "case when starts_with(raw, '/') or list_contains(string_split(raw, '/'), '..') then null when len(list_filter(string_split(raw, '/'), lambda s: s not in ('', '.'))) = 0 then '.' else array_to_string(list_filter(string_split(raw, '/'), lambda s: s not in ('', '.')), '/') end"


@query(f"""with {URLS}, odd as (select page_id, case when page_id % 11 = 0 then '/' || raw when page_id % 7 = 0 then raw || '/../x' when page_id % 5 = 0 then './' || replace(raw, '/', '//') || '/.' when page_id % 13 = 0 then '././' else raw end as raw from urls)
select page_id, {CANONICAL} as path from odd""")
def canonical_path_urls(spark, d):
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    i = F.col("page_id")
    odd = F.when(i % 11 == 0, F.concat(F.lit("/"), raw)).when(i % 7 == 0, F.concat(raw, F.lit("/../x"))).when(i % 5 == 0, F.concat(F.lit("./"), F.replace(raw, F.lit("/"), F.lit("//")), F.lit("/."))).when(i % 13 == 0, "././").otherwise(raw)
    return table(spark, d, "pages").select("page_id", P.canonical_path(odd).alias("path"))


@query(f"""with {URLS} select page_id, raw <> '' and not starts_with(raw, '/') and not regexp_matches(raw, '^[A-Za-z]:') and not regexp_matches(raw, '\\s')
  and len(list_filter(string_split(raw, '/'), lambda s: s in ('', '.', '..'))) = 0 as ok from urls""")
def is_repo_path_urls(spark, d):
    raw = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", P.is_repo_path(raw).alias("ok"))


@query(f"""with {SEGS}, up as (select page_id, path, unnest(range(1, len(string_split(path, '/')))) as n from paths),
o as (select distinct array_to_string(string_split(path, '/')[1:n], '/') as owner from up)
select o.owner, count(*) as files from o join paths on paths.path = o.owner or starts_with(paths.path, o.owner || '/') group by 1""")
def owns_path_pairs(spark, d):
    """Files under each directory."""
    files = url_paths(spark, d)
    dirs = files.select(F.explode(P.ancestors(F.col("path"))).alias("owner"), "path").where("owner <> '.' and owner <> path").select("owner").distinct()
    up = files.select(F.explode(P.ancestors(F.col("path"))).alias("owner"))
    return up.join(dirs, "owner").groupBy("owner").agg(F.count("*").alias("files"))


@query(f"""with {SEGS}, o as (select distinct array_to_string(string_split(path, '/')[1:2], '/') as root from paths where page_id % 3 = 0 union select distinct string_split(path, '/')[1] from paths where page_id % 2 = 0 union select '.')
select page_id, max_by(root, case when root = '.' then 0 else len(string_split(root, '/')) end) as owner from paths join o on o.root = '.' or path = root or starts_with(path, root || '/') group by 1""")
def longest_owner_urls(spark, d):
    files = url_paths(spark, d)
    up = P.ancestors(F.col("path"))
    two = files.where("page_id % 3 = 0").select(F.coalesce(F.get(up, 2), F.element_at(up, -1)).alias("root"))
    one = files.where("page_id % 2 = 0").select(F.get(up, 1).alias("root"))
    roots = two.unionByName(one).distinct().unionByName(spark.range(0, 1, 1, 1).select(F.lit(".").alias("root")))
    return own.longest_owner(files, roots).select("page_id", "owner")


@query(f"""with {SEGS}, p as (select distinct string_split(path, '/')[1] as prefix from paths) select prefix, path from p join paths on path = prefix or starts_with(path, prefix || '/') or regexp_replace(path, '\\.[^./]*$', '') = prefix group by all""")
def prefix_scan_modules(spark, d):
    files = url_paths(spark, d)
    return own.prefix_scan(files, files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("prefix")).distinct())


@query(f"""with {SEGS}, s as (select path, string_split(path, '/') as g, unnest(range(1, len(string_split(path, '/')) + 1)) as i from paths)
select parent, array_to_string(list_sort(list(distinct child)), ' ') as children from (select case when i = 1 then '.' else array_to_string(g[1:i - 1], '/') end as parent, g[i] || case when i < len(g) then '/' else '' end as child from s) group by 1""")
def directory_listing(spark, d):
    return own.list_dir(url_paths(spark, d)).select("parent", F.array_join("children", " ").alias("children"))


@query(f"""with {SEGS} select path from paths where regexp_matches(path, '^(?:[^/]+/)*en/[^/]*$') or regexp_matches(path, '^m[^/]*/(?:[^/]+/)*[^/]+$') group by 1""")
def glob_expansion(spark, d):
    files = url_paths(spark, d).select("path").distinct()
    return own.expand_glob(files, "**/en/*").unionByName(own.expand_glob(files, "m*/**")).distinct()


@query(f"""with {SEGS} select page_id, path from paths where not list_has_any(string_split(path, '/'), ['en', 'de']) and not starts_with(path, 'm.') """)
def visible_files(spark, d):
    files = url_paths(spark, d)
    ignored = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("path")).where("path like 'm.%'").distinct()
    return own.visible(files, ignored, generated=["en", "de"]).select("page_id", "path")


@query("""with r as (select 'system:tpch/nation-' || n_nationkey as ref from nation union all select 'component:tpch/supplier-' || s_suppkey from supplier)
select ref, split_part(ref, ':', 1) as kind, split_part(ref, '/', 2) as name, regexp_matches(ref, '^[A-Za-z][A-Za-z0-9_-]*:') as is_ref from r""")
def ref_build_parse(spark, d):
    n = table(spark, d, "nation").select(P.build_ref(F.lit("System"), F.lit("tpch"), F.concat(F.lit("nation-"), "n_nationkey")).alias("ref"))
    s = table(spark, d, "supplier").select(P.build_ref(F.lit("Component"), F.lit("tpch"), F.concat(F.lit("supplier-"), "s_suppkey")).alias("ref"))
    r = F.col("ref")
    return n.unionByName(s).select("ref", P.kind_of(r).alias("kind"), P.name_of(r).alias("name"), P.looks_like_ref(r).alias("is_ref"))


@query("select doc_id, sha256(text) as sha256 from documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", V.sha256(F.col("text")).alias("sha256"))


@query("""with i as (select source, lpad(doc_id::varchar, 12, '0') as k, sha256(text) as h from documents),
p as (select source, substr(sha256(k), 1, 4) as part, sha256(string_agg(lpad(length(k)::varchar, 8, '0') || k || lpad(length(h)::varchar, 8, '0') || h, '' order by k)) as h from i group by 1, 2)
select source, sha256(string_agg(part || h, '' order by part)) as input_hash from p group by 1""")
def input_hash_by_source(spark, d):
    i = table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("k"), V.sha256(F.col("text")).alias("h"))
    return V.input_hash(i, "source", "k", "h")


@query("""with x as (select p_partkey, p_brand, p_type, case when p_partkey % 50 = 0 then '@!' when p_partkey % 2 = 0 then '@' || p_name || '/fooBar_x' else p_name || p_type || p_name || p_type end as n, p_name || (['-service', ' API', '.lib', ''])[p_partkey % 4 + 1] as m,
  case when p_partkey % 9 = 0 then '  ' when p_partkey % 3 = 0 then p_name || '?' else '  ' || p_name || '  x ' end as t from part)
select p_partkey, coalesce(nullif(substr(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '^@', ''), '[_\\s]+', '-', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 63), ''), 'component') as kebab,
  regexp_replace(regexp_replace(lower(m), '[^a-z0-9]+', '', 'g'), '(api|service|worker|app|module|package|lib|library)$', '') as plain,
  regexp_replace(lower(p_brand || '_' || p_type), '[-_.]+', '-', 'g') as dist, replace(p_type || '-x', '-', '_') as ident,
  regexp_replace(regexp_replace(lower(trim(p_brand || '_a  ' || m || '!')), '[^\\p{L}\\p{N}\\s-]', '', 'g'), '\\s', '-', 'g') as slug,
  case when trim(t) = '' then 'TODO: describe this in one present-tense sentence.' when right(trim(t), 1) = '?' then trim(t) else regexp_replace(trim(t), '\\s+', ' ', 'g') || '.' end as sentence from x""")
def name_normalisers(spark, d):
    c, k = F.col, F.col("p_partkey")
    n = F.when(k % 50 == 0, "@!").when(k % 2 == 0, F.concat(F.lit("@"), "p_name", F.lit("/fooBar_x"))).otherwise(F.concat("p_name", "p_type", "p_name", "p_type"))
    m = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in ("-service", " API", ".lib", "")]), (k % 4 + 1).cast("int")))
    t = F.when(k % 9 == 0, "  ").when(k % 3 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.concat(F.lit("  "), "p_name", F.lit("  x ")))
    return table(spark, d, "part").select(
        "p_partkey", T.kebab(n).alias("kebab"), T.normalise_name(m).alias("plain"), T.distribution_name(F.concat("p_brand", F.lit("_"), "p_type")).alias("dist"),
        T.rust_ident(F.concat("p_type", F.lit("-x"))).alias("ident"), T.slugify(F.concat(c("p_brand"), F.lit("_a  "), m, F.lit("!"))).alias("slug"), T.sentence(t).alias("sentence"),
    )


def _tiers(table_, refused):
    return f"case when {refused} then null " + " ".join(f"when regexp_matches(s, '{p}') then '{t}'" for p, t in table_) + " end"


@query(f"""with n as (select distinct p, q, p || x || q as s from (select unnest(['test', 'lint', 'build', 'e2e', 'check', 'dev', 'verify', 'contract', 'typecheck']) as p), (select unnest([':', '-', '_']) as x), (select distinct split_part(p_name, ' ', 2) as q from part union select unnest(['unit', 'integration', 'e2e', 'watch', 'drift', 'openapi'])))
select s, {_tiers(T.WORKFLOW_TIERS, "not regexp_matches(s, '" + T.WORKFLOW_GATE + "')")} as workflow, {_tiers(T.TASK_TIERS, "regexp_matches(s, '" + T.TASK_REFUSED + "')")} as task, {_tiers(T.SCRIPT_TIERS, "regexp_matches(s, '" + T.SCRIPT_REFUSED + "')")} as script from n""")
def tier_classify(spark, d):
    words = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("q")).distinct()
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    q = words.unionByName(spark.range(0, 1, 1, 1).select(F.explode(lit(["unit", "integration", "e2e", "watch", "drift", "openapi"])).alias("q"))).distinct()
    n = q.select("q", F.explode(lit(["test", "lint", "build", "e2e", "check", "dev", "verify", "contract", "typecheck"])).alias("p")).select("p", "q", F.explode(lit([":", "-", "_"])).alias("x"))
    s = F.col("s")
    return n.select(F.concat("p", "x", "q").alias("s")).select("s", T.workflow_tier(s).alias("workflow"), T.task_tier(s).alias("task"), T.script_tier(s).alias("script"))


@query("""with t as (select distinct event_type as w from events), typo as (select unnest(['vieww', 'purchsae', 'clik', 'singup', 'eror', 'xyz']) as typo),
s as (select typo, w, damerau_levenshtein(typo, w) as dist, row_number() over (partition by typo order by damerau_levenshtein(typo, w), w) as r from t, typo)
select typo, w as suggestion, dist::int as dist from s where r = 1 and dist <= greatest(1, length(typo) // 3)""")
def did_you_mean(spark, d):
    known = table(spark, d, "events").select(F.col("event_type").alias("w")).distinct()  # command names: a closed vocabulary
    typos = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(x) for x in ("vieww", "purchsae", "clik", "singup", "eror", "xyz")])).alias("typo"))
    scored = known.join(F.broadcast(typos), F.length("w") > 0).withColumn("dist", T.edit_distance(F.col("typo"), F.col("w")))
    best = scored.groupBy("typo").agg(F.min_by(F.struct("w", "dist"), F.struct("dist", "w")).alias("b"))
    return best.where(F.col("b.dist") <= F.greatest(F.lit(1), F.floor(F.length("typo") / 3))).select("typo", F.col("b.w").alias("suggestion"), F.col("b.dist").alias("dist"))


def _form_sql(t):
    return "case " + " ".join(f"when regexp_matches(replace({t}, '{T.MARK}', ''), '" + p.replace("'", "''") + f"') then '{n}'" for n, p in T.SECRET_FORMS) + " end"


@query(f"select doc_id, {_form_sql('text')} as form from documents where {_form_sql('text')} is not null")
def secret_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", T.secret_form(F.col("text")).alias("form")).where("form is not null")


@query("""with c as (select p_partkey, 'make test ' || case p_partkey % 4 when 0 then 'API_TOKEN=' || p_name when 1 then 'curl https://u:' || p_size || '@h.example/x' when 2 then 'my_password = "' || p_name || '" next' else p_name end as command from part)
select p_partkey, substr(trim(regexp_replace(regexp_replace(command, '""" + T.ASSIGNED.replace("'", "''") + """', '\\1[REDACTED]', 'g'), '""" + T.URL_LOGIN + """', '\\1[REDACTED]@', 'g')), 1, 600) as command from c""")
def command_redaction(spark, d):
    i = F.col("p_partkey") % 4
    tail = F.when(i == 0, F.concat(F.lit("API_TOKEN="), "p_name")).when(i == 1, F.concat(F.lit("curl https://u:"), F.col("p_size").cast("string"), F.lit("@h.example/x"))).when(i == 2, F.concat(F.lit('my_password = "'), "p_name", F.lit('" next'))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.redact_command(F.concat(F.lit("make test "), tail)).alias("command"))


@query(f"""with {SEGS}, f as (select page_id, (['src/app', 'src/app', 'server', 'server'])[page_id % 4 + 1] as base, (['(shop)/' || path || '/[id]/route.ts', path || '/[...rest]/page.tsx', 'api/' || path || '.ts', path || '.ts'])[page_id % 4 + 1] as rel from paths)
select page_id, case page_id % 4 when 0 then '//' || replace(rel, '(shop)/', '')[:-(length('/[id]/route.ts') + 1)] || '/:id' when 2 then '/' || regexp_replace(rel[5:], '\\.ts$', '') end as route from f
union all select page_id + 1000000000, '/' || path || '/:rest*' from paths""")
def route_of_files(spark, d):
    k = F.col("page_id") % 4
    lit = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k + 1).cast("int"))
    p = url_paths(spark, d)
    rel = lit(F.concat(F.lit("(shop)/"), "path", F.lit("/[id]/route.ts")), F.concat("path", F.lit("/[...rest]/page.tsx")), F.concat(F.lit("api/"), "path", F.lit(".ts")), F.concat("path", F.lit(".ts")))
    one = p.select("page_id", T.route_of_file(lit("src/app", "src/app", "server", "server"), rel).alias("route"))
    return one.unionByName(p.select((F.col("page_id") + 1000000000).alias("page_id"), T.route_of_file(F.lit("app"), F.concat("path", F.lit("/[...rest]/route.js"))).alias("route")))


@query("select event_type || '.' || (event_id % 3) as key, count(*) as n, regexp_matches(event_type || '.' || (event_id % 3), '^[a-z][A-Za-z0-9]*([.-][A-Za-z0-9]+)+$') as ok from events group by 1, 3")
def fact_key_shape(spark, d):
    e = table(spark, d, "events").select(F.concat("event_type", F.lit("."), (F.col("event_id") % 3).cast("string")).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n")).withColumn("ok", T.fact_key(F.col("key")))
