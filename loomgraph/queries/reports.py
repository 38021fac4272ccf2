"""Queries of audits, documents, packets, sessions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, documents, elect, evaluate, packets
from ..sources import bindings as B
from .elections import CASES
from .registry import CHECKS, query

NOTES = f"""{CASES}, st as (select ord, subject, key, cls, case when "case" = 'agreement' then 'elected' when ord = elected_ord then 'elected' when candidate then 'candidate' else 'contradicted' end as status from ruled join e using (subject, key)),
notes as (select subject || ' ' || key as fact, ord, case when cls = 'OBSERVED_RUNTIME' then 'OBSERVED' when status in ('unresolved', 'candidate') then 'UNRESOLVED' else 'DERIVED' end as n from st
  union all select subject || ' ' || key, 1099511627776, case when conflict_status in ('resolved', 'accepted') then 'DERIVED' else 'CONFLICT' end from e where conflict_status is not null),
cl as (select fact, coalesce(arg_max(n, ord) filter (n in ('CONFLICT', 'UNRESOLVED')), arg_min(n, ord)) as class from notes group by 1)"""


def _classified(spark, d):
    f = B.facts(spark, d)
    e = elect.elect(f, B.rules(spark))
    return audit.classify(audit.fact_notes(elect.statuses(f, e)).unionByName(audit.conflict_notes(e)))


@query(f"with {NOTES} select fact, class from cl")
def audit_classes(spark, d):
    return _classified(spark, d).select("fact", "class")


@query(f"with {NOTES} select class, count(*) as n from cl group by 1")
def audit_counts(spark, d):
    return audit.counts(_classified(spark, d))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def orphan_docs(spark, d):
    return audit.orphans(B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "labels"), "doc_id")


@query(f"with {CHECKS} select ref from checks where ref not in (select ref from checks where tier <> 'static')")
def unverified_components(spark, d):
    c = B.table(spark, d, "part").select(B.ref("component/part", "p_partkey").alias("ref"))
    return audit.unverified(c, B.checks(spark, d).where("tier <> 'static'"))


@query("""with x as (select doc_id, (1000 + doc_id % 7)::varchar as port from documents where doc_id % 4 = 0), l as (select doc_id, 'component:tpch/supplier-' || (doc_id % 30) as ref from documents where doc_id % 3 = 0), p as (select 'component:tpch/supplier-' || s_suppkey as ref, (1000 + s_suppkey % 5)::varchar as fact from supplier)
select doc_id, ref, port, fact, case when ref is null then 'unlinked' else 'mismatch' end as verdict from x left join l using (doc_id) left join p using (ref) where ref is null or fact <> port""")
def doc_contradictions(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\nListens on port "), (1000 + F.col("doc_id") % 7).cast("string"))).otherwise(F.col("text")).alias("text"))
    links = docs.where("doc_id % 3 = 0").select("doc_id", B.ref("component/supplier", F.col("doc_id") % 30).alias("ref"))
    ports = B.table(spark, d, "supplier").select(B.ref("component/supplier", "s_suppkey").alias("ref"), (1000 + F.col("s_suppkey") % 5).cast("string").alias("port"))
    return audit.port_contradictions(audit.port_claims(docs, "doc_id"), links, ports, "doc_id")


@query("with dep as (select distinct 'c-' || (user_id % 30) as component, event_type || (event_id % 4) as name from events), ext as (select distinct 'c-' || (user_id % 30) as component from events where user_id % 30 < 20), own as (select distinct event_type || '1' as name from events) select component, name from dep where component not in (select component from ext) and name not in (select name from own) order by 1, 2 limit 40")
def unclassified_dependencies(spark, d):
    e = B.table(spark, d, "events")
    c = F.concat(F.lit("c-"), (F.col("user_id") % 30).cast("string")).alias("component")
    dep = e.select(c, F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("name"))
    return audit.unclassified(dep, e.where("user_id % 30 < 20").select(c), e.select(F.concat("event_type", F.lit("1")).alias("name")))


@query("with f as (select 'contract' as kind, s_suppkey::varchar as item from supplier union all select 'document', doc_id::varchar from documents) select * from f")
def reviewed_ambiguities(spark, d):
    return audit.reviewed({"contract": B.table(spark, d, "supplier").select("s_suppkey"), "document": B.table(spark, d, "documents").select("doc_id")})


@query("""with p as (select p_partkey, case p_partkey % 10 when 0 then '/home/u' || p_partkey || '/x' when 1 then 'docs/home/u' when 2 then 'a node_modules/../x' when 3 then '\\\\host\\x' when 4 then 'run process.pid' when 5 then 'at 2024-01-0' || (p_partkey % 9 + 1) || 'T00:00:00.25Z' when 6 then 'at 2024-01-0' || (p_partkey % 9 + 1) || 'T00:00:00Z' else 'src' end as pointer from part)
select distinct 'pointer' as "column", pointer as value, (['absolute host path', '', 'escaped path', 'absolute Windows path', 'process identity'])[p_partkey % 10 + 1] as kind from p where p_partkey % 10 in (0, 2, 3, 4)
union select 'pointer', pointer[4:], 'timestamp' from p where p_partkey % 10 in (5, 6) and pointer <> 'at 2024-01-03T00:00:00Z'""")
def determinism_scan(spark, d):
    k = F.col("p_partkey")
    n, at = k.cast("string"), F.concat(F.lit("at 2024-01-0"), (k % 9 + 1).cast("string"))
    forms = [F.concat(F.lit("/home/u"), n, F.lit("/x")), F.lit("docs/home/u"), F.lit("a node_modules/../x"), F.lit("\\\\host\\x"), F.lit("run process.pid"), F.concat(at, F.lit("T00:00:00.25Z")), F.concat(at, F.lit("T00:00:00Z"))]
    pointer = F.coalesce(F.get(F.array(*forms), (k % 10).cast("int")), F.lit("src"))
    rows = B.table(spark, d, "part").select(pointer.alias("pointer"), F.lit("/home/free/text").alias("command"))
    allowed = spark.range(0, 1, 1, 1).select(F.lit("2024-01-03T00:00:00Z").alias("captured_at"))
    return audit.machine_values(rows, ["pointer", "command"], allowed)


@query("""with d as (select doc_id, case doc_id % 3 when 0 then 'There is no supplier-' || (doc_id % 40) || ' here.' when 1 then 'we have  no Supplier-' || (doc_id % 40) || '-service' else 'no supplier-1' end as text from documents)
select doc_id, 'upplier-' || (doc_id % 40) || case when doc_id % 3 = 1 then '-service' else '' end as tail, 'component:tpch/supplier-' || s_suppkey as ref from d join supplier on s_suppkey = doc_id % 40 where doc_id % 3 < 2""")
def negated_components(spark, d):
    n = (F.col("doc_id") % 40).cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("There is no supplier-"), n, F.lit(" here."))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("we have  no Supplier-"), n, F.lit("-service"))).otherwise("no supplier-1")
    names = B.table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("name"), B.ref("component/supplier", "s_suppkey").alias("ref"))
    found = audit.negated_components(B.table(spark, d, "documents").select("doc_id", text.alias("text")), names, "doc_id")
    return found.select("doc_id", F.substring("claim", 2, 100).alias("tail"), "ref")


@query("""with s as (select doc_id, 'Rule ' || source as heading, '## Rule ' || source || chr(10) || replace(text, '#', '') as body from documents)
select doc_id, lower(replace(heading, ' ', '-')) as section, heading, sha256(regexp_replace(body, '\\s+\\z', '')) as sha256 from s
union all select doc_id, lower(replace(heading, ' ', '-')) || '-1', heading, sha256('## ' || heading || chr(10) || '```' || chr(10) || '## not a heading' || chr(10) || '```') from s where doc_id % 2 = 0""")
def normative_sections(spark, d):
    return _sections(spark, d).select("doc_id", "section", "heading", "sha256")


def _sections(spark, d):
    head = F.concat(F.lit("## Rule "), "source", F.lit("\n"))
    body = F.concat(F.lit("# Title\n"), head, F.replace("text", F.lit("#"), F.lit("")), F.lit("\n\n"))
    again = F.when(F.col("doc_id") % 2 == 0, F.concat(head, F.lit("```\n## not a heading\n```\n"))).otherwise("")
    return documents.sections(B.table(spark, d, "documents").select("doc_id", F.concat(body, again).alias("text")), "doc_id")


@query("select doc_id, case when doc_id % 2 = 0 and s = 2 then 'uncovered' when l.doc_id is null then 'uncovered' when quality = 0 then 'stale' else 'cited' end as verdict, s from (select doc_id, unnest(case when doc_id % 2 = 0 then [1, 2] else [1] end) as s from documents) x left join labels l using (doc_id)")
def normative_coverage(spark, d):
    s = _sections(spark, d).select(F.col("doc_id").alias("path"), "section", "sha256")
    first = s.where("section not like '%-1' or section rlike '^rule-src[0-9]+$'").where("section rlike '^rule-src[0-9]+$'")
    cited = first.join(B.table(spark, d, "labels").select(F.col("doc_id").alias("path"), "quality"), "path").select("path", "section", F.when(F.col("quality") == 0, "old").otherwise(F.col("sha256")).alias("sha256"))
    v = elect.coverage(s, cited)
    return v.select(F.col("path").alias("doc_id"), "verdict", F.when(F.col("section").rlike("^rule-src[0-9]+$"), 1).otherwise(2).alias("s"))


PAGED = "r as (select conv_id, turn, length(text)::bigint as cost, row_number() over (partition by conv_id order by role = 'system' desc, turn) as position from conversations)"


@query(f"with {PAGED}, s as (select *, sum(cost) over (partition by conv_id order by position) as used from r) select conv_id, turn, position::int as position, used::bigint as used from s where used <= 900")
def budget_page(spark, d):
    return _page(spark, d, 0)


@query(f"with {PAGED}, s as (select *, sum(cost) over (partition by conv_id order by position) as used from r where position > 2) select conv_id, turn, position::int as position, used::bigint as used from s where used <= 900")
def page_continue(spark, d):
    return _page(spark, d, 2)


def _page(spark, d, offset):
    r = B.table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("cost"), (F.col("role") == "system").alias("critical"))
    return packets.page(r, "conv_id", [F.col("critical").desc(), "turn"], "cost", 900, offset).select("conv_id", "turn", "position", F.col("used").cast("long").alias("used"))


@query("""with o as (select doc_id as id, sha256(text) as v from documents where doc_id % 5 <> 0), n as (select doc_id as id, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as v, doc_id % 7 = 0 as critical from documents where doc_id % 6 <> 0)
select coalesce(o.id, n.id) as id, case when n.id is null then 'retraction' when o.id is null then 'new' when o.v <> n.v then 'changed' else 'critical' end as change from o full join n on o.id = n.id where n.id is null or o.id is null or o.v <> n.v or critical""")
def delta_refresh(spark, d):
    docs = B.table(spark, d, "documents")
    i = F.col("doc_id")
    old = docs.where("doc_id % 5 <> 0").select(i.alias("id"), F.sha2("text", 256).alias("version"))
    new = docs.where("doc_id % 6 <> 0").select(i.alias("id"), F.sha2(F.when(i % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("version"), (i % 7 == 0).alias("critical"))
    return packets.delta(old, new)


@query("with r as (select conv_id % 50 as c, role, conv_id, turn, conv_id % 3 as batch from conversations) select 'check-' || c as check_id, role as command, arg_max(conv_id * 100 + turn, (case when batch = 2 then 1 else 0 end, conv_id * 100 + turn)) as ord from r group by 1, 2")
def session_latest(spark, d):
    r = B.table(spark, d, "conversations").select(F.concat(F.lit("check-"), (F.col("conv_id") % 50).cast("string")).alias("check_id"), F.col("role").alias("command"), F.lit(".").alias("cwd"), F.lit("ci").alias("runner"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), (F.col("conv_id") % 3).alias("batch"))
    return packets.merge_results(r.where("batch <> 2"), r.where("batch = 2")).select("check_id", "command", "ord")


@query(f"with {CHECKS} select id as check_id from checks where split_part(split_part(id, ':', 1), '-', 2)::int % 4 = 0 and split_part(split_part(id, ':', 1), '-', 2)::int % 3 <> 1")
def session_valid(spark, d):
    c = B.checks(spark, d).select("id", "command")
    k = F.regexp_extract("id", "part-([0-9]+)", 1).cast("int")
    r = c.select(F.col("id").alias("check_id"), "command", F.when(k % 4 == 0, "h1").otherwise("h0").alias("graph_hash"), F.lit("passed").alias("status"), F.when(k % 3 == 1, 1).otherwise(0).alias("exit_code"))
    return packets.valid_results(r, c, "h1").select("check_id")


FACT = "sc as (select source as scenario from documents group by 1), t as (select source as scenario, doc_id as fact from documents join labels using (doc_id) where quality = 1 and source <> 'src3'), r as (select source as scenario, doc_id as fact from documents where n_chars > 1500 and source <> 'src5')"
METRIC = f"""{FACT}, n as (select scenario, (select count(*) from t where t.scenario = sc.scenario) as n_truth, (select count(*) from r where r.scenario = sc.scenario) as n_retrieved, (select count(*) from t join r using (scenario, fact) where t.scenario = sc.scenario) as n_hit from sc),
m as (select *, round(case when n_truth = 0 then 1.0 else n_hit::double / n_truth end, 4) as recall, round(case when n_retrieved = 0 then 1.0 else n_hit::double / n_retrieved end, 4) as precision, round(1 - case when n_retrieved = 0 then 1.0 else n_hit::double / n_retrieved end, 4) as noise from n)"""


def _metrics(spark, d):
    docs = B.table(spark, d, "documents")
    good = docs.join(B.table(spark, d, "labels").where("quality = 1"), "doc_id").where("source <> 'src3'").select(F.col("source").alias("scenario"), F.col("doc_id").alias("fact"))
    got = docs.where("n_chars > 1500 and source <> 'src5'").select(F.col("source").alias("scenario"), F.col("doc_id").alias("fact"))
    return evaluate.retrieval(good, got, docs.select(F.col("source").alias("scenario")).distinct())


@query(f"with {METRIC} select scenario, n_truth, n_retrieved, n_hit, recall, precision, noise from m")
def retrieval_metrics(spark, d):
    return _metrics(spark, d)


_CORPUS = "case when right(scenario, 1) in ('0', '2', '4', '6', '8') then 'even' else 'odd' end"


def _summary(spark, d):
    m = _metrics(spark, d).withColumn("corpus", F.when(F.substring("scenario", -1, 1).isin("0", "2", "4", "6", "8"), "even").otherwise("odd"))
    return evaluate.summary(m, "corpus")


SUMMARY = f"{METRIC}, su as (select {_CORPUS} as corpus, count(*) as n, round(avg(recall), 4) as recall, round(avg(noise), 4) as noise, round(sum(n_hit)::double / sum(n_truth), 4) as micro_recall from m group by rollup (1))"


@query(f"with {SUMMARY} select coalesce(corpus, 'all') as corpus, n, recall, noise, micro_recall from su")
def micro_recall(spark, d):
    return _summary(spark, d).withColumn("corpus", F.coalesce("corpus", F.lit("all")))


@query(f"with {SUMMARY}, g as (select coalesce(corpus, 'all') as corpus, unnest(['recall', 'noise', 'micro_recall']) as metric, unnest([recall, noise, micro_recall]) as value, unnest([0.5, 0.6, 0.4]) as bound from su) select corpus, metric, value, bound::double as bound, case metric when 'noise' then value <= bound else value >= bound end as passed from g")
def threshold_gate(spark, d):
    return evaluate.gate(_summary(spark, d).withColumn("corpus", F.coalesce("corpus", F.lit("all"))), [("recall", ">=", 0.5), ("noise", "<=", 0.6), ("micro_recall", ">=", 0.4)])


@query(f"with {METRIC}, x as (select {_CORPUS} as corpus, case when n_truth > 5 then recall end as recall, n_truth from m) select corpus, round(sum(recall * n_truth) / sum(case when recall is not null then n_truth end), 4) as recall from x group by 1")
def weighted_aggregate(spark, d):
    m = _metrics(spark, d).withColumn("corpus", F.when(F.substring("scenario", -1, 1).isin("0", "2", "4", "6", "8"), "even").otherwise("odd")).withColumn("recall", F.when(F.col("n_truth") > 5, F.col("recall")))
    return evaluate.weighted(m, "recall", "n_truth", ["corpus"])


@query("with l as (select event_type, list_sort(list(value)) as v from events group by 1) select event_type, len(v) as n, v[len(v) // 2 + 1] as median, v[ceil(len(v) * 0.95)::bigint] as p95 from l")
def campaign_summary(spark, d):
    return evaluate.campaign(B.table(spark, d, "events"), "event_type", "value")


@query("""with a as (select event_type as family, user_id as task, day(ts) as repeat, case when event_id % 2 = 0 then 'base' else 'new' end as arm, value > 25 as s, value as c, row_number() over (partition by event_type, user_id, day(ts), event_id % 2 order by event_id) as k from events),
p as (select b.family, b.s::int as s0, b.c as c0, n.s::int as s1, n.c * 0.7 as c1 from a b join a n on b.family = n.family and b.task = n.task and b.repeat = n.repeat and b.arm = 'base' and n.arm = 'new' and b.k = 1 and n.k = 1),
g as (select family, count(*) as n, avg(s1 - s0) as gain, sqrt(2 * ln(2 / 0.05) / count(*)) as half, 1 - sum(c1) / sum(c0) as saving from p group by 1)
select family, n, round(gain, 4) as gain, round(half, 4) as half_width, round(saving, 4) as saving, gain + half >= 0 and saving >= 0.2 as adopt from g""")
def paired_selection(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_type").alias("family"), F.col("user_id").alias("task"), F.dayofmonth("ts").alias("repeat"), (F.col("event_id") % 2).alias("odd"), "event_id", "value")
    a = e.groupBy("family", "task", "repeat", "odd").agg(F.min_by("value", "event_id").alias("value"))
    a = a.select("family", "task", "repeat", F.when(F.col("odd") == 0, "base").otherwise("new").alias("arm"), (F.col("value") > 25).cast("int").alias("success"), F.when(F.col("odd") == 0, F.col("value")).otherwise(F.col("value") * 0.7).alias("cost"))
    return evaluate.paired(a, "base", "new")
