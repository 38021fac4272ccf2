"""Queries of facts, elections, supersession and freshness over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elect
from ..sources import bindings as B
from .registry import FACTS, RULED, query

CASES = f"""{FACTS}, {RULED},
g as (select subject, key, any_value(rule_id) as rule_id, any_value(elect) as elect, count(*) as n_rows, count(distinct value_json) as n_values, count(*) filter (not candidate) as n_firm,
  count(*) filter (not candidate and cls = 'REVIEWED_OVERRIDE') as n_over, max(ord) filter (not candidate and cls = 'REVIEWED_OVERRIDE') as over_ord,
  coalesce(list(distinct cls) filter (not candidate), []) as classes, list(distinct cls) as all_classes, bool_or(candidate) as some_candidate,
  count(*) filter (not candidate and cls = 'OBSERVED_RUNTIME') as n_run, arg_max(ord, (ts, ord)) filter (not candidate and cls = 'OBSERVED_RUNTIME') as newest,
  max(len(list)) filter (not candidate) as longest from ruled group by 1, 2),
a as (select *, list_filter(elect, lambda x: list_contains(classes, x)) as allowed from g),
b as (select a.*, (select count(*) from ruled r where r.subject = a.subject and r.key = a.key and not r.candidate and r.cls = a.allowed[1]) as n_rule,
  (select max(ord) from ruled r where r.subject = a.subject and r.key = a.key and not r.candidate and r.cls = a.allowed[1]) as rule_ord,
  (select count(*) from ruled r where r.subject = a.subject and r.key = a.key and not r.candidate and len(r.list) = a.longest) as n_long,
  (select max(ord) from ruled r where r.subject = a.subject and r.key = a.key and not r.candidate and len(r.list) = a.longest) as long_ord from a),
c as (select *, case when n_values = 1 and n_firm = 0 then 'candidate-only' when n_values = 1 then 'agreement' when elect = ['REVIEWED_OVERRIDE'] and n_over = 1 then 'override'
  when len(allowed) = 1 and n_rule = 1 then 'rule' when n_firm > 1 and longest is not null and n_long = 1 then 'superset' when list_contains(elect, 'OBSERVED_RUNTIME') and n_run >= 2 then 'recency' else 'open' end as "case" from b),
e as (select subject, key, "case", case "case" when 'override' then over_ord when 'rule' then rule_ord when 'superset' then long_ord when 'recency' then newest end as elected_ord,
  case "case" when 'override' then 'reviewed-override' when 'rule' then 'authority-rule' when 'superset' then 'superset' when 'recency' then 'recency' when 'open' then 'none' when 'candidate-only' then 'none' end as basis,
  case when "case" = 'override' then 'accepted' when "case" in ('rule', 'superset', 'recency') then 'resolved' when "case" in ('open', 'candidate-only') then 'unresolved' end as conflict_status,
  case when "case" = 'agreement' then null when "case" = 'candidate-only' then 'ambiguity' when "case" = 'override' then 'reviewed-divergence'
    when list_contains(all_classes, 'OBSERVED_RUNTIME') and list_contains(all_classes, 'AUTHORED') then 'contradiction' when all_classes = ['OBSERVED_RUNTIME'] then 'staleness' when some_candidate then 'ambiguity'
    when len(all_classes) > 1 then 'contradiction' else 'ambiguity' end as conflict_kind, rule_id, n_rows, n_values from c)"""


def _elections(spark, d):
    return elect.elect(B.facts(spark, d), B.rules(spark))


@query(f"with {FACTS}, {RULED} select subject, key, any_value(rule_id) as rule_id from ruled group by 1, 2")
def rule_selection(spark, d):
    return elect.select_rules(B.facts(spark, d).select("subject", "key").distinct(), B.rules(spark)).select("subject", "key", "rule_id")


@query(f"with {FACTS} select subject, key, count(*) as n, count(distinct value_json) as n_values, string_agg(distinct cls, ',' order by cls) as classes from facts group by 1, 2")
def fact_groups(spark, d):
    f = B.facts(spark, d)
    return f.groupBy("subject", "key").agg(F.count("*").alias("n"), F.count_distinct("value_json").alias("n_values"), F.array_join(F.array_sort(F.collect_set("evidence_class")), ",").alias("classes"))


@query(f"with {CASES} select subject, key, \"case\", coalesce(elected_ord, -1) as elected_ord, basis, conflict_status, conflict_kind, rule_id, n_rows::int as n_rows, n_values from e")
def elections_all(spark, d):
    return _elections(spark, d).withColumn("elected_ord", F.coalesce("elected_ord", F.lit(-1)))


def _one(case):
    sql = f"with {CASES} select subject, key, coalesce(elected_ord, -1) as elected_ord, rule_id from e where \"case\" = '{case}'"

    def run(spark, d):
        return _elections(spark, d).where(F.col("case") == case).select("subject", "key", F.coalesce("elected_ord", F.lit(-1)).alias("elected_ord"), "rule_id")

    run.__name__ = f"elect_{case.replace('-', '_')}"
    return query(sql)(run)


elect_agreement, elect_candidate_only, elect_override, elect_rule, elect_superset, elect_recency, elect_open = (_one(c) for c in ("agreement", "candidate-only", "override", "rule", "superset", "recency", "open"))


@query(f"with {CASES} select conflict_kind, conflict_status, basis, count(*) as n from e where conflict_status is not null group by 1, 2, 3")
def conflict_kinds(spark, d):
    return _elections(spark, d).where("conflict_status is not null").groupBy("conflict_kind", "conflict_status", "basis").agg(F.count("*").alias("n"))


@query(f"with {CASES} select ord, case when \"case\" = 'agreement' then 'elected' when ord = elected_ord then 'elected' when candidate then 'candidate' else 'contradicted' end as status from ruled join e using (subject, key)")
def assertion_status(spark, d):
    f = B.facts(spark, d)
    return elect.statuses(f, elect.elect(f, B.rules(spark))).select("ord", "status")


@query(f"with {CASES} select subject, key, case when conflict_status = 'unresolved' and conflict_kind <> 'ambiguity' then 'error' else 'warning' end as severity from e where conflict_status is not null")
def conflict_diagnostics(spark, d):
    return elect.severity(_elections(spark, d))


SETS = """sets as (select user_id || '@' || ts::date as id, user_id::varchar as u, ts::date as d, max(ts) as captured_at, 'production' as environment from events group by 1, 2, 3),
linked as (select *, lag(id) over (partition by u order by d) as supersedes, (day(d) % 3 * 10 + 2)::bigint as max_age_days from sets)"""


@query(f"with {FACTS}, {SETS}, old as (select s.captured_at, s.environment from linked l join sets s on l.supersedes = s.id) select f.ord, o.captured_at is not null as superseded from facts f join sets s on s.id = f.obs_id left join (select distinct * from old) o on o.captured_at = s.captured_at")
def supersession_mark(spark, d):
    sets = B.observation_sets(spark, d)
    f = B.facts(spark, d).select("ord", "obs_id").join(sets.select(F.col("id").alias("obs_id"), "environment", F.col("captured_at").alias("observed_at")), "obs_id")
    return elect.supersede(f, sets).select("ord", "superseded")


@query(f"with {SETS}, l as (select * from linked where id not in (select supersedes from linked where supersedes is not null)) select id, floor((epoch(timestamp '2024-02-10') - floor(epoch(captured_at))) / 86400)::bigint as age_days, floor((epoch(timestamp '2024-02-10') - floor(epoch(captured_at))) / 86400) > max_age_days as stale from l")
def observation_freshness(spark, d):
    return elect.freshness(B.observation_sets(spark, d), F.to_timestamp(F.lit("2024-02-10 00:00:00")))


@query(f"""with {CASES}, {SETS}, l as (select id from linked where id not in (select supersedes from linked where supersedes is not null) and floor((epoch(timestamp '2024-02-10') - floor(epoch(captured_at))) / 86400) > max_age_days)
select e.subject, e.key, e.rule_id, case when e.rule_id = 'clicks' then 'conflict' else 'unresolved' end as becomes from e join facts f on f.ord = e.elected_ord where conflict_status = 'resolved' and e.rule_id in ('clicks', 'signups') and f.obs_id in (select id from l)""")
def stale_degradation(spark, d):
    f = B.facts(spark, d)
    stale = elect.freshness(B.observation_sets(spark, d), F.to_timestamp(F.lit("2024-02-10 00:00:00"))).where("stale")
    return elect.degrade(elect.elect(f, B.rules(spark)), f, B.rules(spark), stale)


@query("""with w as (select event_type as code, user_id::varchar as subject, list_sort(list(event_id)) as refs, sha256(event_type || min(event_id)) as sha from events group by event_type, user_id, day(ts) % 3),
a as (select code, subject, any_value(refs) as refs, any_value(sha) as sha, count(*) as n from w group by 1, 2)
select w.code, w.subject, w.refs[1] as first_ref, a.n = 1 and w.subject::bigint % 3 <> 0 as accepted from w join a using (code, subject)""")
def warning_acceptance(spark, d):
    e = B.table(spark, d, "events")
    g = e.groupBy(F.col("event_type").alias("code"), F.col("user_id").cast("string").alias("subject"), (F.dayofmonth("ts") % 3).alias("day"))
    w = g.agg(F.array_sort(F.collect_list("event_id")).alias("refs"), F.sha2(F.concat("code", F.min("event_id").cast("string")), 256).alias("sha256"))
    a = w.select("code", "subject", "refs", F.when(F.col("subject").cast("long") % 3 == 0, F.lit("changed")).otherwise(F.col("sha256")).alias("sha256"))
    return elect.accept(w, a).select("code", "subject", F.element_at("refs", 1).alias("first_ref"), "accepted")


@query(f"with {CASES} select e.subject, e.key, (select string_agg(p::varchar, ',' order by p) from (select f.ord % 10 as p from facts f where f.subject = e.subject and f.key = e.key)) as prov from e where conflict_status is not null")
def conflict_evidence(spark, d):
    from ..operators.provenance import conflict_evidence as evidence

    c = _elections(spark, d).where("conflict_status is not null").select("subject", "key")
    return evidence(c, B.facts(spark, d)).select("subject", "key", F.array_join(F.transform("prov_ids", lambda x: x.cast("string")), ",").alias("prov"))
