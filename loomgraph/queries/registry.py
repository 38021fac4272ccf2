"""Where queries register, and SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with DuckDB SQL of the same rows where there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PART = "'component:tpch/part-' || "
#: CTEs of the bound graph.
EDGES = f"""edges as (select 'buildDependsOn' as type, {PART}p_partkey as source_ref, {PART}(p_partkey // 2) as target_ref from part where p_partkey >= 1
  union all select 'testDependsOn', {PART}p_partkey, {PART}(p_partkey // 3) from part where p_partkey >= 1 and p_partkey % 5 = 0)"""
REVERSE = EDGES + ", rev as (select distinct target_ref as dependency, source_ref as dependent, type = 'testDependsOn' as unit_only from edges)"
CHECKS = f"checks as (select 'part-' || p_partkey || ':' || (['unit', 'static', 'integration'])[p_size % 3 + 1] as id, (['unit', 'static', 'integration'])[p_size % 3 + 1] as tier, {PART}p_partkey as ref from part)"
URLS = "urls as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as raw from pages)"
SEGS = URLS + ", paths as (select page_id, array_to_string(list_filter(string_split(raw, '/'), lambda s: s not in ('', '.')), '/') as path from urls)"
FACTS = """facts as (select event_id as ord, user_id::varchar as subject, event_type || '.d' || (day(ts) % 5) as key,
  case when event_type = 'view' then '[' || array_to_string(range(0, event_id % 4 + 1), ',') || ']' else floor(value / 50)::bigint::varchar end as value_json,
  case when event_type = 'view' then range(0, event_id % 4 + 1) end as list,
  (['AUTHORED', 'DERIVED', 'OBSERVED_RUNTIME', 'REVIEWED_OVERRIDE'])[event_id % 4 + 1] as cls, event_id % 7 = 0 as candidate, ts, event_type,
  user_id || '@' || ts::date as obs_id from events)"""
RULED = """ruled as (select *, case when event_type = 'click' and key = 'click.d0' then 'clicks-d0' when event_type = 'click' then 'clicks' when event_type = 'purchase' then 'purchases'
  when event_type = 'signup' then 'signups' end as rule_id,
  case when event_type = 'click' and key = 'click.d0' then ['OBSERVED_RUNTIME', 'DERIVED'] when event_type = 'click' then ['OBSERVED_RUNTIME'] when event_type = 'purchase' then ['REVIEWED_OVERRIDE']
  when event_type = 'signup' then ['AUTHORED', 'DERIVED'] else []::varchar[] end as elect from facts)"""
