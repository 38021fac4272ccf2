"""What keeps joins, parsers, closures of configurations and run-time imports bounded on larger tables."""

import itertools
import re

import duckdb
import pytest
import yaml
from pyspark.sql import functions as F

from loomgraph.operators import closure, impact, imports, modules, relations
from loomgraph.plans import settle
from loomgraph.queries import closures, crates, graphs, registry, sections, wiring
from loomgraph.sources import authored, bindings, parsers

SF = "/root/testdata/sf0.001"


def test_a_small_file_with_long_rows_is_not_broadcast(spark):
    # 200 rows of a file of some kilobytes, written to 25 MB: by the size of the file either side would be sent to the driver
    p = bindings.table(spark, SF, "part").select("p_partkey", F.repeat(F.col("p_partkey").cast("string"), 40_000).alias("text"))
    both = p.join(p.select("p_partkey", F.reverse("text").alias("other")), "p_partkey")
    both.select(F.sum(F.length("text") + F.length("other"))).collect()
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_measured_side_of_some_megabytes_is_merged(spark):
    # 200 rows written to 2.5 MB: less than Spark would broadcast by itself
    p = bindings.table(spark, SF, "part").select("p_partkey", F.repeat(F.col("p_partkey").cast("string"), 4_000).alias("text"))
    both = p.join(p.select("p_partkey", F.reverse("text").alias("other")), "p_partkey")
    both.collect()
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize(("size", "n"), [("10485760b", 10485760), ("10MB", 10 << 20), ("256k", 256 << 10), ("-1", -1), ("5", 5)])
def test_sizes_of_settings(size, n):
    assert settle._bytes(size) == n


def test_written_texts_are_spread_over_tasks(spark):
    files = wiring.written(spark, SF, [("true", "a.yml", "a: <k>\n")])
    assert files.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("query", ["dependent_routes", "dependent_scope", "impact_checks_topk"])
def test_levels_of_a_search_are_not_broadcast(spark, monkeypatch, query):
    levels = []
    keep = closure.settle
    monkeypatch.setattr(closure, "settle", lambda df: levels.append(df) or keep(df))
    getattr(closures, query)(spark, SF).collect()
    plans = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for df in levels]
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not any("Broadcast" in p for p in plans)


def test_large_levels_of_a_search_are_put_in_order_without_a_broadcast(spark, monkeypatch):
    settled = []
    keep = closure.settle
    want = sorted(closures.dependent_routes(spark, SF).collect())
    monkeypatch.setattr(closure, "settle", lambda df: settled.append(df) or keep(df))
    monkeypatch.setattr(closure, "ONE_TASK", 3)
    assert sorted(closures.dependent_routes(spark, SF).collect()) == want
    plans = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for df in settled]
    assert sum("rangepartitioning" in p for p in plans) > 3
    assert not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("query", ["checks_for_change", "impact_checks_topk"])
def test_checks_meet_their_scope_and_seeds_without_a_broadcast(spark, query):
    found = getattr(closures, query)(spark, SF)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan
    assert "BroadcastHashJoin" not in plan


def test_plain_yaml_is_read_once_by_the_reader_in_c(monkeypatch):
    read = []
    monkeypatch.setattr(yaml.SafeLoader, "__init__", lambda self, stream: read.append(stream))
    assert parsers.parse_yaml("a: 1\n---\nb: [x, 'y']\n") == [(0, 1, {"a": 1}), (1, 3, {"b": ["x", "y"]})]
    assert not read


@pytest.mark.parametrize("text", ["key: ># c", "a:\tb", "{a?, b: c}", "---\n ", "a: [!t x}", "a: &x 1", "a: \ufeff1", "a: |\n  x\nb: 'q'\n", "a: {", "- *x"])
def test_both_yaml_readers_say_the_same(monkeypatch, text):
    def said():
        try:
            return parsers.parse_yaml(text)
        except parsers.Refused as x:
            return str(x), x.line

    found = said()
    monkeypatch.setattr(parsers, "_FAST", yaml.SafeLoader)
    assert found == said()


def test_tags_of_plain_yaml_are_not_resolved(monkeypatch):
    text = "name: nullable\nn: null\nno: [~, tRue, TRUE, -1, .5, .nan, '1', x, 0x1f, '']\ne:\n"
    slow = [(i, n.start_mark.line + 1, parsers._value(n)) for i, n in enumerate(yaml.compose_all(text, Loader=yaml.SafeLoader))]
    resolved = []
    monkeypatch.setattr(yaml.resolver.Resolver, "resolve", lambda self, *what: resolved.append(what))
    assert str(parsers.parse_yaml(text)) == str(slow)
    assert str(slow[0][2]["no"]) == "[None, 'tRue', True, -1, 0.5, nan, '1', 'x', 31, '']"
    assert not resolved


@pytest.mark.parametrize(("text", "line"), [("a: 1\n  \tb: 2", 2), ("\ta: 1", 1), ("a: 1\nb: c\td\n \t", 3)])
def test_tabs_in_indentation_are_refused_with_their_line(text, line):
    with pytest.raises(parsers.Refused, match="tab in indentation") as x:
        parsers.parse_yaml(text)
    assert x.value.line == line


def test_authored_texts_are_read_once(spark):
    text = "kind: ObservationSet\nmetadata: {name: s, capturedAt: x}\nspec: {facts: [{id: a, subject: r, key: k, value: 1}]}\n"
    facts, problems = authored.observations(spark.createDataFrame([("o.yaml", text)], "path string, text string"), spark.createDataFrame([("r",)], "ref string"), spark.createDataFrame([("b",)], "path string"))
    assert "ArrowEvalPython" not in facts._jdf.queryExecution().optimizedPlan().toString() + problems._jdf.queryExecution().optimizedPlan().toString()
    assert [r.problem for r in problems.collect()] == ["absent-bundle"]


def test_manifests_of_crates_are_spread_over_tasks(spark):
    assert crates.workspaces(spark, SF).select(F.spark_partition_id()).distinct().count() > 1


def test_contracts_to_check_are_spread_over_tasks(spark, monkeypatch):
    texts = []
    keep = sections.contracts.syntax_problems
    monkeypatch.setattr(sections.contracts, "syntax_problems", lambda files: texts.append(files) or keep(files))
    sections.contract_syntax(spark, SF)
    assert texts[0].select(F.spark_partition_id()).distinct().count() > 1


def test_inputs_by_path_and_by_file(spark):
    files = spark.createDataFrame([(1, "a/x"), (2, "a/x")], "id int, path string")
    none = files.where("false").select("path")
    kinds = lambda inputs: {r.id: r.kind for r in impact.classify(files, none, none, None, inputs).collect()}
    assert kinds(files.where("id = 2").select("path")) == {1: "input", 2: "input"}
    assert kinds(F.col("id") == 2) == {1: None, 2: "input"}


def test_inherited_settings_on_cycles_and_shared_roots(spark, monkeypatch):
    # the first parent is a hub of all; 1 and 2 lead to each other
    up = {0: [], 1: [0, 2], 2: [1, 3], 3: [0], 4: [2, 3], 5: [4], 6: [5, 1]}
    base, paths = {0: "x", 3: "y", 5: "z"}, {0: "r", 2: "s"}

    def trails(at, trail, place):
        yield place, at
        for i, to in enumerate(up[at]):
            if to not in trail:
                yield from trails(to, [*trail, to], [*place, -i])

    def first(k, has):
        return min(((p, at) for p, at in trails(k, [k], []) if at in has), default=(None, None))[1]

    rows = [(f"c{k}/tsconfig.json", [f"../c{x}/tsconfig" for x in up[k]], base.get(k), {"~": [paths[k]]} if k in paths else None) for k in up]
    configs = spark.createDataFrame(rows, "path string, extends array<string>, base_url string, paths map<string, array<string>>")
    settled = []
    keep = imports.settle
    monkeypatch.setattr(imports, "settle", lambda df: settled.append(keep(df)) or settled[-1])
    found = {r.path: (r.base_url, r.paths, r.paths_base) for r in imports.inherited(configs).collect()}
    for k in up:
        b, p = first(k, base), first(k, paths)
        assert found[f"c{k}/tsconfig.json"] == (None if b is None else f"c{b}/{base[b]}", None if p is None else {"~": [paths[p]]}, None if p is None else f"c{p}")
    levels = [df for df in settled if "trail" in df.columns]
    # a trail that has told both settings leads nowhere further
    assert not any(df.where("base and mapped and not (tells_base or tells_paths)").count() for df in levels)


def test_loads_of_a_place_are_dealt_in_shares(spark, monkeypatch):
    monkeypatch.setattr(modules, "SHARE", 3)
    files = spark.createDataFrame([(f"p/{k}/loc/en.ts",) for k in range(20)] + [("p/1/b.ts",)], "path string")
    found = spark.createDataFrame([(f"p/{k}/b.ts", "../*/loc/en", "template") for k in range(5)], "path string, specifier string, kind string")
    rows = modules.resolve_patterns(found, files)
    assert sorted((r.path, r.file) for r in rows.collect()) == sorted(itertools.product([f"p/{k}/b.ts" for k in range(5)], [f"p/{k}/loc/en.ts" for k in range(20)]))
    # each file is matched once for a place, not once for each file that loads it
    assert "rlike" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_calls_and_consumed_contracts_meet_once(spark):
    rows = [("runtimeCalls", "a", "x", {"contractRef": "p"}), ("runtimeCalls", "a", "x", {"contractRef": "p"}), ("runtimeCalls", "b", "x", {"contractRef": "p"}), ("runtimeCalls", "a", "x", None)]
    rows += [("consumesApi", "a", "p", None), ("consumesApi", "a", "p", {"contractRef": "p"}), (None, "a", "p", {"contractRef": "p"})]
    e = spark.createDataFrame(rows, "type string, source_ref string, target_ref string, attrs map<string,string>")
    kept, dropped = relations.drop_contract_duplicates(e)
    assert [x.type for x in dropped.collect()] == ["runtimeCalls"] * 2
    assert kept.count() == 5
    plan = graphs.contract_duplicate_calls(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    assert plan.count("FileScan") == 2


def test_buckets_of_parts_with_more_than_six_digits(spark, tmp_path):
    # 100,000 and 1,000,000 begin with the same six digits, as their users 300,000 and 3,000,000 do
    keys = [k + n for k in (100_000, 300_000, 1_000_000, 3_000_000) for n in range(12)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = db.execute(f"select kind, unit, resource, bucket, n from ({registry.ORACLES['bucket_literals']})").fetchall()
    rows = wiring.bucket_literals(spark, str(tmp_path)).select("kind", "unit", "resource", "bucket", "n").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert {r.resource for r in rows if r.unit.startswith("p/30000")} >= {"resource:x/100001", "resource:x/1000002"}


def test_files_of_a_crowded_directory_are_dealt_in_shares(spark, monkeypatch):
    monkeypatch.setattr(modules, "CROWD", 3, raising=False)
    settled = []
    keep = modules.settle
    monkeypatch.setattr(modules, "settle", lambda df: settled.append(df) or keep(df))
    files = [f"p/{k}/loc/{n}" for k in range(6) for n in ("en.ts", "de/index.ts", "readme.md")]
    wanted = [("p/1/b.ts", "../*/loc/en", "template", r"p/\d+/loc/en.ts"), ("p/1/b.ts", "../*/loc/*", "template", r"p/\d+/loc/.*"), ("p/2/a.ts", "./loc/*.ts", "glob", r"p/2/loc/en.ts")]
    rows = modules.resolve_patterns(spark.createDataFrame([w[:3] for w in wanted], "path string, specifier string, kind string"), spark.createDataFrame([(f,) for f in files], "path string")).collect()
    assert sorted((r.path, r.specifier, r.file) for r in rows) == sorted((p, s, f) for p, s, _, e in wanted for f in files if re.fullmatch(e, f))
    # files meet the directories and the patterns by their share too, and are compared once
    plan = next(df for df in settled if df.columns == ["base", "kind", "file"])._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert re.search(r"SortMergeJoin \[dir#\d+, share#\d+\]", plan)
    assert re.search(r"SortMergeJoin \[dir#\d+, tail#\d+, share#\d+\]", plan)
    assert "HashAggregate" not in plan.split("SortMergeJoin")[0]


def test_texts_are_read_once_for_their_patterns(spark):
    found = modules.patterns(wiring.written(spark, SF, wiring.DYNAMIC_FILES))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
