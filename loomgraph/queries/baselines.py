"""Queries that compare retrieval systems over a working tree and a graph that are written from the part table.

Parts are in groups of eight; each needs the one before it in its group, by a manifest, an import or a route.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines
from ..plans.context import whole
from ..sources.bindings import table
from .registry import query
from .wiring import written

FILES = [
    ("k % 8 in (1, 4)", "package.json", '{"name": "@x/p-<k>", "dependencies": {"lodash": "1", "@x/p-<prev>": "1"}, "scripts": {"test": "t <k>", "build": "b"}}'),
    ("k % 8 not in (1, 4)", "package.json", '{"name": "@x/p-<k>", "dependencies": {"lodash": "1"}, "scripts": {"test": "t <k>", "build": "b"}}'),
    ("k % 8 in (2, 5)", "src/a.ts", "import x from '../../<prev>/src/b'\n"), ("k % 8 in (3, 6)", "src/a.ts", "import '@x/p-<prev>/lib'\nget('/api/g<group>')\n"), ("k % 8 = 7", "src/a.ts", "fetch('https://h.example/api/g<group>?x=1')\n"),
    ("k % 8 in (0, 1, 4)", "src/a.ts", "export {}\n"), ("k % 3 = 0", "src/e.ts", "bus.publish('order.k<k>.made') // 'not.on.this'.x\nconst n = 'other.k<k>.line'\n"), ("k % 5 = 0", "src/r.py", "import redis\n"),
    ("true", "README.md", "# p-<k>"), ("k % 16 = 8", "constraints.md", "-"),
]
PREFIX = "component:default/p-"
_BOUND = """n as (select count(*) as n, count(*) filter (p_partkey % 3 = 0) as n3 from part), s as (select p_partkey as k, p_partkey // 8 as g from part where p_partkey % 50 = 0),
  m as (select p_partkey as j, p_partkey // 8 as g from part),
  found as (select s.k, count(*) as m, count(*) filter (j % 3 = 0) * 2 as ev, count(*) filter (j % 5 = 0) as red, count(*) filter (j % 16 = 8) as con from s join m on m.g = s.g group by s.k),"""


def _trees(spark, d) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], DataFrame, DataFrame]:
    """Files, components, graph, touched units and truth."""
    files = written(spark, d, FILES, prev="k - 1", group="k div 8").select("path", "text")
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"))
    of = lambda n: F.concat(F.lit(PREFIX), n.cast("string"))
    k, ref, root = F.col("k"), of(F.col("k")), F.concat(F.lit("p/"), F.col("k").cast("string"))
    readme = F.concat(root, F.lit("/README.md"))
    components = p.select(ref.alias("ref"), F.concat(F.lit("p-"), k.cast("string")).alias("name"), root.alias("root"), F.array().cast("array<string>").alias("docs"))
    command = F.concat(F.lit("t "), k.cast("string"))
    graph = whole(spark, {
        "entities": p.select(ref.alias("ref"), F.lit("Component").alias("kind"), root.alias("source_path"), F.array(readme).alias("docs")),
        "relations": p.where("k % 8 <> 0").select(F.lit("buildDependsOn").alias("type"), ref.alias("source_ref"), of(k - 1).alias("target_ref")),
        "events": p.where("k % 3 = 0").select(F.concat(F.lit("order.k"), k.cast("string"), F.lit(".made")).alias("pattern"), F.array(ref).alias("producers")),
        "verification": p.select(command.alias("id"), command.alias("command"), F.array(ref).alias("component_refs")),
    })
    seeds = p.where("k % 50 = 0").select(k.alias("scenario"), ref.alias("ref"), F.concat(F.lit("./"), root, F.lit("/src/a.ts")).alias("touch"))
    facts = F.array_compact(F.array(ref, F.when(k > 0, of(k - 1)), F.concat(F.lit("verify:"), command), F.concat(F.lit("doc:"), readme), F.concat(F.lit("constraint:"), root, F.lit("/none.md"))))
    return files, components, graph, seeds, p.where("k % 50 = 0").select(k.alias("scenario"), F.explode(facts).alias("fact"))


@query("""select p_partkey as scenario, 'component:default/p-' || j as ref from part, (select p_partkey as j from part) where p_partkey % 50 = 0 and j // 8 = p_partkey // 8""")
def search_reached(spark, d):
    files, components, _, seeds, _ = _trees(spark, d)
    return baselines.search(files, components, seeds.select("scenario", "touch"))[2]


@query("""with s as (select p_partkey as k, p_partkey // 8 as g from part where p_partkey % 50 = 0), m as (select s.k as scenario, p_partkey as j, 'component:default/p-' || p_partkey as ref from part join s on p_partkey // 8 = s.g)
  select scenario, ref as fact from m union select scenario, 'doc:p/' || j || '/README.md' from m union select scenario, 'constraint:p/' || j || '/constraints.md' from m where j % 16 = 8 union select scenario, 'external:lodash' from m
  union select scenario, 'verify:t ' || j from m union select scenario, 'event:order.k' || j || '.made' from m where j % 3 = 0 union select scenario, 'event:not.on.this' from m where j % 3 = 0
  union select scenario, 'resource:default/p-' || j || '-redis' from m where j % 5 = 0 union select scenario, 'uses:resource:default/p-' || j || '-redis' from m where j % 5 = 0""")
def search_facts(spark, d):
    files, components, _, seeds, _ = _trees(spark, d)
    return baselines.search(files, components, seeds.select("scenario", "touch"))[0]


@query(f"""with {_BOUND}
  r as (select 'search' as system, k, 3 * m + 1 + ev // 2 + (ev > 0)::int + 2 * red + con as n, 3 + (k % 8 <> 0)::int as hit from found
    union all select 'targeted', k, (select n from n) + 2 + (k % 8 <> 0)::int + ((k + 1) % 8 <> 0 and k + 1 in (select j from m))::int + (k % 3 = 0)::int, 3 + (k % 8 <> 0)::int from s
    union all select 'inventory', k, (select 3 * n + n3 from n), 3 + (k > 0)::int from s),
  t as (select *, 4 + (k > 0)::int as truth from r)
  select system, k as scenario, truth as n_truth, n as n_retrieved, hit as n_hit, round(hit / truth, 4) as recall, round(hit / n, 4) as "precision", round(1 - hit / n, 4) as noise from t""")
def retrieval_systems(spark, d):
    files, components, graph, seeds, truth = _trees(spark, d)
    facts, common, _ = baselines.search(files, components, seeds.select("scenario", "touch"))
    near, documents = baselines.targeted(graph, seeds.select("scenario", "ref"))
    systems = [("search", facts, common), ("targeted", near, documents), ("inventory", None, baselines.inventory(graph))]
    return reduce(DataFrame.unionByName, [baselines.scored(truth, own, every, seeds).select(F.lit(name).alias("system"), "*") for name, own, every in systems])
