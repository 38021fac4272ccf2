"""Queries of crates over workspaces that are written from the part table.

Part k is a crate `w/g/k` of the workspace `w/g`, ten to a workspace. By k % 6 its manifest names a crate of the workspace by a
path, by the workspace's table, by a patch of its own, by a path that the workspace's patch may contradict, for tests only, or
by a replacement. Every fiftieth crate has one name with all others of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crates
from ..sources.bindings import spread, table
from .registry import query

MEMBERS = [
    '[dependencies]\nd = { path = "../<low>", package = "any" }\n',
    "[dependencies]\nshared.workspace = true\n\n[dev-dependencies]\nshared.workspace = true\n",
    '[target.\'cfg(unix)\'.dependencies]\neng = "1"\n\n[patch.crates-io]\neng = { path = "../<low>" }\n',
    '[build-dependencies]\nboth = { path = "../<low>" }\n',
    '[dev-dependencies]\nt = { path = "../<low>" }\ngone = { path = "../../../../out" }\nplain = "1"\n',
    '[dependencies]\nold = "0.1"\n\n[replace]\n"old:0.1.0" = { path = "../<low>" }\n',
]
SPACE = '[workspace]\nmembers = ["*"]\n\n[workspace.dependencies]\nshared = { path = "<one>" }\n\n[patch.crates-io]\nboth = { path = "<two>" }\n'
SOURCE = "use d::x;\nuse shared::y;\nextern crate eng;\nuse both::z;\nuse t::q;\nuse old::r;\nuse same::s;\nuse serde::S;\n// use plain::no;\n"
_SQL = """c as (select p_partkey as k, p_partkey // 10 * 10 as g, p_partkey // 10 * 10 + p_partkey % 10 // 2 as low, p_partkey % 6 as m, 'w/' || (p_partkey // 10) || '/' as w,
    case when p_partkey % 50 = 49 then 'same' else 'c-' || p_partkey end as name from part),
  torn as (select k, w from c where m = 3 and low <> g + 2 and low in (select k from c) and g + 2 in (select k from c)),
  hit as (select c.w, c.k, c.m, o.k as t, o.name as package from c join c o on o.k = case when c.m = 1 then c.g + 1 else c.low end and o.k <> c.k where c.k not in (select k from torn)),
  edges as (select case when m = 4 then 'testDependsOn' else 'buildDependsOn' end as type, w || k as source, w || t as target, package from hit)"""


def workspaces(spark, d: str):
    """(unit, path, text) of manifests and sources of all workspaces."""
    k, g = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10).cast("long")
    numbers = {"k": k, "low": g * 10 + F.floor(k % 10 / 2).cast("long"), "one": g * 10 + 1, "two": g * 10 + 2, "g": g}

    def filled(pattern):
        out = pattern if not isinstance(pattern, str) else F.lit(pattern)
        for key, n in numbers.items():
            out = F.replace(out, F.lit(f"<{key}>"), n.cast("string"))
        return out

    name = F.when(k % 50 == 49, "same").otherwise("c-<k>")
    member = F.concat(F.lit('[package]\nname = "'), name, F.lit('"\n\n'), F.element_at(F.array(*[F.lit(m) for m in MEMBERS]), (k % 6 + 1).cast("int")))
    of = lambda unit, path, text: F.struct(filled(unit).alias("unit"), filled(path).alias("path"), filled(text).alias("text"))
    files = F.array_compact(F.array(
        of("w/<g>/<k>", "w/<g>/<k>/Cargo.toml", member), of("w/<g>/<k>", "w/<g>/<k>/src/lib.rs", SOURCE), F.when(k % 10 == 0, of("w/<g>", "w/<g>/Cargo.toml", SPACE)),
    ))
    return spread(table(spark, d, "part"), "p_partkey").select(F.explode(files).alias("f")).select("f.*")


@query(f"with {_SQL} select *, 'cargo-manifest' as via from edges")
def rust_edges(spark, d):
    return crates.edges(crates.resolve(crates.manifests(workspaces(spark, d))))


@query(f"with {_SQL} select w || k as unit, 'both' as name from torn union all select w || k, name from c where name = 'same' and (select count(*) from c where name = 'same') > 1")
def rust_ambiguous(spark, d):
    said = crates.manifests(workspaces(spark, d))
    return crates.resolve(said).where("ambiguous").select("unit", F.col("key").alias("name")).unionByName(crates.shared_names(said))


@query(f"with {_SQL} select *, 'source-import' as via from edges")
def rust_import_edges(spark, d):
    files = workspaces(spark, d)
    said = crates.manifests(files)
    return crates.imports(files, crates.resolve(said), said)[0]


@query(f"with {_SQL} select w || k as unit, 'both' as name from torn union all select w || k, 'same' from c where (select count(*) from c o where o.name = 'same' and o.k <> c.k) > 1")
def rust_import_ambiguous(spark, d):
    files = workspaces(spark, d)
    said = crates.manifests(files)
    return crates.imports(files, crates.resolve(said), said)[1]


@query(f"with {_SQL} select w || k || ':cargo-' || n as id, w || k as unit, t as tier, 'cargo ' || n || ' -p ' || name as command from c, (values ('test', 'unit'), ('clippy', 'static')) v(n, t)")
def rust_checks(spark, d):
    return crates.checks(crates.manifests(workspaces(spark, d)))
