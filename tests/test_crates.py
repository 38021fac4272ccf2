"""Which crate a dependency ends at, manifest by manifest."""

from loomgraph.operators import crates

FILES = {
    "Cargo.toml": '[workspace]\n[workspace.dependencies]\nfar = { path = "a" }\nnear = { path = "a" }\n',
    "in/Cargo.toml": '[workspace]\n[workspace.dependencies]\nnear = { path = "b" }\ntwo = { path = "b" }\nreal = { path = "c" }\n',
    "a/Cargo.toml": '[package]\nname = "a-a"\n[dependencies]\nfar.workspace = true\nnear = { path = "../in/b" }\nnone = { path = "../../x" }\n[patch.crates-io]\nnone = { path = "in/b" }\n',
    "in/b/Cargo.toml": '[package]\nname = "b"\n[dependencies]\nnear.workspace = true\nfar.workspace = true\nleft = "1"\n'
    '[dependencies.two]\nworkspace = true\npackage = "real"\n[patch.crates-io]\nleft = { path = "../../../up" }\n',
    "in/c/Cargo.toml": '[package]\nname = "c"\n[dev-dependencies]\nb-b = { path = "../b" }\nd = "1"\n[dependencies]\nb-b = { path = "../b" }\n[replace]\n"d:1.0.0" = { path = "../d" }\n"http://x/y" = { path = "../b" }\n',
    "in/d/Cargo.toml": '[package]\nname = "b"\n[target.x.dependencies]\nq = { path = "../b" }\n[target.y.dependencies]\nq = { path = "../c" }\n[dependencies]\nodd = { path = "../none" }\n',
    "bad/Cargo.toml": "[package\n",
    "in/c/src/l.rs": "use b_b::x; use d::y; use c::own; use a_a::z; use b::w;",
    "in/d/src/l.rs": "use q::x; use b::y;",
}


def test_ends_of_dependencies(spark):
    rows = [(p.split("/src")[0].removesuffix("/Cargo.toml"), p, t) for p, t in FILES.items()] + [(None, None, None), ("n", "n/Cargo.toml", None), ("e", "e/Cargo.toml", "")]
    files = spark.createDataFrame(rows, "unit string, path string, text string")
    said = crates.manifests(files)
    resolved = crates.resolve(said)
    got = {(r.unit, r.kind, r.key, r.target, r.ambiguous) for r in resolved.collect()}
    assert got == {
        ("a", "build", "far", "a", False), ("a", "build", "near", "in/b", False), ("in/b", "build", "near", "in/b", False), ("in/b", "build", "two", None, True),
        ("in/c", "test", "b-b", "in/b", False), ("in/c", "build", "b-b", "in/b", False), ("in/c", "test", "d", "in/d", False),
        ("in/d", "build", "q", "in/b", False), ("in/d", "build", "q", "in/c", False),
    }
    edges = {tuple(r) for r in crates.edges(resolved).collect()}
    assert edges == {
        ("buildDependsOn", "a", "in/b", "cargo-manifest", "b"), ("buildDependsOn", "in/c", "in/b", "cargo-manifest", "b"), ("testDependsOn", "in/c", "in/d", "cargo-manifest", "b"),
        ("buildDependsOn", "in/d", "in/b", "cargo-manifest", "b"), ("buildDependsOn", "in/d", "in/c", "cargo-manifest", "c"),
    }
    made, torn = crates.imports(files, resolved, said)
    assert {tuple(r) for r in made.collect()} == {("buildDependsOn", "in/c", "in/b", "source-import", "b"), ("testDependsOn", "in/c", "in/d", "source-import", "b")}
    assert {tuple(r) for r in torn.collect()} == {("in/d", "q"), ("in/c", "b")}
    assert {tuple(r) for r in crates.shared_names(said).collect()} == {("in/b", "b"), ("in/d", "b")}


def test_empty(spark):
    files = spark.createDataFrame([], "unit string, path string, text string")
    said = crates.manifests(files)
    assert crates.edges(crates.resolve(said)).isEmpty() and crates.imports(files, crates.resolve(said), said)[1].isEmpty()
