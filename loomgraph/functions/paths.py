"""Paths and references as Column expressions (Catalyst only)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_path(p: Column) -> Column:
    """Drop empty and `.` segments; null for absolute, drive, backslash or `..` paths; `.` for nothing left."""
    segments = F.split(p, "/")
    kept = F.filter(segments, lambda s: ~s.isin("", "."))
    refused = p.startswith("/") | p.rlike(r"^[A-Za-z]:") | F.contains(p, F.lit("\\")) | F.array_contains(segments, "..")
    return F.when(p.isNull() | refused, None).when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def is_repo_path(p: Column) -> Column:
    """Whether an authored path is relative, plain and without white space."""
    bad_segment = F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce(~(bad_segment | p.rlike(r"^[A-Za-z]:[\\/]") | F.contains(p, F.lit("\\")) | p.rlike(r"\s")), F.lit(False))


def owns_path(owner: Column, file: Column) -> Column:
    """Whether file lies at or under owner, segment by segment; the root `.` owns all."""
    return (owner == ".") | (file == owner) | F.startswith(file, F.concat(owner, F.lit("/")))


def ancestors(p: Column) -> Column:
    """All owners a path can have: the root, each directory above it, itself."""
    segments = F.split(p, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/")))


def depth(p: Column) -> Column:
    return F.when(p == ".", 0).otherwise(F.size(F.split(p, "/")))


def join_path(directory: Column, name: Column) -> Column:
    return F.when((directory == ".") | (directory == ""), name).when((name == ".") | (name == ""), directory).otherwise(F.concat_ws("/", directory, name))


def normal_path(p: Column) -> Column:
    """p with `.` and `..` segments taken in; `.` for nothing left, null where it leads out of the root."""
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(F.split(p, "/"), none, lambda acc, s: F.when(F.size(acc) == 0, F.when(s.isin("", "."), acc).otherwise(F.array(s))).otherwise(step(acc, s)))
    return F.when(F.get(kept, 0) == "..", None).when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def parent_path(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def base_name(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def contract_covers(ref: Column, file: Column) -> Column:
    """A contract covers itself, what lies under it, and files beside it named after it."""
    beside = (parent_path(ref) == parent_path(file)) & F.startswith(base_name(file), F.concat(base_name(ref), F.lit(".")))
    return owns_path(ref, file) | beside


def looks_like_ref(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z][A-Za-z0-9_-]*:")


def build_ref(kind: Column, namespace: Column, name: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), namespace, F.lit("/"), name)


def kind_of(ref: Column) -> Column:
    return F.split_part(ref, F.lit(":"), F.lit(1))


def name_of(ref: Column) -> Column:
    return F.split_part(ref, F.lit("/"), F.lit(2))


def valid_ref(ref: Column) -> Column:
    return ref.rlike(r"^(domain|system|component|api|resource):[a-z0-9][a-z0-9-]*/[A-Za-z0-9][A-Za-z0-9._-]*$")


def glob_to_regex(glob: str) -> str:
    """A regular expression of a path glob: `*` and `?` stay in a segment, `**` spans segments."""
    out, parts = "", glob.split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+/)*" + ("[^/]+" if last else "")
        else:
            out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c) for c in part) + ("" if last else "/")
    return f"^{out}$"


#: Generated directories that are never looked into.
GENERATED_DIRS = """
.git node_modules vendor target dist coverage .next .nuxt .svelte-kit .turbo .wrangler .vercel .output .cache .venv
__pycache__ .pytest_cache .gradle .terraform .idea .vscode-test test-results playwright-report storybook-static
.dart_tool .tox .mypy_cache
""".split()


def in_generated_dir(p: Column, names: list[str] | None = None) -> Column:
    return F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(n) for n in names or GENERATED_DIRS]))
