"""Table-valued parsers: text to rows, for use on Arrow batches or as Python table functions.

They are state machines or readers of nested documents that SQL can't express; each is a plain function from a text to
a list, and `rows` applies one to a column without gathering anything.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Callable
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A document that the strict subset does not admit."""

    def __init__(self, message: str, line: int = 0):
        super().__init__(message)
        self.line = line


# -- YAML: composed by the library, then walked; everything beyond plain data is refused

_CORE = [
    (re.compile(r"^(null|Null|NULL|~|)$"), lambda s: None),
    (re.compile(r"^(true|True|TRUE)$"), lambda s: True),
    (re.compile(r"^(false|False|FALSE)$"), lambda s: False),
    (re.compile(r"^[-+]?[0-9]+$"), lambda s: _safe(int(s))),
    (re.compile(r"^0o[0-7]+$"), lambda s: _safe(int(s[2:], 8))),
    (re.compile(r"^0x[0-9a-fA-F]+$"), lambda s: _safe(int(s[2:], 16))),
    (re.compile(r"^[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?$"), float),
    (re.compile(r"^-?\.(inf|Inf)$"), lambda s: float("-inf" if s[0] == "-" else "inf")),
    (re.compile(r"^\.(nan|NaN|NAN)$"), lambda s: float("nan")),
]


#: How a scalar that is more than a text can begin.
_TYPED = re.compile(r"$|~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+.0-9]")


def _safe(n: int) -> int:
    if abs(n) >= 2**53:
        raise Refused(f"integer out of range: {n}")
    return n


def scalar(text: str) -> Any:
    """A plain scalar by the core schema."""
    if not _TYPED.match(text):
        return text
    for pattern, read in _CORE:
        if pattern.match(text):
            return read(text)
    return text


def parse_yaml(text: str) -> list[tuple[int, int, Any]]:
    """(document, line, value) of every document of a strict text; refuses anchors, aliases, tags, merge and repeated keys, tabs."""
    tab = _TAB.search(text) if "\t" in text else None
    if tab:
        raise Refused("tab in indentation", text.count("\n", 0, tab.start()) + 1)
    try:
        try:
            nodes = _composed(text, yaml.SafeLoader if _DIFFER.search(text) else _FAST)
            if any(isinstance(n, yaml.ScalarNode) and not n.value for n in nodes):  # the readers place an empty document differently
                nodes = _composed(text, yaml.SafeLoader)
        except (yaml.YAMLError, Refused):
            nodes = _composed(text, yaml.SafeLoader)  # what is refused, and why, is said by the library's own reader
    except yaml.YAMLError as x:
        mark = getattr(x, "problem_mark", None)
        raise Refused(str(getattr(x, "problem", x)), mark.line + 1 if mark else 0) from x
    return [(i, n.start_mark.line + 1, _value(n)) for i, n in enumerate(nodes) if n is not None]


class _Fast(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The library's reader in C, which is some twenty times as fast, where it is built; without tags, which nothing here reads."""

    def resolve(self, kind: type, value: Any, implicit: Any) -> str:
        return ""

    def descend_resolver(self, parent: Any, index: Any) -> None:
        pass

    def ascend_resolver(self) -> None:
        pass


_FAST = _Fast
#: What the two readers take differently: tabs, `?`, breaks and marks beyond ASCII, and a `#` right after the sign of a block.
_DIFFER = re.compile("[\t?\x85\u2028\u2029\ufeff|>](?:(?<![|>])|[-+0-9]*#)")
_TAB = re.compile(r"^ *\t", re.M)


def _composed(text: str, loader: type) -> list[yaml.Node]:
    """The documents of a text without anchors, aliases and tags; a text without their signs is read once."""
    if re.search(r"[&*!]", text):
        for event in yaml.parse(text, Loader=loader):
            line = event.start_mark.line + 1
            if isinstance(event, yaml.AliasEvent):
                raise Refused("alias", line)
            if getattr(event, "anchor", None):
                raise Refused("anchor", line)
            if getattr(event, "tag", None):
                raise Refused("tag", line)
    return list(yaml.compose_all(text, Loader=loader))


def _value(node: yaml.Node) -> Any:
    if isinstance(node, yaml.ScalarNode):
        return node.value if node.style else scalar(node.value)
    if isinstance(node, yaml.SequenceNode):
        return [_value(x) for x in node.value]
    out: dict = {}
    for k, v in node.value:
        key = _value(k)
        line = k.start_mark.line + 1
        if not isinstance(key, str):
            key = str(k.value)
        if key == "<<":
            raise Refused("merge key", line)
        if key in out:
            raise Refused(f"repeated key {key}", line)
        out[key] = _value(v)
    return out


def parse_toml(text: str) -> Any:
    """A TOML document; dates and times stay as they are written."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return x if isinstance(x, str | bool | int | float) else x.isoformat()

    try:
        return plain(tomllib.loads(text))
    except tomllib.TOMLDecodeError as x:
        found = re.search(r"line (\d+)", str(x))
        raise Refused(str(x), int(found[1]) if found else 0) from x


def parse_jsonc(text: str) -> Any:
    """JSON with comments and trailing commas."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == '"':
            end = re.compile(r'"(?:[^"\\]|\\.)*"').match(text, i)
            if not end:
                raise Refused("unterminated string", text.count("\n", 0, i) + 1)
            out.append(end[0])
            i = end.end()
        elif text.startswith("//", i):
            i = (text.find("\n", i) + len(text) + 1) % (len(text) + 1)
        elif text.startswith("/*", i):
            stop = text.find("*/", i + 2)
            i = len(text) if stop < 0 else stop + 2
        else:
            if c in "}]":  # a comma before it, outside strings, goes
                last = next((j for j in range(len(out) - 1, -1, -1) if not out[j].isspace()), -1)
                if last >= 0 and out[last] == ",":
                    del out[last]
            out.append(c)
            i += 1
    try:
        return json.loads("".join(out))
    except ValueError as x:
        raise Refused(str(x)) from x


def parse_ini(text: str) -> dict[str, dict[str, str]]:
    reader = configparser.RawConfigParser(strict=False, allow_no_value=True, default_section="\0")
    try:
        reader.read_string(text)
    except configparser.Error as x:
        raise Refused(str(x)) from x
    return {s: {k: (v or "").strip() for k, v in reader.items(s)} for s in reader.sections()}


def go_mod(text: str) -> list[tuple[str, str]]:
    """(directive, value) of module, require, replace and use lines, blocks included."""
    out, block = [], None
    for raw in text.split("\n"):
        line = raw.split("//")[0].strip()
        if line == ")":
            block = None
        elif block and line:
            out.append((block, line.split()[0]))
        elif m := re.match(r"^(module|require|replace|use|exclude)\s+(.*)$", line):
            if m[2] == "(":
                block = m[1]
            else:
                out.append((m[1], m[2].split()[0]))
    return out


def package_json(text: str) -> list[tuple[str, str, str]]:
    """(kind, name, value) of the name, scripts and dependency fields of a package manifest."""
    doc = json.loads(text)
    out = [("name", doc["name"], "")] if isinstance(doc.get("name"), str) else []
    for field in ("scripts", "dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        out += [(field, k, str(v)) for k, v in sorted((doc.get(field) or {}).items())]
    return out


def cargo_manifest(text: str) -> list[tuple[str, str, str]]:
    """(kind, name, path) of the package, members and dependencies of a crate."""
    doc = parse_toml(text)
    out = [("package", doc.get("package", {}).get("name", ""), "")] if "package" in doc else []
    out += [("member", m, "") for m in doc.get("workspace", {}).get("members", [])]
    for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, v in sorted(doc.get(kind, {}).items()):
            d = v if isinstance(v, dict) else {}
            out.append((kind, d.get("package", name), d.get("path", "workspace" if d.get("workspace") else "")))
    return out


def crate_links(text: str) -> list[tuple[str, str | None, str | None, str | None, bool]]:
    """(kind, key, name, place, inherits) of what a crate manifest says of crates: its own, its dependencies, redirects."""
    doc = parse_toml(text)
    tables = lambda d, *keys: [t for k in keys if isinstance(t := d.get(k), dict)]
    said = lambda v: v if isinstance(v, str) else None
    out: list = [("package", None, said(p.get("name")) or "", None, False) for p in tables(doc, "package")]

    def named(kind: str, table: dict) -> None:
        for key, v in table.items():
            d = v if isinstance(v, dict) else {}
            out.append((kind, key, said(d.get("package")) or key, said(d.get("path")), d.get("workspace") is True))

    def redirected(table: dict, above: str = "") -> None:
        for key, v in table.items():
            whole = f"{above}.{key}" if above else key
            if not isinstance(v, dict):
                continue
            if isinstance(v.get("path"), str):
                name = said(v.get("package")) or ("" if "://" in whole else whole.split(":")[0].strip())
                if name:
                    out.append(("redirect", whole, name, v["path"], False))
            else:
                redirected(v, whole)

    for space in tables(doc, "workspace"):
        out.append(("workspace", None, None, None, False))
        for t in tables(space, "dependencies"):
            named("shared", t)
    platforms = [t for target in tables(doc, "target") for t in target.values() if isinstance(t, dict)]
    for d in (doc, *platforms):
        for kind, key in (("build", "dependencies"), ("build", "build-dependencies"), ("test", "dev-dependencies")):
            for t in tables(d, key):
                named(kind, t)
    for registry in [t for patch in tables(doc, "patch") for t in patch.values() if isinstance(t, dict)]:
        for key, v in registry.items():
            if isinstance(v, dict) and isinstance(v.get("path"), str):
                out.append(("redirect", key, said(v.get("package")) or key, v["path"], False))
    for t in tables(doc, "replace"):
        redirected(t)
    return out


SPECIFIER = re.compile(r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)\s*(\[[^\]]*\])?\s*(@\s*\S+|(?:[<>=!~]=?|===)[^;]*|\([^)]*\))?\s*(;.*)?$")


def requirement(line: str) -> str | None:
    """The normal name of a requirement line; None where it is none."""
    m = SPECIFIER.match(line.split(" #")[0])
    return re.sub(r"[-_.]+", "-", m[1]).lower() if m else None


def pyproject(text: str) -> list[tuple[str, str]]:
    """(kind, name) of the project, its dependencies and its workspace members."""
    doc = parse_toml(text)
    project = doc.get("project", {})
    out = [("name", re.sub(r"[-_.]+", "-", project["name"]).lower())] if project.get("name") else []
    out += [("dependency", r) for x in project.get("dependencies", []) if (r := requirement(x))]
    for group in (*project.get("optional-dependencies", {}).values(), *doc.get("dependency-groups", {}).values()):
        out += [("test-dependency", r) for x in group if isinstance(x, str) and (r := requirement(x))]
    out += [("member", m) for m in doc.get("tool", {}).get("uv", {}).get("workspace", {}).get("members", [])]
    return out


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi(text: str) -> list[tuple[str, str, str]]:
    """(method, route, operation id) of an OpenAPI document in JSON or YAML."""
    doc = json.loads(text) if text.lstrip().startswith("{") else parse_yaml(text)[0][2]
    return [(m.upper(), route, str(ops[m].get("operationId", ""))) for route, ops in (doc.get("paths") or {}).items() for m in METHODS if isinstance(ops, dict) and isinstance(ops.get(m), dict)]


def protobuf(text: str) -> list[tuple[str, str, str, bool]]:
    """(service, method, request, streaming) of a protobuf file."""
    plain = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", text)
    out = []
    for m in re.finditer(r"\bservice\s+(\w+)\s*\{", plain):
        depth, at = 1, m.end()
        while depth and at < len(plain):
            depth += {"{": 1, "}": -1}.get(plain[at], 0)
            at += 1
        for r in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)", plain[m.end() : at]):
            out.append((m[1], r[1], r[3], bool(r[2] or r[4])))
    return out


def graphql(text: str) -> list[tuple[str, str]]:
    """(kind, name) of types and root fields of a schema."""
    plain = re.sub(r"#[^\n]*|\"\"\"[\s\S]*?\"\"\"", "", text)
    out = [(m[1], m[2]) for m in re.finditer(r"\b(type|interface|enum|input|union|scalar)\s+(\w+)", plain)]
    for m in re.finditer(r"\b(?:extend\s+)?type\s+(Query|Mutation|Subscription)\b[^{]*\{([^}]*)\}", plain):
        out += [(m[1].lower(), f[1]) for f in re.finditer(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:", m[2], re.M)]
    return out


_CONTROL = re.compile(r"\$\(|`|<\(|\|(?!\|)|(^|[;\s])(if|for|while|case|until|function)\s|\{|\}|<<")


def shell_commands(script: str) -> list[tuple[int, str, list[str]]]:
    """(n, command, words) of the plain commands of a script; none where it has control flow, pipes or substitutions."""
    if _CONTROL.search(script):
        return []
    out = []
    for line in re.sub(r"\\\n\s*", " ", script).split("\n"):
        for part in re.split(r"&&|;|\|\|", line):
            words = [a or b or c for a, b, c in re.findall(r"\"([^\"]*)\"|'([^']*)'|(\S+)", part.split(" #")[0])]
            if words and not words[0].startswith("#"):
                out.append((len(out), part.split(" #")[0].strip(), words))
    return out


def workflow_steps(text: str) -> list[tuple[str, int, str, str, str]]:
    """(job, step, name, run, working directory) of a CI workflow."""
    doc = parse_yaml(text)[0][2]
    out = []
    for job, body in (doc.get("jobs") or {}).items():
        for i, s in enumerate((body or {}).get("steps") or []):
            if isinstance(s, dict) and isinstance(s.get("run"), str):
                out.append((job, i, str(s.get("name", "")), s["run"], str(s.get("working-directory", "."))))
    return out


def playbook(text: str) -> list[tuple[str, str, str]]:
    """(hosts, module, name) of the tasks of a playbook, blocks entered."""
    out = []

    def walk(hosts: str, tasks: list) -> None:
        for t in tasks or []:
            if not isinstance(t, dict):
                continue
            for k in ("block", "rescue", "always"):
                walk(hosts, t.get(k))
            module = next((k for k in t if k not in ("name", "when", "block", "rescue", "always", "become", "tags", "vars", "register", "notify", "loop", "with_items")), None)
            if module:
                args = t[module]
                out.append((hosts, module, str(args.get("name", "")) if isinstance(args, dict) else str(args)))

    for play in parse_yaml(text)[0][2] or []:
        for k in ("pre_tasks", "tasks", "post_tasks", "handlers"):
            walk(str(play.get("hosts", "")), play.get(k))
        out += [(str(play.get("hosts", "")), "role", r if isinstance(r, str) else str(r.get("role", ""))) for r in play.get("roles") or []]
    return out


def wrangler(text: str) -> list[tuple[str, str, str]]:
    """(kind, binding, target) of bindings, services, schedules and variables of an edge manifest."""
    doc = parse_toml(text) if not text.lstrip().startswith("{") else parse_jsonc(text)
    out = [(k, b.get("binding", b.get("name", "")), str(b.get("bucket_name") or b.get("database_name") or b.get("id") or b.get("queue") or "")) for k in ("r2_buckets", "d1_databases", "kv_namespaces") for b in doc.get(k, [])]
    out += [("queue", q.get("binding", ""), q.get("queue", "")) for q in (doc.get("queues") or {}).get("producers", [])]
    out += [("service", s.get("binding", ""), s.get("service", "")) for s in doc.get("services", [])]
    out += [("cron", "", c) for c in (doc.get("triggers") or {}).get("crons", [])]
    return out + [("var", k, str(v)) for k, v in (doc.get("vars") or {}).items()]


def edge_platform(text: str) -> list[tuple[str, str | None, str | None]]:
    """(kind, name, value) of what an edge manifest declares: its name, bindings by kind, services, schedules and variables."""
    doc = parse_toml(text) if not text.lstrip().startswith("{") else parse_jsonc(text)
    queues, named = doc.get("queues") or {}, lambda x, *keys: str(next((x[k] for k in keys if x.get(k)), ""))
    out: list[tuple[str, str | None, str | None]] = [("name", None, str(doc["name"]))] if doc.get("name") else []
    lists = [
        ("kv", doc.get("kv_namespaces"), ("binding",)), ("d1", doc.get("d1_databases"), ("binding",)), ("r2", doc.get("r2_buckets"), ("binding",)), ("durable-object", (doc.get("durable_objects") or {}).get("bindings"), ("name",)),
        ("email-routing", doc.get("send_email"), ("name", "binding")), ("queue-producer", queues.get("producers"), ("binding",)), ("queue-consumer", queues.get("consumers"), ("queue", "binding")),
    ]
    out += [(kind, named(x, *keys), None) for kind, rows, keys in lists for x in rows or []]
    out += [("service-binding", named(x, "binding"), named(x, "service")) for x in doc.get("services") or []]
    out += [("cron", None, str(c)) for c in (doc.get("triggers") or {}).get("crons") or []]
    return out + [("var", k, v) for k, v in (doc.get("vars") or {}).items() if isinstance(v, str)]


def compiler_config(text: str) -> list[tuple]:
    """(extends, base_url, paths) of a compiler configuration."""
    doc = parse_jsonc(text)
    options = doc.get("compilerOptions") or {}
    extends = doc.get("extends")
    parents = [x for x in (extends if isinstance(extends, list) else [extends]) if isinstance(x, str)]
    paths = options.get("paths")
    targets = {k: [t for t in v if isinstance(t, str)] for k, v in paths.items() if isinstance(v, list)} if isinstance(paths, dict) else None
    return [(parents, options["baseUrl"] if isinstance(options.get("baseUrl"), str) else None, targets)]


def package_imports(text: str) -> list[tuple[str, int, str]]:
    """(pattern, ord, target) of the `imports` of a package manifest; every branch of a condition is a target."""

    def targets(t: Any) -> list[str]:
        if isinstance(t, str):
            return [t]
        inner = t if isinstance(t, list) else [t[k] for k in sorted(t)] if isinstance(t, dict) else []
        return [x for i in inner for x in targets(i)]

    found = json.loads(text).get("imports")
    return [(pattern, n, t) for pattern, value in found.items() for n, t in enumerate(targets(value))] if isinstance(found, dict) else []


def js_imports(text: str) -> list[tuple[str, bool]]:
    """(specifier, type only) of a module's imports; type only where each of them is."""
    plain = mask(text)
    found: dict[str, bool] = {}
    for m in re.finditer(r"\b(?:import|export)\s+(type\s)?(?:[\w*{}\s,$]+\sfrom\s*)?[\"']([^\"']+)[\"']|\b(?:import|require)\s*\(\s*[\"']([^\"']+)[\"']", plain):
        spec, only = m[2] or m[3], bool(m[1])
        found[spec] = found.get(spec, True) and only
    return sorted(found.items())


def mask(text: str) -> str:
    """A text with its `//` and `/* */` comments blanked, strings kept, places kept."""
    pattern = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*[\s\S]*?\*/")
    return pattern.sub(lambda m: m[0] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0]), text)


def python_imports(text: str) -> list[str]:
    """Top-level names that a Python file imports."""
    found = set()
    for m in re.finditer(r"^[ \t]*(?:import[ \t]+([\w., \t]+)|from[ \t]+([\w.]+)[ \t]+import\b)", text, re.M):
        for name in (m[1] or m[2]).split(","):
            top = name.strip().split(" ")[0].split(".")[0]
            if top:
                found.add(top)
    return sorted(found)


def rust_idents(text: str) -> list[str]:
    """Crate identifiers that a Rust file uses, tests left out."""
    plain = mask(text)
    plain = re.sub(r"#\[cfg\(test\)\]\s*mod\s+\w+\s*\{[\s\S]*\}\s*$", "", plain)
    return sorted({m[1] for m in re.finditer(r"\b(?:use|extern\s+crate)\s+(?:::)?([a-z_][a-z0-9_]*)", plain)} - {"crate", "self", "super", "std", "core", "alloc"})


def symbols(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, line, column) of declarations of a TypeScript file, and of other uses of the declared names."""
    plain = mask(text)
    declared = {m.start(2): m[2] for m in re.finditer(r"\b(function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)", plain)}
    names, out = set(declared.values()), []
    for m in re.finditer(r"[A-Za-z_$][\w$]*", plain):
        if m[0] in names:
            line = plain.count("\n", 0, m.start()) + 1
            out.append(("declaration" if m.start() in declared else "reference", m[0], line, m.start() - plain.rfind("\n", 0, m.start())))
    return out


def descriptors(text: str) -> list[tuple]:
    """(line, kind, name, description, type, system, domain, provider, contract, docs, constraints, runbooks) of each descriptor."""
    out = []
    for _, line, doc in parse_yaml(text):
        if doc is None:
            continue
        meta, spec = doc.get("metadata") or {}, doc.get("spec") or {}
        linked = spec.get("context") or {}
        named = [None if meta.get(k) is None else str(meta[k]) for k in ("name", "description")] + [None if spec.get(k) is None else str(spec[k]) for k in ("type", "system", "domain", "provider")]
        out.append((line, doc.get("kind"), *named, (spec.get("contract") or {}).get("ref"), *[[str(x) for x in linked.get(k) or []] for k in ("docs", "constraints", "runbooks")]))
    return out


def journeys(text: str) -> list[tuple[str, str, list[str]]]:
    """(id, description, components) of a journeys document."""
    docs = parse_yaml(text)
    return [(str(j["id"]), str(j.get("description", "")), [str(c) for c in j.get("components") or []]) for _, _, doc in docs for j in (doc or {}).get("journeys") or []]


def observations(text: str) -> list[tuple]:
    """(set, environment, captured_at, max_age_days, bundle, supersedes, id, subject, key, value_json) of the facts of observation sets."""
    out = []
    for _, line, doc in parse_yaml(text):
        if doc.get("kind") != "ObservationSet":
            raise Refused("kind must be ObservationSet", line)
        m = doc.get("metadata") or {}
        head = (m.get("name"), m.get("environment"), str(m.get("capturedAt")), m.get("maxAgeDays"), m.get("evidenceBundle"), m.get("supersedes"))
        out += [(*head, f.get("id"), f.get("subject"), f.get("key"), json.dumps(f.get("value"), sort_keys=True)) for f in (doc.get("spec") or {}).get("facts") or []]
    return out


def overrides(text: str) -> list[tuple]:
    """(n, fact, subject, target, contract, reason, review_when, path, sha256) of the evidence of reviewed overrides in a configuration."""
    doc = parse_yaml(text)[0][2] or {}
    out = []
    for n, o in enumerate(doc.get("reviewedOverrides") or []):
        head = (n, o.get("fact"), o.get("subject"), o.get("target"), o.get("contractRef"), o.get("reason"), o.get("reviewWhen"))
        out += [(*head, e.get("path"), e.get("sha256")) for e in o.get("evidence") or [{}]]
    return out


def task_graph(text: str) -> list[str]:
    """Tasks that a task-graph configuration declares."""
    doc = json.loads(text)
    return sorted(doc.get("tasks") or doc.get("pipeline") or {})


def workspace_bases(text: str) -> list[str]:
    """Directories whose children are members of a workspace: each pattern up to its first `*`."""
    out = []
    for g in (parse_yaml(text)[0][2] or {}).get("packages") or []:
        if isinstance(g, str) and ".." not in g:
            parts = [s for s in g.split("/") if s and s != "**"]
            if "*" in parts and parts.index("*"):
                out.append("/".join(parts[: parts.index("*")]))
    return out


def contract_outline(text: str) -> list[tuple]:
    """(openapi, asyncapi, title, paths, channels, components) of an API document: its versions, and whether each part is there."""
    try:
        doc = parse_yaml(text)[0][2]
    except (Refused, IndexError):
        try:
            doc = json.loads(text)
        except ValueError:
            raise Refused("not parseable as YAML or JSON") from None
    if not isinstance(doc, dict):
        raise Refused("root is not a mapping")
    said = lambda x: x if isinstance(x, str) else None
    info = doc.get("info") if isinstance(doc.get("info"), dict) else {}
    async_ = None if doc.get("asyncapi") is None else str(doc["asyncapi"])
    return [(said(doc.get("openapi")), async_, said(info.get("title")), isinstance(doc.get("paths"), dict), isinstance(doc.get("channels"), dict), "components" in doc)]


#: Parsers by name.
PARSERS: dict[str, Callable[[str], Any]] = {
    "yaml": parse_yaml, "toml": parse_toml, "jsonc": parse_jsonc, "ini": parse_ini, "go_mod": go_mod, "package_json": package_json, "cargo": cargo_manifest, "crate_links": crate_links, "pyproject": pyproject, "openapi": openapi, "protobuf": protobuf,
    "graphql": graphql, "shell": shell_commands, "workflow": workflow_steps, "playbook": playbook, "wrangler": wrangler, "js_imports": js_imports, "python_imports": python_imports, "rust_idents": rust_idents, "symbols": symbols,
    "compiler_config": compiler_config, "edge_platform": edge_platform, "package_imports": package_imports,
    "contract_outline": contract_outline, "task_graph": task_graph, "workspace_bases": workspace_bases, "descriptors": descriptors, "journeys": journeys, "observations": observations, "overrides": overrides,
}


def rows(files: DataFrame, parser: str, schema: str, text: str = "text") -> DataFrame:
    """files with the fields of every row that a parser finds, or with `error` and `error_line` where it refuses."""
    f = PARSERS[parser]

    @F.pandas_udf(f"rows array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split() for c in schema.split(', ')))}>>, error string, error_line int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                found = f(t) if t is not None else []
                found = found if isinstance(found, list) else list(found.items()) if isinstance(found, dict) else [found]
                out.append(([r if isinstance(r, tuple) else (r,) for r in found], None, None))
            except (ValueError, TypeError, AttributeError, KeyError, IndexError) as x:
                out.append(([], str(x), getattr(x, "line", None)))
        return pd.DataFrame(out, columns=["rows", "error", "error_line"]).astype({"error_line": "Int32"})

    parsed = files.withColumn("p_", run(F.col(text)))
    return parsed.select(*files.columns, F.explode_outer("p_.rows").alias("r_"), F.col("p_.error").alias("error"), F.col("p_.error_line").alias("error_line")).select(*files.columns, "r_.*", "error", "error_line")
