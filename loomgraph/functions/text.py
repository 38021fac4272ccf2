"""Names, commands and secrets as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def kebab(s: Column) -> Column:
    """Lower-case words of letters and digits joined by `-`, also at camel-case borders: 63 characters at most, `component` for none."""
    bordered = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^@", ""), r"[_\s]+", "-"), "([a-z0-9])([A-Z])", "$1-$2")
    plain = F.regexp_replace(F.regexp_replace(bordered, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(F.lower(plain), 1, 63), F.lit("")), F.lit("component"))


def slugify(s: Column) -> Column:
    """Anchor of a heading: lower case, letters, digits and `-` kept, each space to `-`."""
    kept = F.regexp_replace(F.lower(F.trim(s)), r"[^\p{L}\p{N}\s-]", "")
    return F.regexp_replace(kept, r"\s", "-")


def normalise_name(s: Column) -> Column:
    """Letters and digits in lower case, without a last word that says what kind of thing it names."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", ""), "(api|service|worker|app|module|package|lib|library)$", "")


def distribution_name(s: Column) -> Column:
    """A Python distribution name in its normal form."""
    return F.regexp_replace(F.lower(s), "[-_.]+", "-")


def rust_ident(s: Column) -> Column:
    return F.translate(s, "-", "_")


def sentence(s: Column) -> Column:
    """White space folded, a full stop at the end; a note to write one where there is none."""
    folded = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(folded == "", "TODO: describe this in one present-tense sentence.").when(folded.rlike("[.!?]$"), folded).otherwise(F.concat(folded, F.lit(".")))


def one_sentence(s: Column) -> Column:
    """Whether a description is one sentence: a stop at its end, none before, and no line break."""
    return s.rlike(r"^[^.!?\r\n]*[.!?]\z")


def fact_key(s: Column) -> Column:
    return s.rlike(r"^[a-z][A-Za-z0-9]*([.-][A-Za-z0-9]+)+$") & (F.length(s) <= 80)


#: Fixed value: the shape of an event subject.
EVENT_SUBJECT = r"^[A-Za-z0-9][A-Za-z0-9._>*-]*$"


def event_plausible(s: Column, prefixes: list[str] | None = None) -> Column:
    ok = s.isNotNull() & (F.length(s).between(1, 200)) & s.rlike(EVENT_SUBJECT)
    if prefixes:
        any_ = F.lit(False)
        for p in prefixes:
            any_ = any_ | s.startswith(p)
        ok = ok & any_
    return F.coalesce(ok, F.lit(False))


def route_of_file(base: Column, rel: Column) -> Column:
    """Route of a file at rel under a routes directory; null for none.

    Under `app` (or `.../app`) the directories of `route.ts`, `route.tsx` and `route.js` are routes: groups in parentheses
    are empty, `[x]` is `:x`, `[...x]` is `:x*`. Under any other directory it is `api/*.ts` without the ending.
    """
    part = lambda x: F.when(x.rlike(r"^\(.*\)$"), "").otherwise(F.regexp_replace(F.regexp_replace(x, r"^\[\.\.\.(.+)\]$", ":$1*"), r"^\[(.+)\]$", ":$1"))
    parts = F.split(rel, "/")
    app = F.when(rel.rlike(r"/route\.(ts|tsx|js)$"), F.concat(F.lit("/"), F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), part), "/")))
    pages = F.when(rel.startswith("api/") & rel.endswith(".ts"), F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(rel, "^api/", ""), r"\.ts$", "")))
    return F.when(base.endswith("app"), app).otherwise(pages)


def round4(x: Column) -> Column:
    return F.round(x, 4)


# What a task name says of its tier, in the order in which the rows are read.
WORKFLOW_GATE = r"^(?:test|tests|e2e|integration|lint|typecheck|type-check|build|compile|check|api:check|contract|catalog|drift)(?:$|[:_-])"
WORKFLOW_TIERS = [
    (r"(?:^|[:_-])(?:e2e|playwright|cypress)(?:$|[:_-])", "e2e"),
    (r"(?:contract|openapi|api:check|drift|catalog)", "contract"),
    (r"(?:^|[:_-])integration(?:$|[:_-])", "integration"),
    (r"^(?:lint|typecheck|type-check)", "static"),
    (r"^(?:tests?|check)(?:$|[:_-])", "unit"),
    (r"^(?:build|compile)(?:$|[:_-])", "build"),
]
TASK_REFUSED = r"(^|[:_-])(watch|dev|serve|start|preview)([:_-]|$)"
TASK_TIERS = [
    (r"(^|[:_-])e2e-lite([:_-]|$)", "integration"),
    (r"(^|[:_-])(e2e|playwright|cypress|acceptance)([:_-]|$)", "e2e"),
    (r"(^|[:_-])(contract|openapi|drift|schema)([:_-]|$)", "contract"),
    (r"(^|[:_-])(integration|itest|e2e-lite)([:_-]|$)", "integration"),
    (r"(^|[:_-])(lint|typecheck|check-types|type-check|golangci|vet|fmt|format|audit)([:_-]|$)", "static"),
    (r"(^|[:_-])(unit|jest|vitest|mocha)([:_-]|$)", "unit"),
    (r"(^|[:_-])(build|compile|generate|bundle)([:_-]|$)", "build"),
    (r"(^|[:_-])(test|tests|verify|check)([:_-]|$)", "unit"),
]
SCRIPT_REFUSED = r"^(dev|start|serve|watch|preview|clean|postinstall|preinstall|prepare|format|format:fix)$"
SCRIPT_TIERS = [
    (r"^(test|tests)$|^test:unit$|^test:unit:", "unit"),
    (r"^test:integration$|^test:integration:", "integration"),
    (r"^test:contract$|^test:contract:", "contract"),
    (r"^test:e2e$|^test:e2e:", "e2e"),
    (r"^test:browser$", "unit"),
    (r"^(lint|typecheck|check-types|type-check)$", "static"),
    (r"^(build|compile)$", "build"),
]


def _tier(s: Column, refused: Column, table: list[tuple[str, str]]) -> Column:
    out = F.when(refused, F.lit(None).cast("string"))
    for pattern, tier in table:
        out = out.when(s.rlike(pattern), tier)
    return out


def workflow_tier(s: Column) -> Column:
    return _tier(s, ~s.rlike(WORKFLOW_GATE), WORKFLOW_TIERS)


def task_tier(s: Column) -> Column:
    return _tier(s, s.rlike(TASK_REFUSED), TASK_TIERS)


def script_tier(s: Column) -> Column:
    return _tier(s, s.rlike(SCRIPT_REFUSED), SCRIPT_TIERS)


# Secrets in published text: a pattern for each form that is refused. Written for engines without look-around.
SECRET_FORMS = [
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("cloud-key-id", r"(^|[^A-Z0-9])(AKIA|ASIA)[A-Z0-9]{16}"),
    ("token-prefix", r"(^|[^A-Za-z0-9])(ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{10,}|sk-[A-Za-z0-9]{20,})"),
    ("web-token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("credentialed-url", r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@"),
    ("bearer", r"(?i)bearer\s+[A-Za-z0-9._~+/-]{16,}"),
    ("assigned", r"(?i)(secret|token|password|passwd|api[_-]?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_./+-]{12,}"),
]
MARK = "[REDACTED]"
NAME_WORDS = "SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIAL|API_?KEY|PRIVATE_?KEY|ACCESS_?KEY"
ASSIGNED = rf"(?i)([A-Z0-9_]*({NAME_WORDS})[A-Z0-9_]*\s?=\s?)(\"[^\"]*\"|'[^']*'|[^\s]+)"
URL_LOGIN = r"(://)[^/\s:@]+:[^/\s@]+@"


def secret_form(text: Column) -> Column:
    """The first form of secret that a text holds; null for none."""
    out = F.lit(None).cast("string")
    clean = F.replace(text, F.lit(MARK), F.lit(""))
    for name, pattern in reversed(SECRET_FORMS):
        out = F.when(clean.rlike(pattern), name).otherwise(out)
    return out


def redact_command(command: Column) -> Column:
    """Values assigned to telling names and logins in addresses replaced; trimmed, 600 characters at most."""
    out = F.regexp_replace(F.regexp_replace(command, ASSIGNED, "$1[REDACTED]"), URL_LOGIN, "$1[REDACTED]@")
    return F.substring(F.trim(out), 1, 600)


def document_kind(p: Column) -> Column:
    """What a file is by its extension."""
    return (
        F.when(p.rlike(r"\.(md|mdx|adoc|rst|txt)$"), "documentation").when(p.rlike(r"\.proto$"), "protobuf").when(p.rlike(r"\.(graphql|gql|graphqls)$"), "graphql")
        .when(p.rlike(r"(?i)asyncapi[^/]*\.(ya?ml|json)$"), "asyncapi").when(p.rlike(r"(?i)(openapi|swagger)[^/]*\.(ya?ml|json)$"), "openapi")
    )


def edit_distance(a: Column, b: Column):
    """Edit distance that counts a swap of neighbours as one (a Python function: Spark has none with swaps)."""
    @F.pandas_udf("int")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else swap_distance(x, y) for x, y in zip(xs, ys, strict=True)], dtype="Int32")

    return run(a, b)


def swap_distance(a: str, b: str) -> int:
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + 1, rows[i - 1][j] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]
