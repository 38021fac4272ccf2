"""Facts and elections: aggregates of fixed size a group, no Python and no list of a group's rows.

Facts are rows (ord, subject, key, value_json, evidence_class, confidence, observed_at, superseded, normative). Groups of
(subject, key) are decided by the first rule of a decision table that applies; nothing wins by its class alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settle import settle


def select_rules(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """groups with rule_id, elect of the rule whose pattern matches `subject key`; the longest pattern, then the first.

    Rules (ord, id, key_pattern, elect) are a configuration document, a few rows that Catalyst broadcasts by their size.
    """
    text = F.concat_ws(" ", "subject", "key")
    keys = groups.select("subject", "key").distinct()
    hit = keys.join(rules, F.rlike(text, F.col("key_pattern")))
    best = hit.groupBy("subject", "key").agg(F.max_by(F.struct("id", "elect"), F.struct(F.length("key_pattern"), -F.col("ord"))).alias("r"))
    return groups.join(best.select("subject", "key", F.col("r.id").alias("rule_id"), F.col("r.elect").alias("elect")), ["subject", "key"], "left")


def supersede(facts: DataFrame, sets: DataFrame) -> DataFrame:
    """facts with `superseded`: their (observed_at, environment) is that of a set which another set names.

    sets: (id, environment, captured_at, supersedes).
    """
    old = sets.select(F.col("supersedes").alias("old_id")).where("old_id is not null").distinct().join(sets, F.col("old_id") == F.col("id"))
    marks = old.select(F.col("captured_at").alias("at_"), F.col("environment").alias("env_")).distinct().withColumn("superseded", F.lit(True))
    hit = (F.col("observed_at") == F.col("at_")) & (F.col("environment") == F.col("env_"))
    return facts.join(marks, hit, "left").drop("at_", "env_").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def _groups(live: DataFrame) -> DataFrame:
    """(subject, key) with what the decision table asks of a group: counts, least ords, classes, the newest dated row.

    Rows are counted by class, values and dates apart, in buffers of fixed width that combine before the exchange; only the
    few classes of a group meet in one row. A group may hold a third of all facts.
    """
    c = F.col
    candidate, firm = F.coalesce(c("confidence") == "candidate", F.lit(False)), F.coalesce(c("confidence") != "candidate", F.lit(False))
    normative, size = F.coalesce(c("normative"), F.lit(False)), F.size("list")
    key = ["subject", "key"]
    by_class = live.groupBy(*key, "evidence_class").agg(
        F.count("*").alias("n_rows"), F.bool_or(normative).alias("has_normative"), F.bool_and(normative | candidate).alias("gated"), F.count_if(firm).alias("n_firm"), F.min(F.when(firm, c("ord"))).alias("ord"),
        F.count_if(firm & c("list").isNotNull()).alias("n_lists"), F.max_by("ord", F.when(firm & c("list").isNotNull(), size)).alias("longest_ord"), F.max(F.when(firm & c("list").isNotNull(), size)).alias("longest"),
        F.bool_or(c("supersedes").isNotNull()).alias("superseding"), F.bool_or(candidate).alias("has_candidate"),
    )
    g = by_class.groupBy(*key).agg(
        F.sum("n_rows").alias("n_rows"), F.bool_or("has_normative").alias("has_normative"), F.bool_and("gated").alias("gated"), F.sum("n_firm").alias("n_firm"), F.sum("n_lists").alias("n_lists"),
        F.max_by("longest_ord", "longest").alias("longest_ord"), F.bool_or("superseding").alias("superseding"), F.bool_or("has_candidate").alias("has_candidate"),
        F.collect_set("evidence_class").alias("all_classes"),
        F.map_from_entries(F.collect_list(F.when((c("n_firm") > 0) & c("evidence_class").isNotNull(), F.struct("evidence_class", F.struct(c("n_firm").alias("n"), "ord"))))).alias("by_class"),
    )
    values = live.select(*key, "value_json").distinct().groupBy(*key).agg(F.count("value_json").alias("n_values"))
    dated = live.where(firm & (c("evidence_class") == "OBSERVED_RUNTIME") & c("observed_at").isNotNull())
    newest = dated.groupBy(*key).agg(F.count("*").alias("n_dated"), F.max(F.struct("observed_at", "ord")).alias("newest"))
    return g.withColumn("gated", c("gated") & c("has_normative")).join(values, key).join(newest, key, "left")


def _supersets(live: DataFrame, groups: DataFrame) -> DataFrame:
    """(subject, key, superset_ord) of groups whose longest list holds every element of all others and is longer than each."""
    asked = groups.where("not has_normative and n_values > 1 and n_firm > 1 and n_lists = n_firm").select("subject", "key", "longest_ord")
    rows = live.where("confidence <> 'candidate' and list is not null").select("subject", "key", "ord", "list").join(asked, ["subject", "key"])
    whole = rows.where("ord = longest_ord").select("subject", "key", F.col("list").alias("whole"))
    inside = (F.col("ord") == F.col("longest_ord")) | ((F.size("list") < F.size("whole")) & (F.size(F.array_except("list", "whole")) == 0))
    holds = rows.join(whole, ["subject", "key"]).groupBy("subject", "key").agg(F.bool_and(inside).alias("holds"), F.min("longest_ord").alias("superset_ord"))
    return holds.where("holds").drop("holds")


def elect(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a group: subject, key, case, elected_ord, basis, conflict_status, conflict_kind, rule_id, n_rows, n_values.

    facts also has `list` (array of strings, null unless the value is a list), `normative` and `supersedes`. A group is of
    facts about one key of one subject; superseded rows take no part. case is the row of the
    decision table: normative, candidate-only, agreement, override, rule, superset, recency, open.
    """
    for name, kind in (("normative", "boolean"), ("superseded", "boolean"), ("supersedes", "string"), ("list", "array<string>")):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    live = facts.where(~F.coalesce("superseded", F.lit(False)))
    g = settle(_groups(live))
    g = select_rules(g.join(_supersets(live, g), ["subject", "key"], "left"), rules)
    g = g.withColumn("elect", F.coalesce("elect", F.array().cast("array<string>")))
    g = g.withColumn("allowed", F.array_intersect("elect", F.coalesce(F.map_keys("by_class"), F.array().cast("array<string>"))))
    g = g.withColumns({"by_rule": F.expr("try_element_at(by_class, try_element_at(allowed, 1))"), "over": F.expr("try_element_at(by_class, 'REVIEWED_OVERRIDE')")})
    plain = ~F.col("has_normative")
    case = (
        F.when(F.col("gated"), "normative")
        .when((F.col("n_values") == 1) & (F.col("n_firm") == 0), "candidate-only")
        .when(F.col("n_values") == 1, "agreement")
        .when(plain & (F.array_join("elect", ",") == "REVIEWED_OVERRIDE") & (F.col("over.n") == 1), "override")
        .when(plain & (F.size("allowed") == 1) & (F.col("by_rule.n") == 1), "rule")
        .when(plain & F.col("superset_ord").isNotNull(), "superset")
        .when(plain & F.array_contains("elect", "OBSERVED_RUNTIME") & (F.col("n_dated") >= 2), "recency")
        .otherwise("open")
    )
    g = g.withColumn("case", case)
    elected = (
        F.when(F.col("case") == "override", F.col("over.ord")).when(F.col("case") == "rule", F.col("by_rule.ord"))
        .when(F.col("case") == "superset", F.col("superset_ord")).when(F.col("case") == "recency", F.col("newest.ord"))
    )
    basis = F.create_map(*[F.lit(x) for x in ("override", "reviewed-override", "rule", "authority-rule", "superset", "superset", "recency", "recency", "open", "none", "candidate-only", "none")])
    status = F.when(F.col("case") == "override", "accepted").when(F.col("case").isin("rule", "superset", "recency"), "resolved").when(F.col("case").isin("open", "candidate-only"), "unresolved")
    runtime, authored = F.array_contains("all_classes", "OBSERVED_RUNTIME"), F.array_contains("all_classes", "AUTHORED")
    kind = F.when(status.isNull(), None).when(F.col("case") == "candidate-only", "ambiguity").otherwise(_kind(runtime, authored))
    return g.select(
        "subject", "key", "case", elected.alias("elected_ord"), F.try_element_at(basis, F.col("case")).alias("basis"), status.alias("conflict_status"), kind.alias("conflict_kind"),
        "rule_id", "n_rows", "n_values",
    )


def _kind(runtime: Column, authored: Column) -> Column:
    """What a conflict is, by the first that holds."""
    return (
        F.when(F.col("case") == "override", "reviewed-divergence").when(F.col("superseding"), "supersession").when(runtime & authored, "contradiction")
        .when(runtime & (F.size("all_classes") == 1), "staleness").when(F.col("has_candidate"), "ambiguity")
        .when(F.size("all_classes") > 1, "contradiction").otherwise("ambiguity")
    )


def statuses(facts: DataFrame, elections: DataFrame) -> DataFrame:
    """facts with `status`: elected, contradicted, candidate, unresolved or superseded."""
    e = elections.select("subject", "key", "case", "elected_ord")
    j = facts.join(e, ["subject", "key"], "left")
    superseded = F.coalesce(F.col("superseded"), F.lit(False)) if "superseded" in facts.columns else F.lit(False)
    normative = F.coalesce(F.col("normative"), F.lit(False)) if "normative" in facts.columns else F.lit(False)
    status = (
        F.when(superseded, "superseded").when((F.col("case") == "normative") & normative, "unresolved").when(F.col("case") == "agreement", "elected")
        .when(F.col("ord") == F.col("elected_ord"), "elected").when(F.col("confidence") == "candidate", "candidate").otherwise("contradicted")
    )
    return j.withColumn("status", status).drop("case", "elected_ord")


def severity(elections: DataFrame) -> DataFrame:
    """(subject, key, severity) of conflicts: an unresolved one is an error unless it is an ambiguity, a settled one a warning."""
    s = F.when((F.col("conflict_status") == "unresolved") & (F.col("conflict_kind") != "ambiguity"), "error").otherwise("warning")
    return elections.where("conflict_status is not null").select("subject", "key", s.alias("severity"))


def freshness(sets: DataFrame, now: Column) -> DataFrame:
    """(id, age_days, stale) of observation sets (id, captured_at, max_age_days, supersedes) that no other set supersedes."""
    old = sets.select(F.col("supersedes").alias("id")).where("id is not null").distinct()
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("captured_at")) / 86400)
    return sets.join(old, "id", "left_anti").select("id", age.alias("age_days"), (age.isNull() | (age > F.col("max_age_days"))).alias("stale"))


def coverage(sections: DataFrame, citations: DataFrame, attested: DataFrame | None = None) -> DataFrame:
    """(path, section, verdict): cited with the current digest, stale, attested, or uncovered."""
    c = citations.groupBy("path", "section").agg(F.collect_set("sha256").alias("digests"))
    j = sections.join(c, ["path", "section"], "left")
    if attested is not None:
        j = j.join(attested.select("path", "section").distinct().withColumn("attested", F.lit(True)), ["path", "section"], "left")
    else:
        j = j.withColumn("attested", F.lit(None).cast("boolean"))
    verdict = F.when(F.array_contains("digests", F.col("sha256")), "cited").when(F.col("digests").isNotNull(), "stale").when(F.col("attested"), "attested").otherwise("uncovered")
    return j.select("path", "section", verdict.alias("verdict"))


def accept(warnings: DataFrame, acceptances: DataFrame) -> DataFrame:
    """warnings with `accepted`: exactly one warning of its (code, subject), an acceptance with the same refs and current digest."""
    n = F.count("*").over(Window.partitionBy("code", "subject"))
    a = acceptances.select("code", "subject", F.array_sort("refs").alias("a_refs"), F.col("sha256").alias("a_sha")).dropDuplicates(["code", "subject"])
    j = warnings.withColumn("n_", n).join(a, ["code", "subject"], "left")
    ok = (F.col("n_") == 1) & (F.array_sort("refs") == F.col("a_refs")) & (F.col("sha256") == F.col("a_sha"))
    return j.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("n_", "a_refs", "a_sha")


def degrade(elections: DataFrame, facts: DataFrame, rules: DataFrame, stale: DataFrame) -> DataFrame:
    """Settled conflicts whose elected fact was observed in a stale set, and what their rule turns them into."""
    e = elections.where("conflict_status = 'resolved'").join(facts.select("subject", "key", F.col("ord").alias("elected_ord"), "obs_id"), ["subject", "key", "elected_ord"])
    hit = e.join(stale.select(F.col("id").alias("obs_id")).distinct(), "obs_id", "left_semi")
    r = rules.select(F.col("id").alias("rule_id"), "degrade_on_stale")
    return hit.join(r, "rule_id", "left").where("degrade_on_stale is not null").select("subject", "key", "rule_id", F.col("degrade_on_stale").alias("becomes"))


#: Classes of evidence that a rule may elect.
ELECTABLE = ["AUTHORED", "DERIVED", "OBSERVED_RUNTIME", "REVIEWED_OVERRIDE"]


def rule_problems(rules: DataFrame) -> DataFrame:
    """(id, problem) of rules (id, key_pattern, elect): classes that can't be elected, repeated ids, patterns out of balance."""
    odd = F.array_except("elect", F.array(*[F.lit(c) for c in ELECTABLE]))
    classes = rules.select("id", F.explode(odd).alias("c")).select("id", F.concat(F.lit("cannot elect "), "c").alias("problem"))
    again = rules.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    bare = F.regexp_replace(F.regexp_replace("key_pattern", r"\\\\.", ""), r"\[[^\]]*\]", "")
    count = lambda x: F.length(bare) - F.length(F.replace(bare, F.lit(x), F.lit("")))
    broken = rules.where((count("(") != count(")")) | F.contains(bare, F.lit("[")) | bare.rlike(r"^[*+?]|\([*+]")).select("id", F.lit("invalid keyPattern").alias("problem"))
    return classes.unionByName(again).unionByName(broken)


def unverified_requirements(requirements: DataFrame, facts: DataFrame, enabled: list[str]) -> DataFrame:
    """(subject, key, why) of requirements (subject, key, expects, satisfied_by) that no firm fact of their own proves.

    facts: (subject, key, confidence, normative) that are not superseded. The reason is the first that holds.
    """
    own = facts.where(~F.coalesce("normative", F.lit(False))).groupBy("subject", "key").agg(F.bool_or(F.col("confidence") != "candidate").alias("firm"), F.bool_or(F.col("confidence") == "candidate").alias("some"))
    j = requirements.join(own, ["subject", "key"], "left").where(~F.coalesce("firm", F.lit(False)))
    missing = F.array_except("satisfied_by", F.array(*[F.lit(x) for x in enabled]).cast("array<string>"))
    why = (
        F.when(F.coalesce("some", F.lit(False)), "only a heuristic candidate exists").when(F.size("satisfied_by") == 0, "no adapter is named as able to derive it")
        .when(F.size(missing) > 0, F.concat(F.lit("not enabled: "), F.array_join(missing, ", "))).when(F.col("expects").isNull(), "nothing to look for").otherwise("no evidence derived")
    )
    return j.select("subject", "key", why.alias("why"))
