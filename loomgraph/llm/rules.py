"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The table names measures of a text (length, symbols, stop words, lines) with the least and the most that a kept
document may have; `compile_rules` turns it into a boolean column. All measures are built-in expressions within the
row, so that the plan is one scan and one projection, without a shuffle.

Defined cases: a null or empty text has no words, fails the base rule and isn't kept. Ties and repeated rows get equal
results; other columns of the input are not looked at, whatever their names. A very long text is one row: its words are
one array, and windows of words are compared by their sorted hashes. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Common words of four languages.
STOP_WORDS = """
the of and to in is that for it as was with be by on not he this are or at from which
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als
le la les de et des en un une du que est pour qui dans par au sur avec pas
el la los las de y en que un una por con para es del se al lo como más
""".split()

#: measure, least, most (None: no bound). Ratios are of words unless named otherwise.
THRESHOLDS = [
    ("n_words", 10, 100_000),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.3),
    ("stop_word_share", 0.03, None),
    ("shouted_share", None, 0.6),
    ("dup_line_share", None, 0.5),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.3),
    ("repeat_word_share", None, 0.2),
]
WINDOW = 5


def _let(value: Column, body) -> Column:
    """body of a lambda variable, so that value is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(ws: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of size words that is found twice or more in the list."""
    none = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        # windows in order of (hash, place): those that equal a neighbour are repeated
        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            # each window adds what it reaches beyond the one before
            steps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(size)))
            return F.aggregate(steps, F.lit(size).cast("long"), lambda acc, x: acc + x)

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_let(ordered, lambda s: _let(places(s), total)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))

    return F.when(F.size(ws) <= size, none).otherwise(_let(windows(ws), covered))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and all measures of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select("doc_id", body.alias("body"), words(body).alias("ws"), F.array_compact(F.transform(F.split(body, "\n"), lambda x: F.when(F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")), x))).alias("lines"))
    n, lines = F.size("ws").cast("long"), F.size("lines").cast("long")
    any_words, any_lines = F.greatest(n, F.lit(1)), F.greatest(lines, F.lit(1))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    step = step.select(
        "doc_id",
        n.alias("n_words"),
        lines.alias("n_lines"),
        F.char_length(F.regexp_replace("body", r"[\x20\x09-\x0D]", "")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
        (F.size(F.filter("ws", lambda w: F.lower(w).isin(list(dict.fromkeys(STOP_WORDS))))) / any_words).alias("stop_word_share"),
        (F.size(F.filter("ws", lambda w: (F.upper(w) == w) & (F.lower(w) != w))) / any_words).alias("shouted_share"),
        (F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))) / any_lines).alias("bullet_line_share"),
        (F.size(F.filter("lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))) / any_lines).alias("ellipsis_line_share"),
    )
    any_words, any_lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return step.withColumns({
        "mean_word_chars": F.col("word_chars") / any_words,
        "symbols_per_word": F.col("n_symbols") / any_words,
        "dup_line_share": F.col("n_dup_lines") / any_lines,
        "repeat_word_share": F.col("n_repeat_words") / any_words,
    })


def compile_rules(table=THRESHOLDS) -> Column:
    """True where every measure is within its bounds."""
    verdict = F.lit(True)
    for name, least, most in table:
        if least is not None:
            verdict = verdict & (F.col(name) >= F.lit(least))
        if most is not None:
            verdict = verdict & (F.col(name) <= F.lit(most))
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, table=THRESHOLDS) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed and kept of every document."""
    found = measures(docs).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & compile_rules(table)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def oracle(table=THRESHOLDS) -> str:
    """DuckDB SQL with the rows of judge() over documents."""
    stop = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    bounds = [f"{m} >= {lo}" for m, lo, _ in table if lo is not None] + [f"{m} <= {hi}" for m, _, hi in table if hi is not None]
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
w as (select r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as h from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from s where len(ws) >= {WINDOW})),
rep as (select r, i from (select r, i, count(*) over (partition by r, h) as n from w) where n > 1),
cov as (select r, count(*) as n from (select distinct r, i + unnest(range(0, {WINDOW})) as p from rep) group by r),
m as (select doc_id, len(ws)::bigint as n_words, len(lines)::bigint as n_lines,
    length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(cov.n, 0)::bigint as n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) in ({stop})))::double as stops,
    len(list_filter(ws, lambda x: upper(x) = x and lower(x) <> x))::double as shouted,
    len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]')))::double as bullets,
    len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$')))::double as ellipses
    from s left join cov using (r)),
k as (select *, stops / greatest(n_words, 1) as stop_word_share, shouted / greatest(n_words, 1) as shouted_share,
    bullets / greatest(n_lines, 1) as bullet_line_share, ellipses / greatest(n_lines, 1) as ellipsis_line_share,
    word_chars::double / greatest(n_words, 1) as mean_word_chars, n_symbols::double / greatest(n_words, 1) as symbols_per_word,
    n_dup_lines::double / greatest(n_lines, 1) as dup_line_share, n_repeat_words::double / greatest(n_words, 1) as repeat_word_share,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and {" and ".join(bounds)} as kept from k"""
