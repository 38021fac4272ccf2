"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs with a digit, values assigned to names such as `token`, and private-key blocks. A forest that
was trained from labelled findings decides on each: its measures are the candidate's length, the transitions between
kinds of characters, how much of it is covered by dictionary words, whether it stands in a path or address, and the
words next to it. The dictionary is the corpus's own: the DICTIONARY_WORDS words that most of its documents hold, counted
over all documents, and a few fixed ones of paths and names. Labelled findings can be passed in; the default ones are
drawn by a seeded rule from that dictionary (see `default_findings`), as the tables hold no labels of this kind.

Defined cases: null and empty texts have no candidates; an empty table gives no rows. Overlapping matches count once: key
blocks first, then assigned values, then what is left of the runs; a run that begins with a name and a sign of assignment
counts from its value. Equal texts get equal findings. Positions are code points. Every candidate is measured whole, in
time that grows with its length; a mark that begins a key block without one that ends it is none. Words of equal counts
go in alphabetical order. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, trim
from .rules import STOP_WORDS

THRESHOLD = 0.5
TREES, DEPTH, BINS, SEED = 40, 8, 24, 11
AROUND = 48  # characters looked at on either side
MARK = "[REDACTED]"

_BEGIN, _END = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_SIGN = re.compile(r"[:=][=>]{0,2}\s{0,3}\\?[\"'`]?")
_VALUE = re.compile(r"(?:(?!&[A-Za-z_][A-Za-z0-9_.\-]*=)[^\s\"'<>]){8,}")
_TO_A_NAME = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)(?:[_-]?(?:key|value))?\\?[\"'`]?\s{0,3}$")
#: A name and a sign in front of a value, as in `sha256:` or `API_TOKEN=`; base64 padding and `://` are none.
_PREFIX = re.compile(r"[A-Za-z_](?:[A-Za-z_.\-]|[0-9]{1,3}(?![0-9])){0,63}+[:=]{1,2}(?![:=/])")
_DIGIT = re.compile("[0-9]")
_REST = re.compile(r"[A-Za-z0-9_\-+/=.:]*")
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.:")
LEAST_RUN = 16
_NAMES = re.compile(r"(?i)secret|token|passw|pwd|api.?key|access.?key|private|credential|auth|bearer")
_HARMLESS = re.compile(r"(?i)commit|sha|md5|digest|hash|checksum|uuid|guid|revision|version|isbn|doi|order|invoice|card|account|phone|example|sample|dummy|placeholder|build|trace|image")
_KNOWN = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|eyJ|glpat-|npm_|SG\.|-----BEGIN)")
_FILLER = re.compile(r"(?i)x{4}|0{6}|12345|abcdef|your|changeme|example|placeholder|<|\$\{|\{\{")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
#: Words taken from the corpus, and the least length of those that count.
DICTIONARY_WORDS, LEAST_WORD = 5000, 4
#: Tasks that put them in order; each sends its first DICTIONARY_WORDS.
ORDERING_TASKS = 8
#: Words that names and paths are made of.
DICTIONARY = sorted({w for w in STOP_WORDS if len(w) > 2} | set("""
user name file path data test main index value server client service config debug error update version release build
order item page image photo article report year month number code key http https www com org net html docs summary
""".split()))
_KIND = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 0), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), **dict.fromkeys("0123456789", 2)}

MEASURES = [
    "length", "distinct_share", "entropy", "digit_share", "upper_share", "hex_share", "sign_share", "change_share", "longest_letters", "longest_digits",
    "covered_share", "known_form", "filler", "uuid", "only_digits", "in_path", "dots", "quoted", "assigned", "secret_word", "harmless_word",
]


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, len(w))
    found.make_automaton()
    return found


def covered_chars(text: str, words: tuple[str, ...]) -> int:
    """Characters of a text in dictionary words: leftmost longest matches, apart from each other."""
    return sum(n for _, n in _automaton(words).iter_long(text.lower()))


def measure(candidate: str, before: str, after: str, words: tuple[str, ...] = tuple(DICTIONARY)) -> list[float]:
    c = candidate
    n = len(c)
    kinds = [_KIND.get(x, 3) for x in c]
    counts = np.unique(list(c), return_counts=True)[1] / n
    covered = covered_chars(c, words)
    runs = [len(x) for x in re.findall(r"[A-Za-z]+", c)] or [0]
    digits = [len(x) for x in re.findall(r"[0-9]+", c)] or [0]
    near = before[-AROUND:]
    return [
        float(np.log1p(len(candidate))), len(counts) / n, float(-(counts * np.log2(counts)).sum()), kinds.count(2) / n, kinds.count(1) / n, sum(x in "0123456789abcdefABCDEF" for x in c) / n, kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, max(runs) / n, max(digits) / n,
        covered / n, bool(_KNOWN.search(c)), bool(_FILLER.search(c)), bool(_UUID.search(c)), c.isdigit(), "://" in c or "://" in near[-12:] or c.count("/") > 2, c.count(".") / n, near[-1:] in "\"'`" and near != "", bool(re.search(r"[:=]>?\s*\\?[\"'`]?$", near)),
        bool(_NAMES.search(near[-24:])), bool(_HARMLESS.search(near[-24:])),
    ]


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at a leaf
    cut: np.ndarray
    value: np.ndarray  # share of secrets at the node

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]))
            total += value[at]
        return total / len(self.feature)


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Forest:
    """A forest of trees on resampled rows; each node looks at a random few of the measures."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cut, value = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1])) for f in range(x.shape[1])]
    few = max(1, int(np.sqrt(x.shape[1])) + 1)
    for t in range(TREES):
        todo = [(0, rng.integers(0, len(y), len(y)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            share = y[rows].mean()
            value[t, at] = share
            if depth == DEPTH or len(rows) < 4 or share in (0, 1):
                continue
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], few, replace=False):
                column = x[rows, f]
                right = column[:, None] > edges[f][None, :]
                n_right = right.sum(0)
                s_right = (right * y[rows][:, None]).sum(0)
                n_left, s_left = len(rows) - n_right, y[rows].sum() - s_right
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n_left > 0) & (n_right > 0), s_left**2 / n_left + s_right**2 / n_right - share**2 * len(rows), 0)
                k = int(np.nanargmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, edges[f][k])
            if best[1] < 0:
                continue
            feature[t, at], cut[t, at] = best[1], best[2]
            on = x[rows, best[1]] > best[2]
            todo += [(2 * at + 1, rows[~on], depth + 1), (2 * at + 2, rows[on], depth + 1)]
    return Forest(feature, cut, value)


def default_findings(n: int = 240, seed: int = SEED, words: tuple[str, ...] = tuple(DICTIONARY)) -> list[tuple[str, str, str, int]]:
    """Labelled findings (candidate, before, after, 1 for a secret): n of each of the forms below, drawn by the seed."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    both, hexa = low + up + dig, dig + "abcdef"
    word = lambda: rng.choice(words)
    prose = lambda: " ".join(word() for _ in range(6)) + " "
    name = lambda: rng.choice(["token", "TOKEN", "secret", "api_key", "password", "access_key", "auth", "client_secret"])
    set_ = lambda: prose() + name() + rng.choice([" = \"", ": ", "=", " = '", ": \"", " = "])
    out = []
    for _ in range(n):
        case = rng.choice([str, str, str.upper])
        out += [
            (case(pick(hexa, rng.choice([32, 40, 48, 64]))), set_(), '" ' + prose(), 1),
            (pick(both, rng.randint(20, 48)), set_(), '" ' + prose(), 1),
            (rng.choice(["AKIA", "ASIA"]) + pick(up + dig, 16), prose(), " " + prose(), 1),
            (rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_"]) + pick(both, 36), prose(), " ", 1),
            ("eyJ" + pick(both, 20) + "." + pick(both, 40) + "." + pick(both, 43), prose() + "Bearer ", " ", 1),
            (pick(both + "!#%&*", rng.randint(10, 16)) + pick(dig, 2), set_(), '"', 1),
            (pick(low, rng.randint(4, 8)) + pick(dig, rng.randint(1, 2)) + pick(low, rng.randint(2, 4)) + pick(dig, 2), set_(), rng.choice(['"', " ", ""]), 1),
            (pick(hexa, rng.choice([32, 40, 64])), prose() + rng.choice(["commit ", "sha256:", "md5 ", "digest ", "checksum: ", "revision "]), " " + prose(), 0),
            ("-".join([pick(hexa, 8), pick(hexa, 4), pick(hexa, 4), pick(hexa, 4), pick(hexa, 12)]), prose() + rng.choice(["uuid ", "id: ", "", "trace "]), " ", 0),
            (pick(dig, rng.choice([16, 16, 18, 20])), prose() + rng.choice(["", "", "card ", "order ", "account "]), " " + prose(), 0),
            ("/".join([word(), word(), word(), word() + pick(dig, 2)]) + ".html", prose() + rng.choice(["https://", "", "/"]), " ", 0),
            ("".join(word() for _ in range(4)) + pick(dig, rng.randint(1, 3)), prose(), " " + prose(), 0),
            ("-".join(word() for _ in range(4)) + "-" + pick(dig, 4), prose(), " ", 0),
            (rng.choice(["xxxxxxxx", "your", "changeme", "example", "000000000"]) + "".join([rng.choice(["_token_here", "-secret-1", "xxxxxxxx1"])]), set_(), '" ', 0),
            ("-".join([f"20{pick('012', 2)}", "0" + pick("123456789", 1), pick("12", 2) + "T" + pick("012", 2) + ":" + pick("012345", 2)]) + ":" + pick("012345", 2), prose(), " ", 0),
            ("".join(word() for _ in range(3)), set_(), '" ', 0),
            (".".join(pick(dig, rng.randint(1, 3)) for _ in range(6)) + "-" + word() + pick(dig, 2), prose() + rng.choice(["version ", "build ", ""]), " ", 0),
        ]
    return out


def train(findings: list[tuple[str, str, str, int]] | None = None, words: tuple[str, ...] = tuple(DICTIONARY)) -> Forest:
    found = findings if findings is not None else default_findings(words=words)
    return fit(np.array([measure(*f[:3], words) for f in found], np.float64), np.array([f[3] for f in found], np.float64))


@cache
def default_forest(words: tuple[str, ...] = tuple(DICTIONARY)) -> Forest:
    return train(words=words)


def dictionary_of(docs: DataFrame, text: str = "text", most: int = DICTIONARY_WORDS) -> tuple[str, ...]:
    """The words of letters that most documents hold (so many at most), and the fixed ones."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![\p{L}\p{N}_])(\p{L}{" + str(LEAST_WORD) + r",12})(?![\p{L}\p{N}_])"), F.lit(1)))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.repartition(ORDERING_TASKS).orderBy(F.col("n").desc(), "word").limit(most)  # a feature: the dictionary has a fixed size
    return tuple(sorted({r.word for r in top.collect()} | set(DICTIONARY)))


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of all candidates of a text, in order and apart from each other."""
    if not text:
        return []
    found = _blocks(text)
    if ":" in text or "=" in text:
        found = _without(_assigned(text), found) + found
    taken, runs = sorted(found), []
    digit = _DIGIT.search(text)
    while digit:  # runs with a digit, each grown to both sides
        start, end = digit.start(), _REST.match(text, digit.start()).end()
        while start and text[start - 1] in _RUN:
            start -= 1
        if end - start >= LEAST_RUN:
            runs.append((start, end))
        digit = _DIGIT.search(text, end)
    return sorted(taken + [_value_of(text, a, b) for a, b in _rest(runs, taken) if _is_run(text, a, b)])


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans of private-key blocks: a mark that begins one, to the next mark that ends one."""
    out, at = [], 0
    while "-----BEGIN" in text and (begin := _BEGIN.search(text, at)) and (end := _END.search(text, begin.end())):
        out.append((begin.start(), end.end()))
        at = end.end()
    return out


def _is_run(text: str, start: int, end: int) -> bool:
    return end - start >= LEAST_RUN and _DIGIT.search(text, start, end) is not None


def _value_of(text: str, start: int, end: int) -> tuple[int, int]:
    """The run without the names in front of its value, as long as the value is a run by itself."""
    while (m := _PREFIX.match(text, start, end)) and not _KNOWN.match(text[start : m.end()]) and _is_run(text, m.end(), end):
        start = m.end()
    return start, end


def _assigned(text: str) -> list[tuple[int, int]]:
    """Values assigned to names, in order and apart; of `auth: token=x` the inner value, else the outer one."""
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        if not _TO_A_NAME.search(text, max(0, m.start() - 32), m.start()) or not (v := _VALUE.match(text, m.end())):
            continue
        if out and v.start() < out[-1][1]:
            if not re.fullmatch(r"[A-Za-z_.\-]+\\?[:=][=>]{0,2}", text[out[-1][0] : v.start()]):
                continue
            out.pop()
        out.append(v.span())
    return out


def _without(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet none of those taken."""
    if not taken:
        return spans
    starts = [a for a, _ in taken]
    return [(a, b) for a, b in spans if not ((i := bisect_left(starts, b)) and taken[i - 1][1] > a)]


def _rest(runs: list[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of the runs around the spans taken; both are in order and apart."""
    i = 0
    for a, b in runs:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        j = i
        while j < len(taken) and taken[j][0] < b:
            if taken[j][0] > a:
                yield a, taken[j][0]
            a, j = max(a, taken[j][1]), j + 1
        if a < b:
            yield a, b


def scan(docs: DataFrame, text: str = "text", forest: Forest | None = None, into: str = "found", words: tuple[str, ...] | None = None) -> DataFrame:
    """docs with a struct: n_candidates, starts, ends and scores of the secrets, and the text without them.

    A forest that is passed in must have been trained with the words that are passed in.
    """
    small_batches(docs.sparkSession)
    words = words or (tuple(DICTIONARY) if forest else dictionary_of(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast((forest or default_forest(words), words))

    @F.pandas_udf("n_candidates int, starts array<int>, ends array<int>, scores array<double>, redacted string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forest_, words_ = shared.value
        for batch in texts:
            ts = batch.tolist()
            spans = [candidates(t) for t in ts]
            x = [measure(t[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND], words_) for t, some in zip(ts, spans, strict=True) for a, b in some]
            scores = forest_.score(np.array(x, np.float64)) if x else np.zeros(0)
            rows, k = [], 0
            for t, some in zip(ts, spans, strict=True):
                hits = [(a, b, float(s)) for (a, b), s in zip(some, scores[k : k + len(some)], strict=True) if s >= THRESHOLD]
                k += len(some)
                parts, at = [], 0
                for a, b, _ in hits:
                    parts += [t[at:a], MARK]
                    at = b
                rows.append((len(some), [h[0] for h in hits], [h[1] for h in hits], [h[2] for h in hits], "".join([*parts, t[at:]]) if hits else t))
            yield pd.DataFrame(rows, columns=["n_candidates", "starts", "ends", "scores", "redacted"])
        trim()

    return docs.withColumn(into, run(F.col(text)))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, starts, ends, top_score, redacted_sha256 of every document."""
    found = scan(docs.select("doc_id", "text"), into="f_")
    return found.select(
        "doc_id", "f_.n_candidates", F.size("f_.starts").alias("n_secrets"), "f_.starts", "f_.ends",
        F.array_max("f_.scores").alias("top_score"), F.sha2(F.coalesce("f_.redacted", F.lit("")), 256).alias("redacted_sha256"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret of the text replaced by a mark; n_chars, where there, follows the text."""
    name = free_name(docs, "scanned")
    found = scan(docs, text, into=name)
    changed = F.size(F.col(name)["starts"]) > 0
    out = {text: F.col(name)["redacted"]}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.char_length(F.col(name)["redacted"]).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return found.withColumns(out).select(*docs.columns)
