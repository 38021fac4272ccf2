"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training takes about TRAIN_DOCS labelled texts of each language, drawn by the hash of their id, counts their hashed
n-grams, sums the counts by language and bucket, and turns them into smoothed log probabilities. Priors count every
labelled row, not the sample. The matrix (languages x buckets) is broadcast; its size depends on the number of languages
only. Scoring treats a batch of texts as a sparse matrix in compressed rows (bounds of each text, bucket of each n-gram)
times the dense matrix; a very long text is summed up slice by slice.

Defined cases: a null text and a text without a letter (a character that is alphabetic in Unicode) are `und` with score
0, before any model is asked; if no labelled text exists, as in an empty table, every text is. A null language is not
learned from. Equal texts get equal results; equal likelihoods go to the language that sorts first. Extra columns are
left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, fold, free_name, mix, release, slices, small_batches, stored, trim

#: Labelled texts to learn each language from, about; all of them where there are fewer. Scores are of every text.
TRAIN_DOCS = 4000
#: Tasks that count the n-grams of that sample.
TASKS = 16
#: Buckets of hashed n-grams.
BUCKETS = 1 << 15
#: Lengths of the n-grams; a run of characters that aren't letters counts as one space.
ORDERS = (2, 3)
#: Characters of texts that are looked at at once.
SLICE = 500_000
#: Added to each count.
SMOOTHING = 0.5
#: The pipeline rejects documents of `und` and those whose best language is less likely than this.
LEAST_SCORE = 0.5
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def plain(text: str) -> str:
    """The text in lower case, each run of characters that aren't letters as one space, and one space around."""
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the runs of n of the codes."""
    h = codes[: max(0, len(codes) - n + 1)].copy()
    for j in range(1, n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + codes[j : len(codes) - n + 1 + j]
    return ((h * GOLD) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _codes(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + GOLD)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the bounds of each text in them."""
    bodies = [plain(t) for t in texts]
    codes = _codes("".join(bodies))
    lengths = np.array([len(p) for p in bodies])
    starts = np.cumsum(lengths) - lengths
    # n-grams in rows of one text after another: those that would reach into the next text are left out
    counts = [np.maximum(lengths - n + 1, 0) for n in ORDERS]
    bounds = np.concatenate(([0], np.cumsum(sum(counts))))
    out = np.empty(bounds[-1], np.int32)
    at = bounds[:-1].copy()
    for n, count in zip(ORDERS, counts, strict=True):
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(at, count) + offset] = _hashed(codes, n)[np.repeat(starts, count) + offset]
        at += count
    return out, bounds


def slice_grams(text: str, chars: int = 0) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of one text, a slice after the other."""
    body, chars = plain(text), chars or SLICE
    for start in range(0, len(body), chars):
        codes = _codes(body[start : start + chars + max(ORDERS) - 1])
        yield np.concatenate([_hashed(codes, n)[:chars] for n in ORDERS])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        best = [UNDETERMINED] * len(texts)
        score = np.zeros(len(texts))
        asked = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for start, stop in slices([texts[i] for i in asked], SLICE):
            some = asked[start:stop]
            if len(texts[some[0]]) > SLICE and len(some) == 1:
                sums = sum(self.log_probability[x].sum(axis=0, dtype=np.float64) for x in slice_grams(texts[some[0]]))[None, :] + self.log_prior
            else:
                buckets, bounds = grams([texts[i] for i in some])
                sums = np.add.reduceat(self.log_probability[buckets], bounds[:-1], axis=0, dtype=np.float64) + self.log_prior
            sums -= sums.max(axis=1, keepdims=True)
            likely = np.exp(sums)
            likely /= likely.sum(axis=1, keepdims=True)
            top = likely.argmax(axis=1)
            for i, k, row in zip(some, top, likely, strict=True):
                best[i], score[i] = self.languages[k], row[k]
        return best, score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_each: int = TRAIN_DOCS) -> Model:
    """A model of about docs_each rows a language of those rows (doc_id, text, lang) that have a text and a language."""
    small_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(texts, SLICE):
                by: dict[str, list[str]] = {}
                for t, lang_ in zip(texts[start:stop], langs[start:stop], strict=True):
                    by.setdefault(lang_, []).append(t)
                for lang_, some in by.items():
                    table = tables.setdefault(lang_, np.zeros(BUCKETS, np.int64))
                    for t in some:
                        for x in slice_grams(t) if len(t) > SLICE else []:
                            table += np.bincount(x, minlength=BUCKETS)
                    if short := [t for t in some if len(t) <= SLICE]:
                        table += np.bincount(grams(short)[0], minlength=BUCKETS)
        for lang_, table in tables.items():
            at = np.flatnonzero(table)
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(some)), pa.array(some, pa.int32()), pa.array(table[some], pa.int64())], ["lang", "bucket", "n"])

    rows = labelled.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    share = stored(rows.groupBy("lang").agg(F.count("*").alias("labelled"), (F.lit(float(docs_each)) / F.count("*")).alias("share")))  # one row a language
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(F.broadcast(share), "lang").where(drawn < F.col("share")).select("text", "lang").repartition(TASKS)  # bounded by docs_each
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # languages x buckets rows at most
    labels = {r.lang: r.labelled for r in share.collect()}
    release(share)
    languages = sorted(labels)
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"], found["lang"].map({x: i for i, x in enumerate(languages)})] = found["n"]
    smooth = counts + SMOOTHING
    prior = np.array([labels[x] + 1.0 for x in languages])
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text"):
    """Column with lang_pred and score of the text column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            best, score = shared.value.score(batch.tolist())
            yield pd.DataFrame({"lang_pred": best, "score": score})
        trim()

    return run(F.col(text))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language can't be told; the columns stay as they are."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    name = free_name(docs, "identified")
    found = docs.withColumn(name, predict(docs, model))
    return found.where((F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= LEAST_SCORE)).drop(name)
