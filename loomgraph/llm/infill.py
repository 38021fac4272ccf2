"""Fill-in-middle transformation: texts cut into prefix, middle and suffix and put together anew.

Cuts are drawn in code points, texts are UTF-8 bytes. Of a batch of texts only the places of multibyte characters and
their bytes beyond the first are recorded; a binary search in that sparse index turns a code point into a byte and back,
and where all is ASCII nothing is recorded and the two are the same number. So no text is decoded.

The draws depend on doc_id alone (sha256 of `1:` and the id), so that reruns and lost tasks give the same rows.

Defined cases: a null text counts as empty. Empty texts and texts that hold one of the marks stay as they are (`plain`).
A null doc_id counts as the empty text in the draw; rows of one doc_id are cut at the same draws, each by its own length,
and repeated rows give repeated results. A very long text is held whole by one task, one text at a time. A doc_id of any
simple type is kept as it is and drawn by its text form. Extra columns are left alone, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import small_batches, trim

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many stay plain, and of a hundred others so many begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20

_DRAW = np.dtype([("h", ">u4", 4), ("rest", "V16")])


class Exceptions:
    """The sparse index over some texts in one buffer: places of multibyte characters and their excess bytes."""

    def __init__(self, data: np.ndarray):
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes_at]
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))))
        self.points_at = self.bytes_at - self.excess[:-1]

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before these bytes, which begin characters."""
        return at - self.excess[np.searchsorted(self.bytes_at, at)]

    def bytes(self, points: np.ndarray) -> np.ndarray:
        """Bytes before these code points."""
        return points + self.excess[np.searchsorted(self.points_at, points)]


def draws(doc_ids: list) -> np.ndarray:
    """Four numbers of 32 bits for each id."""
    raw = b"".join(sha256(b"1:" + (b"" if i is None else str(i).encode())).digest() for i in doc_ids)
    return np.frombuffer(raw, _DRAW)["h"].astype(np.int64)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each in them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def cuts(data: np.ndarray, bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code points of each text, of its prefix and of its prefix and middle, and the bytes where those two end."""
    index = Exceptions(data)
    before = index.points(bounds)
    n = np.diff(before)
    drawn = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = index.bytes(before[:-1, None] + drawn)
    return n, drawn[:, 0], drawn[:, 1], at[:, 0], at[:, 1]


def transform(docs: DataFrame, text: str = "text", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output of every text."""
    small_batches(docs.sparkSession)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = draws(batch.column(0).to_pylist())
            data, bounds = buffer(batch.column(2))
            n, first, second, cut, end = cuts(data, bounds, h)
            whole, form, out = data.tobytes(), [], []
            for i, (a, b, c, d) in enumerate(zip(bounds[:-1].tolist(), cut.tolist(), end.tolist(), bounds[1:].tolist(), strict=True)):
                t = whole[a:d]
                if a == d or h[i, 2] % 100 >= 100 - plain or any(x in t for x in marks):
                    form.append("plain")
                    out.append(t)
                elif h[i, 3] % 100 < suffix_first:
                    form.append("spm")
                    out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
                else:
                    form.append("psm")
                    out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
            forms = pa.array(form, pa.string())
            free = np.array([f == "plain" for f in form], dtype=bool)
            columns = [
                batch.column(1), pa.array(n, pa.int64()), forms, pa.array(first, pa.int64(), mask=free),
                pa.array(second - first, pa.int64(), mask=free), pa.array(out, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        trim()

    kept = docs.schema["doc_id"]
    schema = StructType([
        StructField("doc_id", kept.dataType), StructField("n", LongType()), StructField("form", StringType()),
        StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType()),
    ])
    drawn_by = F.col("doc_id") if isinstance(kept.dataType, (IntegerType, LongType)) else F.col("doc_id").cast("string")
    return docs.select(drawn_by.alias("drawn_by"), F.col("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that gave this output in this form. No part holds a mark, so each mark is found where it was put."""
    after_prefix = F.substring_index(output, PREFIX, -1)
    after_suffix = F.substring_index(output, SUFFIX, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(after_prefix, SUFFIX, 1), middle, F.substring_index(after_suffix, MIDDLE, 1))
    spm = F.concat(F.substring_index(after_prefix, MIDDLE, 1), middle, F.substring_index(after_suffix, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """The transformation with digests in place of texts: of the output, and of the text rebuilt from it."""
    return transform(docs, text).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """DuckDB SQL of the same rows."""
    return """with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
      g as (select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as b, ('0x' || substr(h, 17, 8))::bigint % 100 as c, ('0x' || substr(h, 25, 8))::bigint % 100 as e from d),
      k as (select *, least(a, b) as x, greatest(a, b) as y, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when e < 20 then 'spm' else 'psm' end as form from g),
      o as (select *, substring(t, 1, x) as pre, substring(t, x + 1, y - x) as mid, substring(t, y + 1, n - y) as suf from k)
      select doc_id, n, form, case when form <> 'plain' then x end as prefix_chars, case when form <> 'plain' then y - x end as middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
        sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256 from o"""
