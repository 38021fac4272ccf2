"""SentencePiece encoding and decoding (merge-type models with byte fallback).

The encoder finds the one token sequence that merging would give, without merging the text: an Aho-Corasick automaton
lists the vocabulary pieces at each position, the longest is tried first, a token may follow another only if merging
the two texts together gives back just these two tokens, and a bit for each position that led nowhere keeps the
search linear. Texts are cut where no piece of the vocabulary can reach across; the cut parts are encoded once and kept
in a bounded store of each worker.

Defined cases: a null text is encoded as the empty text (the end id only). Characters that no piece has become their
UTF-8 bytes. Repeated rows give repeated results. Of equal scores the leftmost merge comes first, as in the library. A
very long text is cut where no piece can reach across, and its parts are encoded one after the other. Other columns are
left alone, but for one of the name that the result is to have, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from struct import pack
from typing import Any

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space inside pieces.
MARK = "▁"
#: A character class of Latin letters.
LATIN = "A-Za-z\u00c0-\u024f"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pieces:
    """Encoder and decoder over the vocabulary of one model file."""

    STORE = 150_000  # parts kept at once
    PAIRS = 200_000  # checked pairs kept at once
    LONG = 64  # longer parts are not kept

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.bytes = {int(self.text[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spaced = [t.replace(MARK, " ") for t in self.text]
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.special = {*self.byte_of, *self.silent, self.unknown}
        self.end = model.eos_id()
        # as the model file says for every text: one mark is put before a text that isn't empty
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        letters = set("".join(self.id))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece reaches over the start of a word")
        # no piece reaches over a mark after another character, nor holds a line end, nor reaches from a Latin letter to
        # one of these signs: texts can be cut there
        apart = [c for c in "!\"#$%&()*+,./:;<=>?@[]^{|}~" if not any(re.search(f"[{LATIN}]{re.escape(c)}", p) for p in self.id)]
        words = f"[ ▁]*[{LATIN}]++(?=[{re.escape(''.join(apart))}])|" if apart else ""
        self.cut = re.compile("\n+|" + words + "[ ▁]*[^ ▁\n]+|[ ▁]+" if "\n" not in letters else words + "[ ▁]*[^ ▁]+|[ ▁]+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.store: dict[str, tuple[str, str]] = _Store(self, lambda ids: (" ".join(map(str, ids)), self.decode(ids, first=False)))
        self.packed: dict[str, bytes] = _Store(self, lambda ids: pack(f"<{len(ids)}H", *ids))

    # -- merging, for the checks of single tokens and of pairs

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text by score, leftmost first among equals."""
        score, part = self.score, list(text)
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap: list = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (s := score.get(part[left] + part[right])) is not None:
                heapq.heappush(heap, (-s, left, right, part[left], part[right]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, a, b = heapq.heappop(heap)
            if part[left] != a or part[right] != b or after[left] != right:
                continue
            part[left], part[right] = a + b, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in part if p]

    def reached(self, token: int) -> bool:
        """Whether merging the token's own text gives the token."""
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = len(self.merge(self.text[token])) == 1
        return known

    def compatible(self, left: int, right: int) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            a, b = self.text[left], self.text[right]
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.reached(left) and self.reached(right) and self.merge(a + b) == [a, b]
        return known

    # -- backtracking over one part

    def tokens(self, part: str) -> list[int]:
        """Token ids of a part (marks, not spaces); characters without a piece become bytes."""
        if (out := self._straight(part)) is not None:
            return out
        out = []
        starts: list[list[tuple[int, int]]] = [[] for _ in part]
        for last, match in self.automaton.iter(part):
            starts[last - match[0] + 1].append(match)  # shorter ones first, as they end first
        at = 0
        while at < len(part):
            if not starts[at]:
                out += self._bytes(part[at])
                at += 1
                continue
            stop = at
            while stop < len(part) and starts[stop]:
                stop += 1
            # only a character that no piece holds has no match at its own place
            out += self._search(starts, at, stop)
            at = stop
        return out

    def _straight(self, part: str) -> list[int] | None:
        """The longest match at each place, if these follow each other without a gap and all are compatible."""
        out, at, last = [], 0, -1
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter_long(part):
            if end - length + 1 != at:
                return None
            if last < 0:
                if not self.reached(token):
                    return None
            elif not (known if (known := pairs.get((last, token))) is not None else self.compatible(last, token)):
                return None
            out.append(token)
            at, last = end + 1, token
        return out if at == len(part) else None

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _search(self, starts: list[list[tuple[int, int]]], first: int, stop: int) -> list[int]:
        open_ = (1 << (stop - first + 1)) - 1 if stop - first < 4096 else None
        failed = bytearray(stop - first + 1) if open_ is None else None  # one byte a position for very long parts
        path: list[tuple[int, int]] = []  # token, which match at its start
        at, which = first, len(starts[first]) - 1
        while at < stop:
            matches, found = starts[at], False
            last = path[-1][0] if path else -1
            while which >= 0:
                length, token = matches[which]
                end = at + length
                free = end <= stop and ((open_ >> (end - first)) & 1 if open_ is not None else not failed[end - first])
                if free and (self.compatible(last, token) if path else self.reached(token)):
                    found = True
                    break
                which -= 1
            if found:
                path.append((token, which))
                at = end
                which = len(starts[at]) - 1 if at < stop else 0
            else:
                if open_ is not None:
                    open_ &= ~(1 << (at - first))
                else:
                    failed[at - first] = 1
                if not path:
                    raise ValueError("no encoding")
                token, which = path.pop()
                at -= len(self.text[token])
                which -= 1
        return [token for token, _ in path]

    # -- whole texts

    def parts(self, text: str | None) -> list[str]:
        return self.cut.findall(" " + text) if text else []

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        out: list[int] = []
        for p in self.parts(text):
            out += self.tokens(p.replace(" ", MARK))
        return [*out, self.end] if end else out

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; first: drop the space that was put before the text."""
        special, spaced = self.special, self.spaced
        if special.isdisjoint(ids):
            text = "".join([spaced[i] for i in ids])
            return text[1:] if first and text[:1] == " " else text
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_readable(held))
                held = bytearray()
            if i not in self.silent:
                piece = " ⁇ " if i == self.unknown else spaced[i]
                out.append(piece[1:] if first and not out and i != self.unknown and piece[0] == " " else piece)
        if held:
            out.append(_readable(held))
        return "".join(out)

    def binary(self, text: str | None) -> bytes:
        """Ids of a text without an end id, two little-endian bytes each (vocabularies of up to 65,536)."""
        return b"".join(map(self.packed.__getitem__, self.parts(text)))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, digest of the ids, digest of what they decode to."""
        found = list(map(self.store.__getitem__, self.parts(text)))
        ids = " ".join([*(f[0] for f in found), str(self.end)])
        decoded = "".join([f[1] for f in found])[1:]
        sha = hashlib.sha256
        return ids.count(" ") + 1, sha(ids.encode()).hexdigest(), sha(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def _readable(held: bytearray) -> str:
    """UTF-8 text of bytes; each byte that is not part of a character becomes one replacement character."""
    out, at = [], 0
    while at < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(held[at : at + n]).decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


class _Store(dict):
    """What was made of the ids of encoded parts, up to Pieces.STORE of them."""

    def __init__(self, pieces: Pieces, make: Callable[[list[int]], Any]):
        self.pieces, self.make = pieces, make

    def __missing__(self, part: str) -> Any:
        p = self.pieces
        found = self.make(p.tokens(part.replace(" ", MARK)))
        if len(part) <= p.LONG:
            if len(self) >= p.STORE:
                self.clear()
            self[part] = found
        return found


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One encoder for each model and worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_udf(model: str):
    """Column function: text to array of ids, end id last."""

    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(model)
        end = pack("<H", p.end)
        for batch in texts:
            parts = [p.binary(t.as_py()) + end for t in batch]
            flat = np.frombuffer(b"".join(parts), "<u2").astype(np.int32)
            bounds = np.concatenate(([0], np.cumsum([len(x) // 2 for x in parts]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
        trim()

    return run


def decode_udf(model: str):
    """Column function: array of ids to text."""

    @F.pandas_udf("string")
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = pieces(model)
        for batch in ids:
            yield pd.Series([None if x is None else p.decode(list(x)) for x in batch], dtype=object)

    return run


def digests_udf(model: str):
    """Column function: text to (n_tokens, ids_sha256, decoded_sha256)."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for batch in texts:
            yield pd.DataFrame([p.digests(t) for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    return run


def encode(docs: DataFrame, text: str = "text", into: str = "ids", model: str | None = None) -> DataFrame:
    """docs with the ids of the text column (end id last)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, encode_udf(model or default_model())(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", model: str | None = None) -> DataFrame:
    """docs with the text of an ids column; null ids give null."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, decode_udf(model or default_model())(F.col(ids)))


def digests(docs: DataFrame, text: Column | str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", digests_udf(model or default_model())(F.col(text) if isinstance(text, str) else text).alias("found"))
    return found.select("doc_id", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")
