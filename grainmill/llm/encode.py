"""Exact byte-pair ids of whole texts by dynamic programming over prefixes.

Every prefix of a piece has exactly one last token in its encoding: the suffix match whose
pair with the last token of the prefix before it is compatible. An automaton over the
vocabulary gives all suffix matches, the last token of each prefix is stored, and the ids are
read off by following the back-pointers. The work is linear in the length, so a run of a
hundred thousand letters without space costs no more than as many words.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every node; the file is read, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The split into pieces that the vocabulary was made with (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces kept per worker; beyond that the memory starts anew.
KEPT = 400_000
_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> packed ids, filled as pieces come."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        got = array("i", self.encode(piece)).tobytes()
        if len(piece) < 64:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """Encodes texts with one vocabulary; pieces seen before are looked up."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, vocab = _byte_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.raw = {w: bytes(letter[c] for c in w) for w in vocab if w not in special}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        self.known: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        for w, b in self.raw.items():
            i = vocab[w]
            self.bytes_of[i], self.known[b] = b, i
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.joined: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (vocab[a], vocab[b])
            self.joined[pair] = halves[vocab[a + b]] = vocab[a + b]
            halves[vocab[a + b]] = pair
        # the tokens that touch a token's right and left edge while it is built up
        self.right, self.left = [()] * len(self.bytes_of), [()] * len(self.bytes_of)
        for i in sorted(vocab[w] for w in self.raw):
            a, b = halves.get(i, (None, None))
            self.right[i] = (*self.right[b], i) if b is not None else (i,)
            self.left[i] = (*self.left[a], i) if a is not None else (i,)
        del self.raw
        self.split = regex.compile(PIECES).findall
        self.fits = lru_cache(maxsize=1 << 18)(self._fits)
        self.cache = _Pieces(self.piece)

    def _fits(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border between tokens a and b.

        Each edge token lives until it is merged away inside its own token; a merge across
        the border spoils the pair if it comes first. Equal ranks merge from the left.
        """
        x, y = self.right[a], self.left[b]
        i = j = 0
        while True:
            ends_x = x[i + 1] if i + 1 < len(x) else _NEVER
            ends_y = y[j + 1] if j + 1 < len(y) else _NEVER
            crossing = self.joined.get((x[i], y[j]))
            if crossing is not None and crossing < ends_x and crossing <= ends_y:
                return False
            if ends_x == ends_y == _NEVER:
                return True
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece."""
        data = text.encode("utf-8", "surrogatepass")
        if data in self.known:
            return (self.known[data],)
        last, size, fits = [0] * (len(data) + 1), [0] * (len(data) + 1), self.fits
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            at = end + 1
            # of the suffix matches of a prefix exactly one agrees with what stands before it
            if not size[at] and (n == at or (size[at - n] and fits(last[at - n], token))):
                last[at], size[at] = token, n
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(out[::-1])

    def pieces(self, text: str) -> list[bytes]:
        """The ids of each piece of a text, packed as native 32-bit integers."""
        return list(map(self.cache.__getitem__, self.split(text)))

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, packed; empty for an empty or a null one."""
        return b"".join(map(self.cache.__getitem__, self.split(text))) if text else b""

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or a null one."""
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def count(self, text: str | None) -> int:
        """How many ids a text has."""
        return len(self.packed(text)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of this process."""
    return Encoder(path)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row per row of the table, repeated rows included.

    An empty or a null text has an empty list. Special tokens are ordinary text. Columns other
    than key and text are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col(key).alias("gm_key"), F.col(text).alias("gm_text"))
    kind = rows.schema["gm_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc.packed(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["gm_key", "ids"])

    return rows.mapInArrow(run, f"gm_key {kind}, ids array<int>").withColumnRenamed("gm_key", key)


def token_count(path: str = VOCABULARY):
    """A pandas UDF: the number of ids of each text, 0 for an empty or a null one."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in texts:
            yield pd.Series([enc.count(t) for t in s], dtype="int64")

    return count
