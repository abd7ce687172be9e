"""Content-defined pieces of oversized texts.

Landmarks are places where a rolling hash over the last few tokens has its low bits zero; they
depend on the tokens around them only, so an edit moves the cuts of its neighborhood and the
rest fall where they fell before. Each landmark snaps to the nearest natural boundary
(paragraph, line, sentence, then clause, then word) between the least and the largest size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.encode import VOCABULARY, Encoder, encoder
from grainmill.runtime import broadcast_if_few

#: Tokens that the rolling hash looks back on.
WINDOW = 12
#: The least piece as a share of the room for new tokens.
LEAST = 0.25
#: Most tokens of one letter, which is never split; so no limit below that can be kept.
LETTER = 4
#: A part of fewer pieces is counted as a whole.
NEAR = 16
_ENDS = regex.compile(r"[.!?…。！？][\"'”’)\]]*$")
_CLAUSE = regex.compile(r"[,;:–—][\"'”’)\]]*$")
PIECE = "piece int, start_token bigint, end_token bigint, n_tokens bigint, shared_tokens bigint, text string"


class _Shapes(dict):
    """Piece -> how it pauses: 16 * its own line break level + 4 * its end + whether it starts with space."""

    def __missing__(self, p: str) -> int:
        lines = 0
        if "\n" in p or "\r" in p:
            lines = 4 if max(p.count("\n"), p.count("\r")) > 1 else 3
        end = 2 if _ENDS.search(p) else 1 if _CLAUSE.search(p) else 0
        got = 16 * lines + 4 * end + p[0].isspace()
        if len(self) > 200_000:
            self.clear()
        if len(p) < 64:
            self[p] = got
        return got


_SHAPES = _Shapes()


def boundary_levels(pieces: list[str]) -> np.ndarray:
    """How strongly a text pauses after each piece: 4 paragraph, 3 line, 2 sentence, 1 clause, 0 no more than a word ends.

    A sentence or clause ends where its sign stands before a space; before a line break the
    pause counts after the break.
    """
    shape = np.array(list(map(_SHAPES.__getitem__, pieces)), dtype=np.int64)
    lines, end, spaced = shape >> 4, (shape >> 2) & 3, shape & 1
    follows = np.append((spaced[1:] == 1) & (lines[1:] == 0), False)
    return np.where(lines > 0, lines, np.where(follows, end, 0))


def landmarks(ids: np.ndarray, room: int) -> list[int]:
    """Token positions where the rolling hash of the last WINDOW tokens hits; about three in a room."""
    mask = (1 << max(1, (max(2, room // 3)).bit_length() - 1)) - 1
    with np.errstate(over="ignore"):
        value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        rolled, factor = np.zeros(len(ids), dtype=np.uint64), np.uint64(1)
        for k in range(min(WINDOW, len(ids))):
            rolled[k:] += value[: len(ids) - k] * factor
            factor *= np.uint64(0x9E3779B97F4A7C15)
    mixed = (rolled ^ (rolled >> np.uint64(29))) & np.uint64(mask)
    return (np.flatnonzero(mixed == 0) + 1).tolist()


def cuts(pieces: list[str], ends: np.ndarray, ids: np.ndarray, room: int, first_room: int, first_least: int = 1) -> list[int]:
    """Token positions at which new pieces begin; each part but the first holds at most `room` new tokens."""
    total = int(ends[-1])
    level = boundary_levels(pieces)
    by_level = [ends[level >= k].tolist() for k in (4, 3, 2, 1, 0)]
    marks = landmarks(ids, room)
    out, at, space = [], 0, first_room
    while total - at > space:
        low, high = at + min(space, max(LETTER, int(space * LEAST), 0 if out else first_least)), at + space
        i = bisect_left(marks, low)
        aim = marks[i] if i < len(marks) and marks[i] <= high else high
        best = None
        for strong in by_level[:3]:
            a, b = bisect_left(strong, low), bisect_right(strong, high)
            if a < b:
                j = bisect_left(strong, aim, a, b)
                near = [strong[x] for x in (j - 1, j) if a <= x < b]
                found = min(near, key=lambda x: (abs(x - aim), x))
                # a weaker pause replaces a stronger one only where it lies much nearer
                if best is None or abs(found - aim) * 4 < abs(best - aim):
                    best = found
        if best is None:
            for weak in by_level[3:]:
                a, b = bisect_left(weak, low), bisect_right(weak, high)
                if a < b:
                    best = weak[b - 1]
                    break
        out.append(best or high)
        at, space = out[-1], room
    return out


def _whole_letter(enc: Encoder, ids: np.ndarray, at: int, down: bool) -> int:
    """The nearest token position that does not split a letter's bytes."""
    while 0 < at < len(ids) and enc.bytes_of[int(ids[at])][0] & 0xC0 == 0x80:
        at += -1 if down else 1
    return at


def split_text(enc: Encoder, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(start, end, tokens, shared with the one before, text) of each piece of a text.

    A text within the limit is one piece. No piece has more than `limit` tokens, neither as
    part of the whole encoding nor encoded by itself; each but the first begins `overlap`
    tokens before the end of the one before (a few more where that falls within a letter).
    An overlap too large for the limit is cut to half of it; limits below LETTER count as that,
    since one letter may take so many tokens.
    """
    limit = max(LETTER, limit)
    overlap = max(0, min(overlap, limit // 2))
    pieces = enc.split(text)
    packed = [enc.cache[p] for p in pieces]
    ids = np.frombuffer(b"".join(packed), np.int32)
    if len(ids) <= limit:
        return [(0, len(ids), len(ids), 0, text)]
    slack = LETTER if overlap else 0
    ends = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
    width = np.concatenate([[0], np.cumsum(enc.lengths[ids])])
    data, out = text.encode("utf-8", "surrogatepass"), []
    stops = [*(_whole_letter(enc, ids, c, True) for c in cuts(pieces, ends, ids, max(1, limit - overlap - slack), limit, overlap + LETTER)), len(ids)]

    def recount(a: int, z: int) -> int:
        return enc.count(data[width[a] : width[z]].decode("utf-8", "surrogatepass")) - (z - a)

    def by_itself(start: int, stop: int) -> int:
        """Tokens of a part encoded alone; only its first and last pieces can differ from the whole."""
        n, i, j = stop - start, int(np.searchsorted(ends, start)), int(np.searchsorted(ends, stop))
        if j - i < NEAR:
            return n + recount(start, stop)
        if start and int(ends[i]) != start:
            h = min(i + 3, len(ends) - 1)
            while h + 1 < len(ends) and pieces[h].isspace():
                h += 1
            n += recount(start, min(int(ends[h]), stop))
        if stop < len(ids) and pieces[j].isspace():  # spaces at the end of a text form one piece
            while j > 0 and pieces[j - 1].isspace():
                j -= 1
            n += recount(max(start, int(ends[j - 1]) if j else 0), stop)
        return n

    stops.reverse()
    while stops:
        stop, before = stops.pop(), out[-1][1] if out else 0
        if stop <= before:  # a cut within a letter fell back to its beginning
            continue
        start = _whole_letter(enc, ids, max(0, before - overlap), True) if out else 0
        while (n := by_itself(start, stop)) > limit and start < before:
            start = _whole_letter(enc, ids, min(before, start + 1), False)
        if n > limit and (earlier := _whole_letter(enc, ids, stop - 1, True)) > before:  # alone it counts more than within the text: cut earlier
            stops += [stop, earlier]
            continue
        out.append((start, stop, n, before - start, data[width[start] : width[stop]].decode("utf-8", "surrogatepass")))
    return out


def split_documents(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(key, source, piece, start_token, end_token, n_tokens, shared_tokens, text) of every text.

    Texts of sources that the plan lacks, or whose limit is null, stay whole, as do empty and
    null ones (one piece of 0 tokens, the text unchanged). Repeated rows are cut alike. The
    plan is small and broadcast once counted. Nothing is shuffled. One text is cut by one task.
    """
    limits = plan.groupBy(F.col("source").alias("gm_source")).agg(F.min("max_tokens").alias("gm_limit"), F.min("overlap_tokens").alias("gm_overlap"))
    rows = docs.select(F.col(key).alias("gm_key"), F.col(source).alias("gm_source"), F.col(text).alias("gm_text"))
    rows = rows.join(broadcast_if_few(limits), "gm_source", "left")
    kind = rows.schema["gm_key"].dataType.simpleString()
    columns = ["gm_key", "gm_source", "piece", "start_token", "end_token", "n_tokens", "shared_tokens", "gm_out"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            for part in range(0, len(b), 256):
                out = []
                for k, s, t, most, share in b.iloc[part : part + 256][["gm_key", "gm_source", "gm_text", "gm_limit", "gm_overlap"]].itertuples(index=False, name=None):
                    if not t or most is None or most != most:
                        n = enc.count(t)
                        out.append((k, s, 0, 0, n, n, 0, t))
                        continue
                    for i, (a, z, n, shared, x) in enumerate(split_text(enc, t, int(most), int(share) if share == share and share is not None else 0)):
                        out.append((k, s, i, a, z, n, shared, x))
                yield pd.DataFrame(out, columns=columns)

    rows = rows.select("gm_key", "gm_source", "gm_text", "gm_limit", "gm_overlap")
    cut = rows.mapInPandas(run, f"gm_key {kind}, gm_source string, piece int, start_token bigint, end_token bigint, n_tokens bigint, shared_tokens bigint, gm_out string")
    return cut.withColumnsRenamed({"gm_key": key, "gm_source": "source", "gm_out": "text"})
