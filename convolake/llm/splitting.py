"""Splitting oversized texts at natural boundaries, with overlap, by pointer doubling.

Every place where a text may be cut is a boundary: after a blank line, a line break, the end of a sentence, white space,
and between characters of scripts without spaces; where none of these comes for a while, every STRIDE characters, and as a
last resort, which splits a character from its marks, every STRIDE characters wherever they fall. For *every* boundary, taken as the start of a piece, a sorted search joins the farthest legal end (the best kind of boundary
within the limit) and from it the start of the next piece, at most `overlap` characters before that end. This table
of successors is then squared again and again: after k squarings it leads 2^k pieces ahead, and the starts that are
reached double each time, so a text of n pieces takes log2(n) vectorised steps and no walk from piece to piece.

A text is one value of one row, so its table is built where the row is: no shuffle, and memory is bounded by the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, STRIDE = 1600, 200, 40
#: Blanks, tabs and line breaks at the ends of a text do not count.
TRIMMED = " \t\r\n"
#: A better kind of boundary is taken if it lies in the last part of the piece, of these shares of the limit.
REACH = {4: 0.5, 3: 0.6, 2: 0.7}

# Marks that end a sentence, closing marks after them, and scripts written without spaces.
_STOPS = np.array([ord(c) for c in ".!?…。！？｡؟۔।॥;；"], np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？｡…"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»”’」』）】"], np.uint32)
_SPACELESS = ((0x0E00, 0x0E80), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))
_COMBINING = ((0x0300, 0x0370), (0x0E31, 0x0E32), (0x0E34, 0x0E3B), (0x0E47, 0x0E4F), (0x200D, 0x200E), (0xFE00, 0xFE10), (0x1F3FB, 0x1F400))
#: No piece begins with these where it can be helped.
_TRAILING = np.array([ord(c) for c in "、。，"], np.uint32)
#: Characters of an Arrow batch of pieces.
BATCH_CHARS = 4_000_000


def _within(c: np.ndarray, ranges: tuple) -> np.ndarray:
    out = np.zeros(len(c), bool)
    for low, high in ranges:
        out |= (c >= low) & (c < high)
    return out


def boundaries(text: str, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(position, kind) of every boundary, ascending. A position is where a piece may begin and the one before it end.

    Kinds: 4 after a blank line, 3 after a line break, 2 after a sentence, 1 after white space or beside a character of a
    script without spaces, 0 at multiples of stride, -1 there too if a character would be split from its marks or a piece
    begin with a comma. 0 and len(text) are always there, so no two boundaries lie farther apart than stride.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    space = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | (c == 0x3000) | ((c >= 0x2000) & (c <= 0x200A))
    line = (c == 10) | ((c == 13) & np.concatenate([c[1:] != 10, [True]])) | (c == 0x2028) | (c == 0x2029)
    kind = np.zeros(n + 1, np.int8)
    inner = np.arange(1, n)
    if n > 1:
        before, after = c[:-1], c[1:]
        gap = space[:-1] & ~space[1:]  # the piece begins after all of the white space
        spaceless = _within(before, _SPACELESS) | _within(after, _SPACELESS)
        joined = _within(after, _COMBINING) | (before == 0x200D) | np.isin(after, _TRAILING)
        kind[1:n][gap | (spaceless & ~joined & ~space[1:])] = 1
        stop = np.isin(c, _STOPS)
        closer = np.isin(c, _CLOSERS)
        # the last character that is no white space before each gap, and the one before closing marks
        idx = np.where(~space, np.arange(n), -1)
        last = np.maximum.accumulate(idx)[:-1]
        core = np.maximum.accumulate(np.where(~space & ~closer, np.arange(n), -1))[:-1]
        ended = (last >= 0) & (core >= 0) & stop[np.maximum(core, 0)] & (last - core <= 3)
        kind[1:n][gap & ended] = 2
        wide = np.isin(before, _WIDE_STOPS) & ~np.isin(after, _WIDE_STOPS) & ~np.isin(after, _CLOSERS)
        kind[1:n][wide & ~space[1:]] = 2
        breaks = np.cumsum(line)
        since = breaks[:-1] - np.where(last >= 0, breaks[np.maximum(last, 0)], 0)
        kind[1:n][gap & (since == 1)] = 3
        kind[1:n][gap & (since >= 2)] = 4
        grid = inner % stride == 0
        kind[1:n][grid & joined & (kind[1:n] == 0)] = -1
        keep = (kind[1:n] > 0) | grid
        at = np.concatenate([[0], inner[keep], [n]])
    else:
        at = np.array([0, n] if n else [0])
    kind[0] = kind[n] = 4
    return at.astype(np.int64), kind[at]


def successors(at: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary as a start: the index of the farthest legal end, and of the next piece's start."""
    m = len(at)
    me = np.arange(m)
    far = np.searchsorted(at, at + limit, "right") - 1
    end = far  # a boundary comes within every stride, so this is one within the limit
    chosen = far == m - 1  # the rest fits
    for level in (4, 3, 2, 1, 0):
        of = np.flatnonzero(kind >= level)
        best = of[np.searchsorted(of, far, "right") - 1]
        least = at + limit * REACH.get(level, 0)
        good = ~chosen & (best > me) & (at[best] >= least)
        end = np.where(good, best, end)
        chosen |= good
    # the next start: the first natural boundary within the overlap, else the first boundary there, else the end itself
    natural = np.flatnonzero(kind >= 1)
    begin = at[end] - overlap
    first = natural[np.minimum(np.searchsorted(natural, np.searchsorted(at, begin)), len(natural) - 1)]
    sentence = np.flatnonzero(kind >= 2)
    early = sentence[np.minimum(np.searchsorted(sentence, np.searchsorted(at, begin)), len(sentence) - 1)]
    first = np.where((early <= end) & (at[early] >= begin) & (early > me), early, first)
    legal = (first > me) & (first <= end) & (at[first] >= begin) & (end[first] > end)  # a piece that ends no later would be wasted
    after = np.where(legal, first, end)
    after = np.where(end == m - 1, m - 1, np.maximum(after, np.minimum(me + 1, m - 1)))
    return end, after


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the greedy pieces of text, all derived at once by doubling the table of successors."""
    if overlap >= limit or limit < 1 or overlap < 0:
        raise ValueError("0 <= overlap < limit is needed")
    at, kind = boundaries(text, min(STRIDE, limit))
    if len(at) < 2:
        return []
    end, jump = successors(at, kind, limit, overlap)
    last = len(at) - 1
    reached = np.zeros(len(at), bool)
    reached[0] = True
    while True:
        ahead = jump[np.flatnonzero(reached)]
        if reached[ahead].all():
            break
        reached[ahead] = True
        jump = jump[jump]
    starts = np.flatnonzero(reached[:last])
    return list(zip(at[starts].tolist(), at[end[starts]].tolist()))


def oversized(text: Column, limit: int = LIMIT) -> Column:
    return F.length(F.btrim(text, F.lit(TRIMMED))) > limit


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_pos, piece) of every row of df whose trimmed text has more than `limit` characters.

    start_pos is the piece's first character in the trimmed text, from 1; pieces are numbered from 0, have at most `limit`
    characters and cover the trimmed text, and consecutive ones share at most `overlap` characters. White space at the end of a
    piece belongs to it. Null, empty, blank and short texts have no pieces. Rows that come twice give pieces twice (the
    caller drops them by key and piece_no, after the filter); other columns are left aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [key, "piece_no", "start_pos", "piece"], [None, pa.int32(), pa.int64(), pa.string()]
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            out: list[list] = [[], [], [], []]
            size = 0
            for row in range(batch.num_rows):
                t, of = batch.column(1)[row].as_py(), batch.column(0)[row].as_py()
                for n, (s, e) in enumerate(pieces(t, limit, overlap)):
                    for column, value in zip(out, (of, n, s + 1, t[s:e])):
                        column.append(value)
                    size += e - s
                    if size >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)
                        out, size = [[], [], [], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    kind = df.schema[key].dataType.simpleString()
    long = df.where(oversized(F.col(text), limit)).select(key, F.btrim(F.col(text), F.lit(TRIMMED)).alias("__text"))
    return long.mapInArrow(run, f"`{key}` {kind}, piece_no int, start_pos bigint, piece string")
