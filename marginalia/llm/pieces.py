"""Splitting oversized texts at natural boundaries, with balanced piece lengths.

The fewest possible pieces get equally spaced target ends; each end moves to the
strongest boundary near its target (paragraph, line, sentence, word). Where that
leaves no boundary within reach, the rest gets one more piece and new targets; the
pieces before it stand, so that the time follows the text's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LIMIT, OVERLAP = 2000, 200

#: Where a piece may end, strongest first: after a blank line, a line end, a sentence end with its white space, any white space.
_BOUNDARIES = tuple(re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\n\s*", r"[.!?。！？।…]+[\"'”’)\]]*\s+|[。！？।]", r"\s+"))
_NAMES = ("paragraph", "line", "sentence", "word", "none", "end")


def boundaries(text: str) -> list[list[int]]:
    """Offsets just behind each boundary, ascending, by strength."""
    return [[m.end() for m in p.finditer(text)] for p in _BOUNDARIES]


def _nearest(ends: list[int], low: int, high: int, target: int) -> int | None:
    """The end in [low, high] nearest to target; the earlier of two equally near."""
    i, j = bisect_left(ends, low), bisect_right(ends, high)
    if i == j:
        return None
    k = bisect_left(ends, target, i, j)
    near = [ends[x] for x in (k - 1, k) if i <= x < j]
    return min(near, key=lambda e: (abs(e - target), e))


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of each piece; consecutive pieces share exactly `overlap` characters.

    An end prefers the strongest boundary within a quarter of a piece around its
    target, then the strongest one anywhere it may lie, and only without any
    white space there cuts inside a word.
    """
    n = len(text)
    fresh = limit - overlap
    rest = max(0, -(-(n - limit) // fresh))  # pieces after the first: the fewest possible
    width = (n - overlap) // (rest + 1)
    marks = boundaries(text) if rest else []
    cuts, start = [], 0
    while n - start > limit:
        first = start + overlap + 1  # a piece must reach beyond its overlap
        high = min(start + limit, n - 1)
        while True:
            low = max(first, n - rest * fresh)  # the later pieces must be able to take the rest
            end, kind = _snap(marks, low, high, start + overlap + (n - start - overlap) // (rest + 1), max(1, width // 4))
            if end is None and low > first and any(bisect_left(e, first) < bisect_right(e, high) for e in marks):
                rest += 1  # a boundary lies earlier; with one more piece it can be used
                continue
            break
        if end is None:
            end = min(max(start + overlap + (n - start - overlap) // (rest + 1), low), high)
        cuts.append((start, end, kind))
        start, rest = end - overlap, max(1, rest - 1)
    return [*cuts, (start, n, "end")]


def _snap(marks: list[list[int]], low: int, high: int, target: int, radius: int) -> tuple[int | None, str]:
    """The strongest boundary near the target, else the strongest in all the range, with its name."""
    target = min(max(target, low), high)
    for lo, hi in ((max(low, target - radius), min(high, target + radius)), (low, high)):
        for name, ends in zip(_NAMES, marks):
            if (end := _nearest(ends, lo, hi, target)) is not None:
                return end, name
    return None, "none"


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: id, piece_no (from 0), pieces, start (code point offset), text, boundary.

    A text within the limit is one piece, also an empty one; a null text is one
    piece with null text and start 0. boundary names what the piece ends at:
    paragraph, line, sentence, word, none (no white space within reach) or end.
    Joining the first piece with the others without their first `overlap`
    characters gives the text back. Ids may be null or repeat; each row is split on its
    own. Further columns are ignored; an empty input gives an empty result.
    0 <= overlap < limit / 2 is required.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and below half of the limit")
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([
        rows.schema["id"], T.StructField("piece_no", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("boundary", T.StringType()),
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, no, of, starts, texts, kinds = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                cuts = cut_points(text, limit, overlap) if text is not None else [(0, 0, "end")]
                for k, (start, end, kind) in enumerate(cuts):
                    which.append(i)
                    no.append(k)
                    of.append(len(cuts))
                    starts.append(start)
                    texts.append(None if text is None else text[start:end])
                    kinds.append(kind)
            ids = b.column("id").take(pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string()), pa.array(kinds, pa.string())], names=schema.names)

    return rows.mapInArrow(split, schema)
