"""Splitting oversized items at natural boundaries (problem 5).

Method: content-defined chunking. A 32-code-point gear hash marks landmarks;
from each piece's start the strongest landmark between a minimum and a maximum
size is taken and snapped to the nearest natural boundary of the best kind in
reach: heading, block, sentence, line, word. Landmarks depend on the text
around them only, so an edit alters the pieces near it and no others. Where a
stretch has no boundary at all the cut is hard, but never inside a grapheme.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import codes, gear

# fixed value: what counts as a heading line
HEADING = re.compile(r"^(#{1,6})\s+(.+?)[ \t]*$", re.M)
# boundary kinds, best first: a cut stands at the end of the match
KINDS = (re.compile(r"\n(?=#{1,6}\s)"), re.compile(r"\n[ \t]*\n\s*"), re.compile(r"[.!?…。！？]+[\"”’)\]]*\s+|[。！？]"), re.compile(r"\n"), re.compile(r"\s+"))


def _joins(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part one grapheme."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return bool(unicodedata.combining(b)) or b in "‍︎️" or a == "‍" or (a == "\r" and b == "\n") or "\U0001f3fb" <= b <= "\U0001f3ff"


def cut_points(text: str, limit: int, overlap: int, least: int, reach: int) -> list[int]:
    """Ends of the pieces' own parts, ascending, the last being the text's end."""
    n = len(text)
    if n <= limit:
        return [n]
    strength = gear(codes(text))
    marks = [np.array(sorted({m.end() for m in kind.finditer(text)}), np.int64) for kind in KINDS]
    ends, start = [], 0
    while n - start > limit - (overlap if ends else 0):
        most = limit - (overlap if ends else 0)  # what repeats of the piece before also counts
        lo, hi = start + least, min(start + most, n - least // 3)  # leaves no crumb for the last piece
        mark = lo + int(np.argmax(strength[lo:hi]))
        cut = 0
        for near in (reach, most):
            for at in marks:
                near_at = at[np.searchsorted(at, max(lo, mark - near)) : np.searchsorted(at, min(hi, mark + near), "right")]
                near_at = near_at[near_at < n]
                if len(near_at):
                    cut = int(near_at[np.argmin(np.abs(near_at - mark))])
                    break
            if cut:
                break
        if not cut:
            cut = mark
            while cut > lo and _joins(text, cut):
                cut -= 1
            cut = cut if cut > lo else mark
        ends.append(cut)
        start = cut
    return [*ends, n]


def _back(text: str, start: int, overlap: int) -> int:
    """Where the repeat before ``start`` begins: about ``overlap`` back, at the next word's start if one is close."""
    at = max(0, start - overlap)
    m = re.compile(r"\s+").search(text, at, min(start, at + overlap // 4)) if at else None
    if m and m.end() < start:
        return m.end()
    while 0 < at < start and _joins(text, at):
        at += 1
    return at


def headings_at(text: str, ancestry: str | None, points: list[int]) -> list[list[str]]:
    """The heading path in force at each of the ascending positions; a heading that begins there is in force.

    Before the text's first heading the stored ancestry holds. If its last entry
    is that first heading, it gives way to it; entries above count as levels
    above it.
    """
    names = [x for x in (ancestry or "").split(" > ") if x.strip()]
    found = [(m.start(), len(m.group(1)), m.group(2)) for m in HEADING.finditer(text)]
    top = found[0][1] if found else 7
    own = bool(found and names and names[-1].strip() == found[0][2].strip())
    stack = [(max(0, top - (len(names) - i) + (1 if own else 0)) if found else i, x) for i, x in enumerate(names)]
    out, k = [], 0
    for p in points:
        while k < len(found) and found[k][0] <= p:
            at, level, name = found[k]
            if k == 0 and own:
                stack = stack[:-1]
            stack = [x for x in stack if x[0] < level] + [(level, name)]
            k += 1
        out.append([x for _, x in stack])
    return out


def split_oversized(
    df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", ancestry_col: str = "heading_ancestry",
    limit: int = 2000, overlap: int = 285, least: int = 700, reach: int = 250,
) -> DataFrame:
    """(id_col, piece, start, text, heading, heading_ancestry, char_count) of the items of more than ``limit`` code points.

    piece counts from 0; start is the piece's first code point in the item. Each
    piece has at most ``limit`` code points; each after the first begins with
    about ``overlap`` that the piece before ends with; pieces without their
    repeats joined give the item back. heading_ancestry is the heading path where
    the piece's own part begins, heading its last entry (null if there is none).
    Null texts and items within the limit give no row; items repeated whole
    count once; an id that has several texts gives the pieces of each.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(ancestry_col).cast("string").alias("anc")).where(F.length("text") > limit).distinct()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (text, ancestry) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                ends = cut_points(text, limit, overlap, least, reach)
                starts = [0, *ends[:-1]]
                for k, (s, e, path) in enumerate(zip(starts, ends, headings_at(text, ancestry, starts))):
                    begin = _back(text, s, overlap) if k else 0
                    at.append(i)
                    out.append((k, begin, text[begin:e], path[-1] if path else None, " > ".join(path), e - begin))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "piece", "start", "text", "heading", "heading_ancestry", "char_count"])

    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInArrow(emit, f"id {kind}, piece int, start int, text string, heading string, heading_ancestry string, char_count int")
    return pieces.withColumnRenamed("id", id_col)


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return split_oversized(table(spark, sf_dir, "chunks"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 0").select("chunk_id").distinct()
