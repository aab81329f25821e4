"""Splitting oversized items at natural boundaries (recursive bisection).

An item longer than ``limit`` code points is cut at the strongest boundary near its middle, and each half again while
it is longer than limit - overlap; afterwards every piece but the first is preceded by the ``overlap`` code points before
it, so no piece exceeds the limit. A part without a boundary inside is cut in its middle ('forced').
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1000, 100
#: After a line end, after full-width stops, and after ASCII stops that white space follows.
BOUNDARY = re.compile(r"[\n\r。！？；]|[.!?;](?=\s)")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places inside the text at which it may be cut, ascending, and their strengths: 3 after a blank line, 2 after a
    line end, 1 after a sentence, 0 within a pair of carriage return and line feed."""
    places, strengths = [], []
    size = len(text)
    for found in BOUNDARY.finditer(text):
        at = found.end()
        if at == size:
            break
        mark = text[at - 1]
        if mark not in "\n\r":
            strength = 1
        elif mark == "\r" and text[at] == "\n":
            strength = 0
        else:
            before = at - 2 if mark == "\n" and at > 1 and text[at - 2] == "\r" else at - 1
            strength = 3 if before > 0 and text[before - 1] in "\n\r" else 2
        places.append(at)
        strengths.append(strength)
    return places, strengths


def bisect(size: int, places: list[int], strengths: list[int], most: int) -> list[tuple[int, bool]]:
    """(end, natural) of consecutive parts of at most ``most`` code points; the last end is ``size``."""
    from bisect import bisect_left, bisect_right

    ends: list[tuple[int, bool]] = []
    work = [(0, size, True)]  # begin, end, whether the end is natural; leftmost on top
    while work:
        low, high, natural = work.pop()
        if high - low <= most:
            ends.append((high, natural))
            continue
        middle, quarter = (low + high) // 2, (high - low) // 4
        left, right = bisect_right(places, low), bisect_left(places, high)
        i, j = bisect_left(places, middle - quarter, left, right), bisect_right(places, middle + quarter, left, right)
        if i < j:
            best = max(strengths[i:j])
            # of the strongest ones in the middle half the one nearest to the middle
            cut = min((abs(places[n] - middle), places[n]) for n in range(i, j) if strengths[n] == best)[1]
        elif left < right:
            n = bisect_left(places, middle, left, right)
            cut = min((abs(places[m] - middle), places[m]) for m in (n - 1, n) if left <= m < right)[1]
        else:
            work += [(middle, high, natural), (low, middle, False)]
            continue
        work += [(cut, high, natural), (low, cut, True)]
    return ends


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(begin, end, natural) of the pieces of a text, overlap included; one piece if the text is within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), True)]
    pieces, begin = [], 0
    for end, natural in bisect(len(text), *boundaries(text), limit - overlap):
        pieces.append((max(0, begin - overlap), end, natural))
        begin = end
    return pieces


def items(documents: DataFrame) -> DataFrame:
    """(sdoc_id, section_no, text) of each section, numbered from 1, or of the whole text as section 0.

    A section without content is the text between its offsets, which count UTF-16 units. Null texts stay null.
    """
    sections = F.expr("posexplode(CASE WHEN size(sections) > 0 THEN sections ELSE array(CAST(NULL AS STRUCT<title: STRING, level: INT, content: STRING, start_offset: INT, end_offset: INT>)) END)").alias("pos", "s")
    parts = documents.select("sdoc_id", "text", (F.size("sections") > 0).alias("has"), sections)
    between = F.expr("decode(substring(encode(text, 'UTF-16BE'), 2 * s.start_offset + 1, 2 * greatest(s.end_offset - s.start_offset, 0)), 'UTF-16BE')")
    body = F.when(~F.coalesce("has", F.lit(False)), F.col("text")).when(F.col("s.content").isNotNull(), F.col("s.content")).otherwise(between)
    return parts.select("sdoc_id", F.when(F.col("has"), F.col("pos") + 1).otherwise(0).cast("int").alias("section_no"), body.alias("text"))


PIECES = "sdoc_id bigint, section_no int, piece_no int, begin int, end int, natural boolean"


def oversized(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of the items that exceed the limit: sdoc_id, section_no, piece_no from 1, begin, end (code points of the
    item), natural (whether the piece ends at a boundary)[, text]. Each row is handled by itself; nothing is shuffled."""

    def cut(batches):
        for batch in batches:
            names = ["sdoc_id", "section_no", "text"]
            ids, numbers, texts = (batch.column(batch.schema.names.index(n)) for n in names)
            out: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(texts):
                text = text.as_py()
                doc, section = ids[i].as_py(), numbers[i].as_py()
                for n, (begin, end, natural) in enumerate(split(text, limit, overlap), 1):
                    for column, value in zip(out, (doc, section, n, begin, end, natural, text[begin:end] if with_text else None), strict=True):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True)]
            labels = ["sdoc_id", "section_no", "piece_no", "begin", "end", "natural", "text"]
            yield pa.RecordBatch.from_arrays(arrays[: 6 + with_text], names=labels[: 6 + with_text])

    return rows.where(F.char_length("text") > limit).select("sdoc_id", "section_no", "text").mapInArrow(cut, PIECES + (", text string" if with_text else ""))


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All items as ordered pieces within the limit; documents delivered twice give their pieces once.

    Items within the limit are one piece. Null items give none, empty ones an empty piece. Extra columns are dropped.
    """
    rows = items(documents.select("sdoc_id", "text", "sections"))
    whole = rows.where(F.char_length("text") <= limit).select("sdoc_id", "section_no", F.lit(1).alias("piece_no"), F.lit(0).alias("begin"), F.char_length("text").alias("end"), F.lit(True).alias("natural"), "text")
    return whole.unionByName(oversized(rows, limit, overlap)).dropDuplicates(["sdoc_id", "section_no", "piece_no"])


def found(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(sdoc_id, section_no, cut) of the items that exceed the limit: 'forced' if a piece ends where no boundary is."""
    cut = oversized(items(documents.select("sdoc_id", "text", "sections")), limit, overlap, with_text=False)
    return cut.groupBy("sdoc_id", "section_no").agg(F.when(F.min("natural"), "natural").otherwise("forced").alias("cut"))
