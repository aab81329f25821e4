"""Chunking of documents. Positions and sizes count UTF-16 units, as in the system whose results these are.

The fixed strategy rejoins broken URLs and parted ideographs first, and with overlap each cut depends on the one before; the
structure-aware strategy packs blocks one after the other: these run as Arrow UDFs, document by document, without a shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_control

# What a URL may hold, what a line break in a URL may follow or precede, and what may be joined over a line break.
_URL = r"-A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%"
_WORD = r"㐀-䶿一-鿿豈-﫿＀＂-＇＊＋－-９＜-＞＠-￯"
_BREAK = re.compile(rf"(?<=[{_WORD}])\n(?=[{_WORD}])")
_SCHEME = re.compile("https?://")
_ITEM = re.compile(r"[ \t]*\d+[.)）]")
_BODY = re.compile(rf"[{_URL}]*")
# What counts as white space (no-break spaces don't), and what a text without content may also hold.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
NOTHING = WHITE + "\xa0\u2007\u202f\ufeff\u202a\0"
_GAP = re.compile(f"[{WHITE}]+")


def _units(text: str) -> str:
    """One character per UTF-16 unit."""
    return text if text.isascii() or max(text) <= "￿" else "".join(map(chr, memoryview(text.encode("utf-16-le")).cast("H")))


def _text(units: str) -> str:
    try:
        units.encode("utf-8")
        return units
    except UnicodeEncodeError:
        return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def rejoin(text: str) -> str:
    """Without carriage returns; URLs broken over lines and ideographs parted by one line break are put together."""
    text = text.replace("\r", "")
    out, at = [], 0
    while (found := _SCHEME.search(text, at)) is not None:
        out.append(_BREAK.sub("", text[at : found.start()]) if at == 0 else _plain(text, at, found.start()))
        at = found.start()
        while True:
            end = _BODY.match(text, at).end()
            out.append(text[at:end])
            at = end
            gap = _GAP.match(text, at)
            if gap is None:
                if at < len(text):  # a character that no URL holds ends it
                    out.append(text[at])
                    at += 1
                break
            after = gap.end()
            if "\n" in gap[0] and after < len(text) and _goes_on(text, at, after):
                at = after
                continue
            out.append(gap[0])
            at = after
            break
    out.append(_plain(text, at, len(text)))
    return "".join(out)


def _plain(text: str, begin: int, end: int) -> str:
    """Text outside URLs, looking one character past both ends."""
    low = max(0, begin - 1)
    joined = _BREAK.sub("\0", text[low : end + 1])
    lead, tail = begin - low, 1 if end < len(text) else 0
    return joined[lead : len(joined) - tail].replace("\0", "") if end > begin else ""


def _goes_on(text: str, before: int, after: int) -> bool:
    if _ITEM.match(text, after):
        return False
    last, following = text[before - 1], text[after]
    return (last == "." and following.isalpha()) or last in "/?&=#%-_:" or following in "/?&=#"


def fixed(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of about ``size``, each beginning ``overlap`` before the end of the last one; size -1 gives one chunk."""
    if not text or not text.strip(WHITE):
        return []
    text = _units(rejoin(text))
    if size == -1:
        return [_text(text)]
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    chunks, begin, last = [], 0, -1
    while begin < len(text):
        aim = min(begin + size, len(text))
        end = _nearest(text, begin, aim, min(overlap, aim - begin))
        if end <= begin or end <= last:
            end = aim
        if text[begin:end].strip(WHITE):
            chunks.append(_text(text[begin:end]))
        last = end
        if end >= len(text):
            break
        begin = end - overlap if end - overlap > begin else end
    return chunks


def _nearest(text: str, begin: int, aim: int, reach: int) -> int:
    """The last line end, else the last full-width stop, else the last ASCII stop before white space, that lies within reach."""
    if reach <= 0:
        return aim
    low = max(begin + 1, aim - 1 - reach)
    if (at := text.rfind("\n", low, aim)) >= 0:
        return at + 1
    if (at := max(text.rfind(c, low, aim) for c in "。！？")) >= 0:
        return at + 1
    for at in range(aim - 1, low - 1, -1):
        if text[at] in ".!?" and (at + 1 >= len(text) or text[at + 1] in WHITE):
            return at + 1
    return aim


_LINES = re.compile(r"[^\n]*(?:\n|\Z)")
_FENCE = re.compile(r"```")
_ALONE = re.compile(r"#{1,6}\s+.*|!\[[^\]]*\]\([^)]+\)(?:\s*\"[^\"]*\")?\s*|\[[^\]]+\]\([^)]+\)\s*", re.A)


def blocks(text: str) -> list[tuple[int, int]]:
    """(begin, end) of headings, image and link lines, fenced code and paragraphs; each takes the empty lines after it."""
    found: list[list[int]] = []
    fenced = open_ = False
    for line in _LINES.finditer(text):
        if line.end() == line.start():
            break
        bare = line[0].rstrip(WHITE)
        if fenced:
            if _FENCE.match(bare):
                found[-1][1], fenced = line.end(), False
            continue
        if _FENCE.match(bare):
            found.append([line.start(), len(text)])
            fenced, open_ = True, False
        elif not bare:
            open_ = False
        elif _ALONE.fullmatch(bare):
            found.append([line.start(), line.end()])
            open_ = False
        elif open_:
            found[-1][1] = line.end()
        else:
            found.append([line.start(), line.end()])
            open_ = True
    for one, following in zip(found, found[1:], strict=False):
        if not text[one[1] : following[0]].strip(" \t\r\n"):
            one[1] = following[0]
    return [(a, b) for a, b in found]


def structured(text: str | None, target: int, overlap: int, most: int, least: int) -> list[str]:
    """Whole blocks packed up to ``most``; a chunk below ``least`` takes one block more, and a small last one joins the one before."""
    if not text or not text.strip(NOTHING):
        return []
    text = _units(text.replace("\r\n", "\n").replace("\r", "\n"))
    parts = blocks(text)
    if not parts:
        return [_text(text)]
    packed: list[list[int]] = []
    closed = True
    for begin, end in parts:
        if closed:
            packed.append([begin, end])
            closed = False
        elif end - packed[-1][0] <= most:
            packed[-1][1] = end
        elif packed[-1][1] - packed[-1][0] < least:
            packed[-1][1] = end
            closed = True
        else:
            packed.append([begin, end])
    if len(packed) > 1 and packed[-1][1] - packed[-1][0] < min(least, target // 2) and packed[-1][1] - packed[-2][0] <= 2 * most:
        last = packed.pop()
        packed[-1][1] = last[1]
    bodies = [text[a:b] for a, b in packed]
    return [_text((bodies[i - 1][-overlap:] if i and overlap > 0 else "") + body) for i, body in enumerate(bodies)]


STRATEGIES = {
    "fixed_size": lambda text, chunk_size=512, overlap_size=128: fixed(text, chunk_size, overlap_size),
    "structure_aware": lambda text, target_chars=1400, overlap_chars=0, max_chars=1800, min_chars=600: structured(text, target_chars, overlap_chars, max_chars, min_chars),
}


def chunk(documents: DataFrame, strategy: str, **options: int) -> DataFrame:
    """(doc_id, chunk_index, content) of the documents (doc_id, text); blank texts give none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    cut = STRATEGIES[strategy]

    def run(batches):
        for batch in batches:
            ids, index, content = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = cut(text, **options)
                ids += [doc] * len(pieces)
                index += range(len(pieces))
                content += pieces
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=["doc_id", "chunk_index", "content"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk_index int, content string")


def pieces(text: Column, strategy: str, **options: int) -> Column:
    """The contents of the chunks of a text, as an array; none for null and blank texts."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    cut = STRATEGIES[strategy]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cut(t, **options) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def clipped(contents: Column, most: int) -> Column:
    """Each text of an array cut to ``most`` UTF-16 units."""

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([x and [c if len(c) * 2 <= most else _text(_units(c)[:most]) for c in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(contents)


def chunk_plain(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk_index, content): pieces of ``size`` code points of the text without carriage returns, blank ones left out."""
    text = F.replace("text", F.lit("\r"), F.lit(""))
    pieces = F.filter(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda p: ~is_blank(p))
    return documents.select("doc_id", F.posexplode(pieces).alias("chunk_index", "content"))


def chunk_lines(documents: DataFrame, lines: int) -> DataFrame:
    """(doc_id, chunk_index, content): groups of so many lines, each line trimmed; groups without text are left out."""
    each = F.transform(F.split("text", "\n"), trim_control)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / lines).cast("int")), lambda i: F.array_join(F.slice(each, i * lines + 1, lines), "\n"))
    solid = F.filter(F.transform(groups, trim_control), lambda g: g != "")
    return documents.where("text is not null").select("doc_id", F.posexplode(solid).alias("chunk_index", "content"))
