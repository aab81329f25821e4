import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import splitting as s

SCHEMA = "sdoc_id bigint, text string, sections array<struct<title: string, level: int, content: string, start_offset: int, end_offset: int>>, piece_no int"


@settings(max_examples=150, deadline=None)
@given(st.text("ab。.\n\r ;中😀", max_size=200), st.integers(4, 30), st.integers(0, 3))
def test_pieces(text, limit, overlap):
    pieces = s.split(text, limit, overlap)
    assert all(end - begin <= limit for begin, end, _ in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, end, _), (begin, _, _) in zip(pieces, pieces[1:], strict=False):
        assert begin == max(0, end - overlap)
    if len(text) > limit:
        marks = [0, *(m.end() for m in re.finditer(r"[\n\r。！？；]|[.!?;](?=\s)", text)), len(text)]
        assert all(natural == (end in marks) or natural for _, end, natural in pieces)
        gap = max(b - a for a, b in zip(marks, marks[1:], strict=False))
        assert (gap > limit - overlap) == (not all(natural for *_, natural in pieces))


def test_items(spark):
    long = "x" * 899 + "。" + "y" * 300
    rows = [
        (1, long, None, 0), (1, long, None, 0), (2, long, [], 0), (3, None, None, 0), (4, "", None, 0), (5, "  \n" * 400, None, 0),
        (6, "😀ab" + "z" * 1200, [("t", 1, None, 2, 1204), ("t", 1, "short", None, None), (None, None, "w" * 2000, 0, 0)], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in s.found(df).collect()} == {(1, 0, "natural"), (2, 0, "natural"), (5, 0, "natural"), (6, 1, "forced"), (6, 3, "forced")}
    pieces = s.pieces(df).collect()
    assert [r.text for r in pieces if r.sdoc_id == 6 and r.section_no == 2] == ["short"]
    assert {r.sdoc_id for r in pieces} == {1, 2, 4, 5, 6}
    first = sorted((r for r in pieces if r.sdoc_id == 1), key=lambda r: r.piece_no)
    assert len(first) == 2 and first[1].text == long[800:]
    assert s.pieces(df.where("false")).count() == 0 and s.found(df.where("false")).count() == 0
