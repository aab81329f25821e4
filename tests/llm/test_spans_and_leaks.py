import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from brindle.llm import leaks, rolling, spans


def shared(docs, span):
    seen = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - span + 1):
            seen[t[p : p + span]].add(i)
    out = {}
    for i, t in docs:
        covered = set()
        for p in range(len(t or "") - span + 1):
            if len(seen[t[p : p + span]]) > 1:
                covered |= set(range(p, p + span))
        if covered:
            out[i] = len(covered)
    return out


def test_spans(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab中é😀\r\n ") for _ in range(n))
    quote, boiler = word(60), word(45)
    docs = [(i, word(rng.randrange(90)) + (quote[rng.randrange(30) :] if i % 4 == 0 else "") + word(20) + (boiler if i % 3 == 0 else "") + word(9)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x" * 300), (103, "x" * 100), (104, quote + quote), (105, word(70)), (106, word(5) + docs[0][1]), (107, "ab" * 80), (108, "ba" * 50)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, n int, windows int")
    want = shared(docs, 40)
    assert {r.doc_id: r.shared_chars for r in spans.found(df, 40, 20).collect()} == want
    monkeypatch.setattr(spans, "CELLS", 0)  # a sketch of one cell a row, which lets all through, loses and adds nothing
    assert {r.doc_id: r.shared_chars for r in spans.found(df, 40, 20).collect()} == want
    assert spans.found(df.where("false"), 40, 20).count() == 0


def test_the_sketch_lets_few_more_through_at_any_load(spark):
    for n in (20_000, 200_000):
        runs = spark.range(n).selectExpr("xxhash64(id) as anchor", "id as doc_id", "true as fresh").unionByName(spark.range(n // 25).selectExpr("xxhash64(id) as anchor", "-id - 1 as doc_id", "true as fresh"))
        passed = spans.passing(runs, spans.CELLS * runs.count())
        again = spark.range(n // 25).selectExpr("xxhash64(id) as anchor")
        assert passed.join(again, "anchor", "left_semi").count() == 2 * (n // 25)
        assert passed.count() <= 1.1 * 2 * (n // 25)


def test_long_rows_are_sliced():
    offsets = np.array([0, 5, 1000, 1003])
    got = set()
    for first, last, begin, end in rolling.slices(offsets, 10, 100):
        for row in range(first, last):
            low, high = max(offsets[row], begin), min(offsets[row + 1], end)
            for p in range(low, high - 9):
                assert (row, p) not in got
                got.add((row, p))
    assert got == {(1, p) for p in range(5, 991)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_min(values, w):
    v = np.array(values, dtype=np.uint64)
    assert rolling.sliding_min(v, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh中文字") for _ in range(n))
    texts = [word(70) for _ in range(6)] + [word(45)]
    items = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "short"), (92, texts[0])]
    spaced = lambda t: " ，".join(t).upper()
    docs = [(1, word(50) + spaced(texts[0][10:50]) + word(50)), (2, word(9) + texts[1][:39]), (3, None), (4, ""), (5, texts[2][:20] + "x" + texts[2][21:60]), (6, texts[6] * 3 + texts[3]), (7, word(3000)), (8, "Ａ" + texts[4][5:60])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(items, "item_id bigint, text string")

    def plain(t):
        return leaks.normal(t).tobytes().decode("utf-32-le")

    want = {(d, i) for d, t in docs for i, x in items if t and x and any(plain(x)[p : p + 40] in plain(t) for p in range(len(plain(x)) - 39))}
    assert {(1, 0), (1, 92), (6, 6), (6, 3), (8, 4)} <= want
    assert {tuple(r) for r in leaks.found(df, it).collect()} == want
    edited = {(r.doc_id, r.item_id): r for r in leaks.alignments(df, it, 30, 15).collect()}
    assert edited[5, 2].longest_run == 39 and edited[5, 2].score > 100
    assert {tuple(r) for r in leaks.alignments(df, it, most_items=2).where("longest_run >= 40").select("doc_id", "item_id").collect()} == want
    assert leaks.found(df.where("false"), it).count() == 0 and leaks.found(df, it.where("false")).count() == 0


def test_edited_copies(spark):
    """Copies with a change every 25 to 35 characters, alone and beside a whole copy."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh中文字") for _ in range(n))
    texts = [word(200) for _ in range(22)]

    def edited(text, every):
        return "".join("x" if i % every == every - 1 else c for i, c in enumerate(text))

    docs = [(i, word(60) + edited(t, 25 + i % 11) + word(60)) for i, t in enumerate(texts)] + [(100 + i, word(30) + t) for i, t in enumerate(texts[:11])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks.alignments(df, it).collect()}
    assert {(i, i) for i in range(22)} | {(100 + i, i) for i in range(11)} == set(got)
    assert all(24 <= got[i, i].longest_run < 40 and got[i, i].score > 300 for i in range(22))
    assert {tuple(r) for r in leaks.found(df, it).collect()} == {(100 + i, i) for i in range(11)}


@settings(max_examples=40, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.lists(st.text("abc", max_size=12), min_size=1, max_size=4))
def test_alignment(item, texts):
    def brute(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (leaks.MATCH if x == y else leaks.MISMATCH), h[i - 1][j] - leaks.GAP, h[i][j - 1] - leaks.GAP)
                run[i][j] = run[i - 1][j - 1] + 1 if x == y else 0
        return max(map(max, h)), max(map(max, run))

    codes = lambda t: np.array([ord(c) for c in t], dtype=np.uint32)
    score, longest = leaks.align(codes(item), [codes(t) for t in texts])
    assert list(zip(score.tolist(), longest.tolist(), strict=True)) == [brute(item, t) for t in texts]
