import os

import pytest

from brindle.llm import tokens

pytest.importorskip("tiktoken")
if not os.path.exists(tokens.default_path()):
    pytest.skip("the vocabulary is not installed", allow_module_level=True)

TEXTS = [
    None, "", " ", "\n\n  \n", "Hello world's end, it's 3 o'clock.  ", "中文分词与合同台账。喚醒龍契士覚醒", "é  naïve　全角 空格 tab\t\r\n", "１２３ ⅧⅨ Ⅷ9", "😀👍🏽 mixed中A文b", "x" * 70 + "y" * 300, "=" * 500, " " * 200 + "a",
    "ドラゴンの魔神", "한국어 텍스트 русский текст हिन्दी", "\x00\x01\x85​﻿ ", "zz'S 'tis we'll I'd", "aaaa bbbb " * 50, "零" * 64,
]


def test_ids_and_round_trip(spark):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks_of(tokens.default_path()), special_tokens={})
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None)], "doc_id bigint, text string, ids array<int>")
    for common in (0, 5, tokens.COMMON):  # folded in place, or looked up
        rows = tokens.encode(df, common=max(1, common)).collect()
        assert len(rows) == len(TEXTS) + 1
        for r in rows:
            assert list(r.ids) == encoding.encode_ordinary(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(df.where("false")).count() == 0


def test_merges_of_long_words():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    assert tokens.merged(b"abc", ranks) == [258]
    assert tokens.merged(b"aabcx", ranks) == [97, 258, 120]
    assert tokens.merged(b"aaa", ranks) == [259, 97]
