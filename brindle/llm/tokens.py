"""Encoding with a public byte-level BPE vocabulary by Spark's higher-order functions.

Texts are cut into words by the vocabulary's pattern, and words between two ideographs where no token of the vocabulary has
the bytes on both sides of the cut next to each other (no merge can cross it, so the ids are the same). A word is folded: of its
pieces the neighbours of least rank are joined until no pair has a rank. Ranks are a literal: an array of small maps, so that a
look-up costs a hash and a short scan. The words that occur in most records (COMMON of them, counted over the whole
corpus) are folded once and become a literal too; any other word is folded where it stands. Nothing but these counts is
shuffled. Folding takes the square of a word's length: records with a word of more than LONG bytes are encoded by the same
merges with a heap.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON, LONG = 65_536, 256
BUCKETS = 1 << 14
VOCABULARY = "byte_bpe_50k.tiktoken"
SPACE = r"\p{IsWhite_Space}"


def default_path() -> str:
    """The installed vocabulary file."""
    import public_tokenizers

    return os.path.join(os.path.dirname(public_tokenizers.__file__), VOCABULARY)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def crossings(ranks: dict[bytes, int]) -> set[tuple[int, int]]:
    """(last byte, lead byte of an ideograph) that stand side by side in some token."""
    return {(a, b) for token in ranks for a, b in zip(token, token[1:], strict=False) if 0xE4 <= b <= 0xE9 and a >= 0x80}


#: Fixed value: the pattern of this vocabulary, in Java's spelling.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_class(codes: Iterable[int]) -> str:
    """A pattern over bytes (as characters U+0000 to U+00FF) of one of these non-ASCII code points in UTF-8."""
    lasts: dict[bytes, int] = {}
    for code in codes:
        encoded = chr(code).encode("utf-8", "surrogatepass")
        lasts[encoded[:-1]] = lasts.get(encoded[:-1], 0) | 1 << (encoded[-1] - 0x80)

    def spelled(bits: int) -> str:
        out, at = "", 0
        while at < 128:
            if bits >> at & 1:
                end = at
                while end < 127 and bits >> (end + 1) & 1:
                    end += 1
                out += f"\\x{0x80 + at:02x}" + (f"-\\x{0x80 + end:02x}" if end > at else "")
                at = end
            at += 1
        return f"[{out}]"

    def tree(level: dict[bytes, str]) -> str:
        """Prefixes and what follows them, from the last byte but one to the first."""
        while any(level):
            upper: dict[bytes, dict[str, int]] = {}
            done: dict[bytes, str] = {}
            longest = max(map(len, level))
            for prefix, rest in level.items():
                if len(prefix) < longest:
                    done[prefix] = rest
                elif len(prefix) == 1:
                    upper.setdefault(b"", {}).setdefault(rest, 0)
                    upper[b""][rest] |= 1 << (prefix[0] - 0x80)
                else:
                    upper.setdefault(prefix[:-1], {}).setdefault(rest, 0)
                    upper[prefix[:-1]][rest] |= 1 << (prefix[-1] - 0x80)
            for prefix, rests in upper.items():
                branches = "|".join(spelled(bits) + rest for rest, bits in rests.items())
                branch = f"(?:{branches})" if len(rests) > 1 else branches
                done[prefix] = f"(?:{done[prefix]}|{branch})" if prefix in done else branch
            level = done
        return level.get(b"", "(?!)")

    return tree({prefix: spelled(bits) for prefix, bits in lasts.items()})


@lru_cache(1)
def byte_pattern(unsafe: frozenset[tuple[int, int]]) -> str:
    """PATTERN over the bytes of a text, cut between ideographs unless the bytes at the cut are among the unsafe ones."""
    spaces = {ord(c) for c in SPACES}
    kinds: dict[str, list[int]] = {"L": [], "N": [], "S": [], "": []}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF or 0x4E00 <= code <= 0x9FFF:
            continue
        kind = unicodedata.category(chr(code))[0] if code < 0x40000 else ""
        kinds["S" if code in spaces else kind if kind in "LN" else ""].append(code)
    # ideographs and the marks between them come first, for speed
    marks = r"\xef\xbc[\x81-\x8f\x9a-\xa0]|\xe3\x80[\x81-\x84\x88-\x9f]"
    high = rf"(?=[\xc2-\xf4])(?!{marks})"
    han = r"\xe4[\xb8-\xbf][\x80-\xbf]|[\xe5-\xe9][\x80-\xbf][\x80-\xbf]"
    letter = rf"(?:[A-Za-z]|{han}|{high}{byte_class(kinds['L'])})"
    digit = rf"(?:[0-9]|{high}{byte_class(kinds['N'])})"
    space = rf"(?:[\x09-\x0d ]|{high}{byte_class(kinds['S'])})"
    other = rf"(?:[\x00-\x08\x0e-\x1f!-/:-@\[-`{{-\x7f]|{marks}|(?=[\xc2-\xf4]){byte_class(kinds[''])})"
    pairs = "|".join(f"(?<=\\x{a:02x})\\x{b:02x}" for a, b in sorted(unsafe))
    safe = r"(?=[\xe4-\xe9])" + (f"(?!{pairs})" if pairs else "")
    cut = rf"{safe}(?<=[\xe4-\xe9][\x80-\xbf][\x80-\xbf])"
    # the same cut by an ideograph's last byte, without looking back: most words are single ideographs
    bad: dict[int, list[int]] = {}
    for a, b in unsafe:
        bad.setdefault(a, []).append(b)
    free = "[\\x80-\\xbf" + (f"&&[^{''.join(f'\\x{a:02x}' for a in sorted(bad))}]" if bad else "") + "](?=[\\xe4-\\xe9])"
    last = "|".join([free, *(f"\\x{a:02x}(?=[\\xe4-\\xe9&&[^{''.join(f'\\x{b:02x}' for b in sorted(bs))}]])" for a, bs in sorted(bad.items()))])
    quick = rf"\xe4[\xb8-\xbf](?:{last})|[\xe5-\xe9][\x80-\xbf](?:{last})| ?[A-Za-z]++(?![\x80-\xff])| ?[0-9]++(?![\x80-\xff])|[\x09-\x0d](?=[!-~\xe5-\xe9])"
    plain = rf" ?[!-/:-@\[-`{{-~]++(?![\x00-\x08\x0e-\x1f\x7f-\xff])|(?:{marks})++(?=[\xe5-\xe9A-Za-z0-9\x09-\x0d ]|\xe4[\xb8-\xbf]|\z)"
    return rf"{quick}|'(?:[stmd]|re|ve|ll)|{plain}| ?{letter}(?:(?!{cut}){letter})*+| ?{digit}++| ?{other}++|(?:{space}(?={space}|\z))++|{space}"


def words(text: Column, ranks: dict[bytes, int]) -> Column:
    """The words of a text, as characters U+0000 to U+00FF that stand for their bytes, cut between ideographs where that is safe."""
    pattern = byte_pattern(frozenset(crossings(ranks)))
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(pattern), F.lit(0))


def buckets(entries: DataFrame, value: str) -> list[dict]:
    """Entries (key, value) as one map per bucket of the key's hash."""
    table: list[dict] = [{} for _ in range(BUCKETS)]
    for row in entries.select(F.hash("key").bitwiseAND(BUCKETS - 1).alias("b"), "key", value).collect():  # a vocabulary, or COMMON words
        table[row.b][row.key] = row[value]
    return table


def literal(table: list[dict], kind: str) -> Column:
    """Constant-folded into an array of maps."""
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), f"array<map<string, {kind}>>")


def look_up(table: Column, key: Column) -> Column:
    return F.element_at(F.get(table, F.hash(key).bitwiseAND(BUCKETS - 1)), key)


def fold(word: Column, ranks: Column) -> Column:
    """The ids of a word of ``words``: its bytes, joined by rank."""
    text = word
    single = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))

    def join(pieces: Column) -> Column:
        """The pieces with the leftmost pair of least rank joined; all in one struct, so that each part is computed once."""
        pairs = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: look_up(ranks, F.concat(F.element_at(pieces, i), F.element_at(pieces, i + 1))))
        ranked = F.transform(F.array(pairs), lambda r: F.struct(r.alias("r"), F.array_min(r).alias("least")))
        placed = F.transform(ranked, lambda x: F.array_position(x["r"], x["least"]).cast("int"))
        return F.element_at(F.transform(placed, lambda p: F.when(p.isNull() | (p == 0), pieces).otherwise(F.concat(F.slice(pieces, F.lit(1), p - 1), F.array(F.concat(F.element_at(pieces, p), F.element_at(pieces, p + 1))), F.slice(pieces, p + 2, F.size(pieces))))), 1)

    # a round that joins nothing leaves the pieces as they are; the rest of the rounds then ends at once
    done = F.aggregate(
        F.sequence(F.lit(1), F.length(text)),
        F.struct(single.alias("p"), F.lit(False).alias("end")),
        lambda s, _: F.when(s["end"] | (F.size(s["p"]) < 2), s).otherwise(F.element_at(F.transform(F.array(join(s["p"])), lambda q: F.struct(q.alias("p"), (F.size(q) == F.size(s["p"])).alias("end"))), 1)),
        lambda s: F.transform(s["p"], lambda piece: look_up(ranks, piece)),
    )
    return F.coalesce(F.transform(F.array(look_up(ranks, text)), lambda r: F.when(r.isNotNull(), F.array(r)))[0], done)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids by a heap of pairs, for long words."""
    if word in ranks:
        return [ranks[word]]
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
    heap = [(ranks[p], i, p) for i in range(len(word) - 1) if (p := word[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if pieces[i] is not None else -1
        if j < 0 or pieces[j] is None or pieces[i] + pieces[j] != pair:
            continue
        pieces[i], pieces[j], after[i] = pair, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] >= 0 and (p := pieces[a] + pieces[after[a]]) in ranks:
                heapq.heappush(heap, (ranks[p], a, p))
    return [ranks[p] for p in pieces if p is not None]


def encode(documents: DataFrame, path: str | None = None, common: int = COMMON) -> DataFrame:
    """(doc_id, ids): the ids of each text without special tokens; the empty list for an empty or null text.

    One row per row of the input, repeated ids included; other columns are dropped.
    """
    spark = documents.sparkSession
    path = path or default_path()
    vocabulary = ranks_of(path)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = words(F.col("text"), vocabulary)
    keys = spark.createDataFrame(pa.table({"key": [k.decode("latin-1") for k in vocabulary], "rank": pa.array(vocabulary.values(), pa.int32())}))
    ranks = literal(buckets(keys, "rank"), "int")
    each = texts.select(F.explode(F.array_distinct(cut)).alias("key")).where(F.length("key") <= LONG).groupBy("key").count()
    top = each.orderBy(F.col("count").desc(), "key").limit(common).select("key").repartition(spark.sparkContext.defaultParallelism)  # the limit leaves one partition
    known = literal(buckets(top.select("key", F.transform(F.array(ranks), lambda r: fold(F.col("key"), r))[0].alias("ids")), "ids"), "array<int>")

    # in a struct, so that the plan holds each literal once and each text is cut once; flattening gives null where a word is too long to fold
    row = F.struct(cut.alias("words"), ranks.alias("ranks"), known.alias("known"))
    made = F.transform(F.array(row), lambda x: F.flatten(F.transform(x["words"], lambda w: F.coalesce(look_up(x["known"], w), F.when(F.length(w) <= LONG, fold(w, x["ranks"]))))))[0]
    shared = spark.sparkContext.broadcast(vocabulary)

    def heaped(batches):
        import regex

        table, pattern = shared.value, regex.compile(PATTERN.replace(SPACE, r"\p{White_Space}"))
        for batch in batches:
            if batch.column(1).null_count:
                done = [
                    [i for w in pattern.findall(text) for i in merged(w.encode(), table)] if found is None else found
                    for found, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                ]
                batch = batch.set_column(1, "ids", pa.array(done, batch.schema.field(1).type))
            yield batch.select([0, 1])

    folded = texts.select("doc_id", "text", made.alias("ids")).select("doc_id", "ids", F.when(F.col("ids").isNull(), F.col("text")).alias("text"))
    return folded.mapInArrow(heaped, "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the tokens' bytes, concatenated; null for bytes that are no UTF-8 text."""
    spark = rows.sparkSession
    vocabulary = ranks_of(path or default_path())
    table: list[str] = [""] * (max(vocabulary.values()) + 1)
    for token, rank in vocabulary.items():
        table[rank] = token.hex()
    pieces = F.from_json(F.lit(json.dumps(table)), "array<string>")
    whole = F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(pieces, i + 1)), ""))
    return rows.select("doc_id", F.when(F.is_valid_utf8(whole.cast("string")), whole.cast("string")).alias("text"))
