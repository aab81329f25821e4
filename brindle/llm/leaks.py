"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared after NFKC, lower-casing and removal of everything but letters and digits. One pass over the
records finds every place where GRAM characters of a test item stand and cuts out the passages around such places.
From the number of records that hold each n-gram, every stretch of so many characters of an item is given as a seed its rarest
n-gram among those that occur, so no shared run of a stretch's length is lost and common n-grams start no alignment that a
rarer one would not. Passages with a seed of an item are aligned with it. Exact runs need stretches of RUN characters; for edited
copies a stretch has STRETCH, so that a copy is aligned that keeps so many characters in a row somewhere, whatever others hold.

Only the items are broadcast, in blocks of at most MOST_ITEMS items; records are scanned once per block.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .rolling import SLICE, Prefix, row_blocks, slices

RUN, GRAM, STRETCH, MOST_ITEMS = 40, 20, 24, 20_000
MATCH, MISMATCH, GAP = 2, -1, 2


@lru_cache(1)
def kept_marks() -> np.ndarray:
    """For each code point whether its category is L or N; there are none of these beyond plane 3."""
    marks = np.zeros(0x110000, dtype=bool)
    marks[:0x40000] = [unicodedata.category(chr(c))[0] in "LN" for c in range(0x40000)]
    return marks


def normal(text: str | None) -> np.ndarray:
    """The code points by which texts are compared."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(unicodedata.normalize("NFKC", text).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes[kept_marks()[codes]]


def normal_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points of many texts, and offsets."""
    parts = [unicodedata.normalize("NFKC", t).lower() if t else "" for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, parts)])
    good = kept_marks()[codes]
    kept = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(good, out=kept[1:])
    return codes[good], kept[ends]


def grams(codes: np.ndarray, gram: int) -> np.ndarray:
    if len(codes) < gram:
        return np.zeros(0, np.uint64)
    step = SLICE
    return np.concatenate([Prefix(codes[i : i + step + gram - 1]).windows(gram) for i in range(0, len(codes) - gram + 1, step)])


class Lookup:
    """Membership in a set of hashes: a bit table first, then the sorted hashes."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.bits = max(16, min(26, int(len(self.known) * 16).bit_length()))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self.known >> np.uint64(64 - self.bits)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(at):
            return at
        i = np.searchsorted(self.known, hashes[at])
        return at[self.known[np.minimum(i, len(self.known) - 1)] == hashes[at]]


PASSAGE = "doc_id bigint, begin bigint, text string, grams array<bigint>"


def passages(documents: DataFrame, known: np.ndarray, gram: int, margin: int) -> DataFrame:
    """The parts of the normalised records around known n-grams, with the n-grams found there."""
    shared = documents.sparkSession.sparkContext.broadcast(np.unique(known))

    def scan(batches):
        lookup = Lookup(shared.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, block in row_blocks(batch.column(1)):
                codes, offsets = normal_texts(block.to_pylist())
                rows: list[tuple] = []
                where, what, owner = [], [], []
                for first, last, begin, end in slices(offsets, gram):
                    if end - begin < gram:
                        continue
                    hashes = Prefix(codes[begin:end]).windows(gram)
                    at = lookup.hits(hashes)
                    if not len(at):
                        continue
                    record = np.searchsorted(offsets[first + 1 : last + 1], at + begin, side="right") + first
                    inside = at + begin + gram <= offsets[record + 1]
                    where.append(at[inside] + begin)
                    what.append(hashes[at[inside]])
                    owner.append(record[inside])
                if not where:
                    continue
                place, value, record = map(np.concatenate, (where, what, owner))
                cut = np.flatnonzero((record[1:] != record[:-1]) | (place[1:] - place[:-1] > 2 * margin)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                    if a == b:
                        continue
                    r = int(record[a])
                    start, stop = max(int(place[a]) - margin, int(offsets[r])), min(int(place[b - 1]) + gram + margin, int(offsets[r + 1]))
                    rows.append((ids[low + r], start - int(offsets[r]), codes[start:stop].tobytes().decode("utf-32-le", "surrogatepass"), np.unique(value[a:b]).view(np.int64)))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array([list(x) for x in columns[3]], pa.list_(pa.int64()))], names=["doc_id", "begin", "text", "grams"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(scan, PASSAGE)


def seeds(items: list[tuple[int, np.ndarray]], count: dict[int, int], stretch: int, gram: int) -> dict[int, list[int]]:
    """n-gram to the numbers of the items it is a seed of: of each stretch - gram + 1 neighbours the rarest that occurs in a
    record, the leftmost of equals."""
    chosen: dict[int, set[int]] = {}
    for number, (_, hashes) in enumerate(items):
        seen = np.array([count.get(h, 0) or np.inf for h in hashes.view(np.int64).tolist()])
        width = stretch - gram + 1
        for i in range(len(hashes) - width + 1):
            best = i + int(np.argmin(seen[i : i + width]))
            if np.isfinite(seen[best]):
                chosen.setdefault(int(hashes.view(np.int64)[best]), set()).add(number)
    return {h: sorted(n) for h, n in chosen.items()}


def align(item: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score and longest common run of the item with each text; all texts advance together."""
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    row = np.zeros(int(sizes.sum()) + len(texts), dtype=np.uint32)  # 0 between texts matches nothing
    for begin, text in zip(begins, texts, strict=True):
        row[begin : begin + len(text)] = text
    apart = np.repeat(np.arange(len(texts)), sizes + 1) * (4 * MATCH * (len(item) + 1))
    slope = np.arange(len(row), dtype=np.int64) * GAP + apart  # a gap across texts costs more than any score
    score, common = np.zeros(len(row) + 1, np.int64), np.zeros(len(row) + 1, np.int64)
    best, longest = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for code in item:
        same = row == code
        step = np.maximum(score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] - GAP)
        step = np.where(row == 0, 0, np.maximum(step, 0))
        step = np.maximum(step, np.maximum.accumulate(step + slope) - slope)
        score[1:] = np.where(row == 0, 0, step)
        common[1:] = np.where(same, common[:-1] + 1, 0)
        np.maximum(best, score[1:], out=best)
        np.maximum(longest, common[1:], out=longest)
    return np.maximum.reduceat(best, begins), np.maximum.reduceat(longest, begins)


def alignments(documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM, most_items: int = MOST_ITEMS, stretch: int = STRETCH) -> DataFrame:
    """(doc_id, item_id, score, longest_run, item_chars): the best local alignment of each record with each item that it shares
    a run of at least ``stretch`` normalised characters with (at most ``run``, at least the n-gram), or an edited passage around a seed.

    Records and items with null or blank texts, and items of fewer than ``run`` characters, give no rows; of several items with
    one id each counts. Repeated records give one row per doc_id and item.
    """
    if not 1 <= gram <= run:
        raise ValueError("the n-gram must not be longer than the run")
    stretch = min(max(stretch, gram), run)
    spark = documents.sparkSession
    total = items.count()
    results = []
    for block in range(max(1, -(-total // most_items))):
        part = items if total <= most_items else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-total // most_items))) == block)
        rows = [(r.item_id, normal(r.text)) for r in part.select("item_id", "text").where("text is not null").toLocalIterator()]
        rows = sorted(((i, c) for i, c in rows if len(c) >= run), key=lambda x: (x[0], x[1].tobytes()))
        if not rows:
            continue
        hashed = [(i, grams(c, gram)) for i, c in rows]
        found = keep(passages(documents, np.concatenate([h for _, h in hashed]), gram, 2 * run + gram), "passages")
        counted = found.select("doc_id", F.explode("grams").alias("gram")).distinct().groupBy("gram").count()  # no more rows than the items' n-grams
        table = spark.sparkContext.broadcast((rows, seeds(hashed, {r["gram"]: r["count"] for r in counted.toLocalIterator()}, stretch, gram)))

        def score(batches, table=table):
            listed, start = table.value
            for batch in batches:
                wanted: dict[int, list[int]] = {}
                for i, found_grams in enumerate(batch.column("grams").to_pylist()):
                    for number in {n for g in found_grams for n in start.get(g, ())}:
                        wanted.setdefault(number, []).append(i)
                ids, texts = batch.column("doc_id").to_pylist(), {}
                out: list[tuple] = []
                for number, places in wanted.items():
                    item_id, codes = listed[number]
                    for low in range(0, len(places), 256):
                        some = places[low : low + 256]
                        for i in some:
                            if i not in texts:
                                texts[i] = np.frombuffer(batch.column("text")[i].as_py().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                        best, longest = align(codes, [texts[i] for i in some])
                        out += [(ids[i], item_id, int(s), int(n), len(codes)) for i, s, n in zip(some, best, longest, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "score", "longest_run", "item_chars"])

        results.append(found.repartition("doc_id").mapInArrow(score, "doc_id bigint, item_id bigint, score bigint, longest_run bigint, item_chars bigint"))
    if not results:
        return documents.select("doc_id", F.col("doc_id").alias("item_id"), *[F.lit(0).cast("bigint").alias(c) for c in ("score", "longest_run", "item_chars")]).limit(0)
    return reduce(DataFrame.unionByName, results).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"), F.max("item_chars").alias("item_chars"))


def found(documents: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(doc_id, item_id) of the records that share a run of at least ``run`` normalised characters with an item."""
    return alignments(documents, items, run, gram, stretch=run).where(F.col("longest_run") >= run).select("doc_id", "item_id")
