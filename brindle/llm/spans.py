"""Long exact spans shared between records.

Every window of SPAN code points holds one anchor, the GRAM of smallest hash inside it, and consecutive windows with the
same anchor form a run; copies of a window have copies of its anchor wherever they stand. So

1. one pass over the texts writes the runs (anchor, hash of the whole run, place, number of windows);
2. a Count-min sketch of the anchors (once per record) is filled per map task and merged by addition. It has CELLS cells a row for
   each anchor counted and stays a table of its cells in use, so its load is the same at every size and no task holds it. Runs
   are looked up in the cells counted at least twice, one row of the sketch after the other; it overestimates only, so an anchor
   that two records share always passes;
3. the runs that pass are grouped exactly: equal runs of different records are shared whole; of anchors with several kinds of run,
   single windows are compared by hash, for which one run of each kind is cut out of its text;
4. the union of the shared windows of a record gives its number of shared code points.

"In another record" is decided by the smallest and largest record of a group, so groups of any size combine before the
shuffle and no pairs are formed. Windows are equal if their 64-bit hashes and those of their anchors are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .rolling import Prefix, code_points, row_blocks, runs, slices, sliding_min

SPAN, GRAM = 200, 100
#: Rows of the sketch, and cells of a row for each anchor counted: of the anchors of one record about (1/CELLS)**ROWS pass by chance.
ROWS, CELLS = 2, 32


def anchored(codes: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """For each slice of the records: prefix hashes, anchor, record number, first window and end of each run, and the slice's begin."""
    for first, last, begin, end in slices(offsets, span):
        if end - begin < span:
            continue
        prefix = Prefix(codes[begin:end])
        least = sliding_min(prefix.windows(gram), span - gram + 1)
        n = len(least)
        starts = np.maximum(offsets[first:last] - begin, 0)
        ends = np.minimum(offsets[first + 1 : last + 1] - begin, end - begin)
        long = ends - starts >= span
        starts, ends, records = starts[long], ends[long] - span + 1, np.arange(first, last)[long]
        if not len(starts):
            continue
        breaks = np.zeros(n + 1, dtype=bool)
        breaks[starts] = breaks[ends] = True
        a, b = runs(least, breaks[:n])
        owner = np.searchsorted(starts, a, side="right") - 1
        inside = (owner >= 0) & (a < ends[owner])
        a, b, owner = a[inside], b[inside], owner[inside]
        yield prefix, least[a], records[owner], a, b, begin


RUNS = "anchor bigint, whole bigint, doc_id bigint, begin bigint, n bigint, fresh boolean"


def all_runs(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """The runs of all texts; ``fresh`` marks one run of each anchor of a record (of each piece of a very long record)."""

    def emit(batches):
        for names, row, text in ((batch.column(0), row, text) for batch in batches for row, text in row_blocks(batch.column(1))):
            ids = names.slice(row, len(text)).to_numpy(zero_copy_only=False)
            codes, offsets = code_points(text)
            for prefix, anchors, records, a, b, begin in anchored(codes, offsets, span, gram):
                order = np.lexsort((anchors, records))
                fresh = np.ones(len(anchors), dtype=bool)
                fresh[order[1:]] = (anchors[order[1:]] != anchors[order[:-1]]) | (records[order[1:]] != records[order[:-1]])
                whole = prefix.ranges(a, b + span - 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[records]), pa.array(begin + a - offsets[records]), pa.array(b - a), pa.array(fresh)], names=["anchor", "whole", "doc_id", "begin", "n", "fresh"])

    return texts.select("doc_id", "text").where(F.char_length("text") >= span).mapInArrow(emit, RUNS)


def cell(row: int, width: int) -> F.Column:
    """The cell of an anchor in a row of the sketch; the rows follow each other."""
    return F.pmod(F.xxhash64("anchor", F.lit(row)), F.lit(width)) + F.lit(row * width)


def sketch(runs: DataFrame, width: int) -> DataFrame:
    """(cell, n): the counts of the anchors, once per record, in ROWS rows of ``width`` cells. Sketches of parts add up."""
    return runs.where("fresh").select(F.explode(F.array(*[cell(row, width) for row in range(ROWS)])).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def passing(runs: DataFrame, width: int) -> DataFrame:
    """The runs whose anchor is estimated to occur at least twice."""
    twice = sketch(runs, width).where("n >= 2").select("cell")
    out = runs.drop("fresh")
    for row in range(ROWS):
        out = out.withColumn("cell", cell(row, width)).join(twice, "cell", "left_semi").drop("cell")
    return out


def windows(pieces: DataFrame, span: int) -> DataFrame:
    """(anchor, whole, n, low, high, at, window): the hash of each window of the pieces (anchor, whole, n, low, high, piece)."""

    def hashes(batches):
        for batch in batches:
            for row, text in row_blocks(batch.column(5)):
                codes, offsets = code_points(text)
                for first, last, begin, end in slices(offsets, span):
                    every = Prefix(codes[begin:end]).windows(span)
                    starts = offsets[first:last] - begin
                    size = np.maximum(offsets[first + 1 : last + 1] - offsets[first:last] - span + 1, 0)
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    of = pa.array(np.repeat(np.arange(row + first, row + last), size))
                    yield pa.RecordBatch.from_arrays([*[c.take(of) for c in batch.columns[:5]], pa.array(at), pa.array(every[np.repeat(starts, size) + at].view(np.int64))], names=["anchor", "whole", "n", "low", "high", "at", "window"])

    return pieces.select("anchor", "whole", "n", "low", "high", "piece").mapInArrow(hashes, "anchor bigint, whole bigint, n bigint, low bigint, high bigint, at bigint, window bigint")


def shared_windows(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, begin, n): stretches of n windows from begin (code point) that also occur in another record."""
    texts = documents.select("doc_id", "text")
    every = keep(all_runs(texts, span, gram), "all-runs")
    found = keep(passing(every, max(1, CELLS * every.count())), "runs")
    kinds = found.groupBy("anchor", "whole", "n").agg(F.min(F.struct("doc_id", "begin")).alias("one"), F.max("doc_id").alias("high"))
    kinds = keep(kinds.select("anchor", "whole", "n", F.col("one.doc_id").alias("low"), F.col("one.begin").alias("begin"), "high"), "kinds")
    full = found.select("anchor", "whole", "n", "doc_id", "begin").join(kinds.where("low < high").select("anchor", "whole", "n"), ["anchor", "whole", "n"], "left_semi").select("doc_id", "begin", "n")
    # windows of anchors with several kinds of run; whether another record has one is known from the extremes alone
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    cut = kinds.join(several, "anchor", "left_semi").join(texts.select(F.col("doc_id").alias("low"), "text"), "low")
    cut = cut.select("anchor", "whole", "n", "low", "high", F.substr("text", (F.col("begin") + 1).cast("int"), (F.col("n") + (span - 1)).cast("int")).alias("piece"))
    mixed = keep(windows(cut, span), "windows")
    twice = mixed.groupBy("anchor", "window").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("anchor", "window")
    parts = mixed.where("low = high").join(twice, ["anchor", "window"], "left_semi").select("anchor", "whole", "n", "at")
    # a run of one record may stand in it several times
    places = found.select("anchor", "whole", "n", "doc_id", "begin").join(parts, ["anchor", "whole", "n"]).select("doc_id", (F.col("begin") + F.col("at")).alias("begin"), F.lit(1).cast("bigint").alias("n"))
    return full.unionByName(places)


def found(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, shared_chars): the code points of each record that lie in a span of at least ``span`` code points which also
    occurs in another record. doc_id is unique; null and short texts share nothing; other columns are ignored."""
    pieces = shared_windows(documents, span, gram).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", F.expr(f"begin + n + {span - 1}").alias("end")))).alias("spans"))
    covered = F.expr("aggregate(spans, named_struct('upto', 0L, 'total', 0L), (s, x) -> named_struct('upto', greatest(s.upto, x.end), 'total', s.total + greatest(0L, x.end - greatest(s.upto, x.begin))), s -> s.total)")
    return pieces.select("doc_id", covered.alias("shared_chars"))
