"""Most similar vectors for every vector by NN-descent.

1. Every vector is reduced to a direction of one byte per dimension; equal directions keep LIMIT + 1 representatives (the smallest
   ids), and any further copy has those as its neighbours, so a vector with a third of all rows costs no more.
2. Start: in each of TABLES random rotations the vectors are put into buckets by the axis they lie nearest to (cross-polytope
   hashing; for larger collections by a second, partial rotation too). A bucket of more than BLOCK vectors is split in
   SPLITS independent ways by what its vectors have besides their mean, in further rotations, until each cell fits
   (after LEVELS levels by id: then its vectors differ by no more than the bytes can tell); each cell is compared in full.
3. Rounds: neighbours of a vector, and vectors it is a neighbour of, are proposed to each other where they stand together; what is
   better than the worst link of one is sent to it, and its best ``width`` stay; only pairs with a new link are tried. The rounds end
   when few links change.
4. The links are measured exactly on the original vectors.

Lists are bounded by the method (``width`` links, as many reverse links, the closest ones). With ``floor``, links of lower cosine
do not enter the graph: for results with a least cosine, of which the way over a third vector needs only similar ones.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import counted, drop, keep

DIM, TABLES, BLOCK, LIMIT, ROUNDS, SEED = 64, 8, 4096, 5, 12, 20_011
#: Mean size of a bucket from which a second rotation splits it.
BUCKET = 2048
SPLITS, LEVELS = 6, 6
#: Links per vector and tables of the start where there is no floor: the rounds find what few tables don't.
WIDTH, START = 28, 8


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector (of ``dim`` finite numbers, not all zero), and their directions."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(sizes == dim)
    if not len(good):
        return good, np.zeros((0, dim))
    flat = column.take(pa.array(good)).flatten()
    flat = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        top = np.abs(flat).max(axis=1)
        unit = flat / top[:, None]
        unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    fine = np.isfinite(unit).all(axis=1) & (top > 0)
    return good[fine], unit[fine]


def directions(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, same, q): direction as signed bytes, and a hash of the direction to five decimals. One row per input row that
    holds a usable vector; null ids do not count."""

    def reduce(batches):
        weights = np.random.default_rng(SEED).integers(1, 1 << 62, dim, dtype=np.int64)
        for batch in batches:
            good, unit = _vectors(batch.column(1), dim)
            if not len(good):
                continue
            q = np.round(unit / np.abs(unit).max(axis=1)[:, None] * 127).astype(np.int8)
            same = (np.round(unit * 1e5).astype(np.int64) * weights).sum(axis=1)
            flat = pa.py_buffer(np.ascontiguousarray(q).tobytes())
            bytes_ = pa.Array.from_buffers(pa.binary(), len(good), [None, pa.py_buffer(np.arange(0, (len(good) + 1) * dim, dim, dtype=np.int32).tobytes()), flat])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(same), bytes_], names=["id", "same", "q"])

    return vectors.where("id is not null").select("id", "embedding").mapInArrow(reduce, "id string, same bigint, q binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows from the bytes of a binary column."""
    begin = column.offset * dim
    q = np.frombuffer(column.buffers()[2], dtype=np.int8)[begin : begin + len(column) * dim].reshape(-1, dim).astype(np.float32)
    return q / np.sqrt((q * q).sum(axis=1))[:, None]


@lru_cache(256)
def _rotation(number: int, dim: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng([SEED, number]).normal(size=(dim, dim)))
    return q.astype(np.float32)


def _axis(points: np.ndarray) -> np.ndarray:
    """The number of the nearest of the axes and their opposites."""
    at = np.abs(points).argmax(axis=1)
    return at * 2 + (points[np.arange(len(points)), at] > 0)


def _closest(matrix: np.ndarray, width: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, row and similarity of the links within one block."""
    out = []
    for low in range(0, len(matrix), 512):
        scores = matrix[low : low + 512] @ matrix.T
        scores[np.arange(len(scores)), np.arange(low, low + len(scores))] = -2
        if floor is not None:
            a, b = np.nonzero(scores >= floor)
            s = scores[a, b]
            if len(a) > width:
                order = np.lexsort((-s, a))
                a, b, s = a[order], b[order], s[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                a, b, s = a[rank < width], b[rank < width], s[rank < width]
        else:
            n = min(width, scores.shape[1] - 1)
            b = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n else np.zeros((len(scores), 0), int)
            a = np.repeat(np.arange(len(scores)), n)
            b = b.ravel()
            s = scores[a, b]
        out.append((a + low, b, s))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


LINK = "src string, dst string, sim float"


def _mixed(key: np.ndarray, *more) -> np.ndarray:
    """A 64-bit number of a cell from that of the cell it is a part of."""
    key = key.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for part in more:
            key = (key ^ (np.asarray(part).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _cells(matrix: np.ndarray, second: int, tables: int, splits: list, dim: int):
    """Rows, cells and depths. ``splits``: for each level the cells to split, sorted, and their means."""
    for t in range(tables):
        first, other = _rotation(2 * t, dim), _rotation(2 * t + 1, dim)
        key = (t * 2 * dim + _axis(matrix @ first).astype(np.int64)) * 2 * dim + (_axis(matrix @ other[:, :second]) if second else 0)
        todo = [(np.arange(len(matrix)), _mixed(key), 0, 0)]
        while todo:
            rows, key, depth, way = todo.pop()
            if depth < len(splits) and len(rows):
                known, means = splits[depth]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                large = known[at] == key
                if large.any():
                    rest, parent = rows[large], key[large]
                    points = matrix[rest] - means[at[large]]
                    for s in range(SPLITS) if depth == 0 else [way]:
                        axis = _axis(points @ _rotation(2 * tables + (t * SPLITS + s) * LEVELS + depth, dim))
                        todo.append((rest, _mixed(parent, s, axis), depth + 1, s))
                    rows, key = rows[~large], key[~large]
            if len(rows):
                yield rows, key, depth


def _splits(points: DataFrame, second: int, tables: int, dim: int) -> tuple[list, dict[int, int]]:
    """Which cells to split, and their means, level by level; into how many parts the cells are cut that no rotation splits.
    At most rows * TABLES * SPLITS / BLOCK cells a level come to the driver."""
    splits: list = []
    for depth in range(LEVELS + 1):

        def count(batches, depth=depth, splits=splits):
            total: dict[int, int] = {}
            for batch in batches:
                if batch.num_rows:
                    found = [key for _, key, at in _cells(_matrix(batch.column(0), dim), second, tables, splits, dim) if at == depth]
                    if found:
                        for key, n in zip(*map(np.ndarray.tolist, np.unique(np.concatenate(found), return_counts=True)), strict=True):
                            total[key] = total.get(key, 0) + n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["cell", "n"])

        large = {r.cell: r.n for r in points.select("q").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).collect()}
        if not large or depth == LEVELS:
            return splits, {cell: -(-n // (BLOCK // 2)) for cell, n in large.items()}
        known = np.array(sorted(large), dtype=np.int64)

        def add(batches, depth=depth, splits=splits, known=known):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                matrix = _matrix(batch.column(0), dim)
                for rows, key, at in _cells(matrix, second, tables, splits, dim):
                    if at == depth:
                        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                        rows, place = rows[known[place] == key], place[known[place] == key]
                        order = np.argsort(place, kind="stable")
                        one, begin = np.unique(place[order], return_index=True)
                        if len(one):
                            for i, row in zip(one.tolist(), np.add.reduceat(matrix[rows[order]], begin, axis=0, dtype=np.float64), strict=True):
                                total[i] = total[i] + row if i in total else row
            if total:
                flat = pa.array(np.concatenate(list(total.values())))
                yield pa.RecordBatch.from_arrays([pa.array([int(known[i]) for i in total], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), flat)], names=["cell", "x"])

        sums = points.select("q").mapInArrow(add, "cell bigint, x array<double>").groupBy("cell").agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(dim)])
        means = {r[0]: np.array(r[1:]) / large[r[0]] for r in sums.collect()}
        splits = [*splits, (known, np.stack([means[k] for k in known.tolist()]).astype(np.float32))]
    raise AssertionError


def start(points: DataFrame, count: int, width: int, floor: float | None, dim: int = DIM, tables: int = TABLES) -> DataFrame:
    """Links (src, dst, sim) between vectors that share a cell of some table."""
    second = 0  # axes of the second rotation that split a bucket
    while count / (2 * dim * max(1, 2 * second)) > BUCKET and second < dim:
        second = max(1, 2 * second)
    splits, parts_of = _splits(points, second, tables, dim)
    shared = points.sparkSession.sparkContext.broadcast((splits, parts_of))

    def place(batches):
        splits, parts_of = shared.value
        whole = np.array(sorted(parts_of), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, key, _ in _cells(_matrix(batch.column(1), dim), second, tables, splits, dim):
                if len(whole):
                    for i in np.flatnonzero(np.isin(key, whole)).tolist():
                        part = zlib.crc32(batch.column(0)[int(rows[i])].as_py().encode(), int(key[i]) & 0xFFFFFFFF) % parts_of[int(key[i])]
                        key[i] = _mixed(key[i : i + 1], part)[0]
                yield pa.RecordBatch.from_arrays([pa.array(key), *[c.take(pa.array(rows)) for c in batch.columns]], names=["bucket", "id", "q"])

    def compare(batches):
        ids, parts, now, held = [], [], None, 0

        def block():
            names = pa.concat_arrays(ids)
            a, b, s = _closest(np.concatenate(parts), width, floor)
            if len(a):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(s.astype(np.float32))], names=["src", "dst", "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column(0).to_numpy()
            matrix = _matrix(batch.column(2), dim)
            edges = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)], strict=True):
                while low < high:
                    if parts and (buckets[low] != now or held >= BLOCK):
                        yield from block()
                        ids, parts, held = [], [], 0
                    take = min(high - low, BLOCK - held)
                    ids.append(batch.column(1).slice(low, take))
                    parts.append(matrix[low : low + take])
                    now, held, low = buckets[low], held + take, low + take
        if parts:
            yield from block()

    placed = points.select("id", "q").mapInArrow(place, "bucket bigint, id string, q binary")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(compare, LINK)


def _best(links: DataFrame, width: int) -> DataFrame:
    """The ``width`` most similar links of each src; of links between two vectors an old one counts."""
    one = links.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst"))
    return one.withColumn("_r", rank).where(F.col("_r") <= width).drop("_r")


def _tried(around: DataFrame, floor: float | None, dim: int) -> DataFrame:
    """Links (src, dst, sim) between the neighbours (n, dst, new, worst, q) of each n: of pairs with a new neighbour those that are
    better than the worst link that ``src`` has. The neighbours of one n, at most twice the width, stand together."""
    least = -2.0 if floor is None else floor

    def compare(batches):
        held = None

        def block(part):
            n, dst, new, worst = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            matrix, (src, to, sims) = _matrix(part.column(4), dim), ([], [], [])
            edges = np.flatnonzero(n[1:] != n[:-1]) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(n)], strict=True):
                fresh = new[low:high] > 0
                if high - low < 2 or not fresh.any():
                    continue
                s = matrix[low:high] @ matrix[low:high].T
                good = (s > np.maximum(worst[low:high], least - 1e-9)[:, None]) & (fresh[:, None] | fresh[None, :])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                if len(i):
                    src.append(dst[low + i])
                    to.append(dst[low + j])
                    sims.append(s[i, j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(to)), pa.array(np.concatenate(sims).astype(np.float32))], names=["src", "dst", "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            n = whole.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(n, n[-1]))  # the last n may go on in the next batch
            yield from block(whole.slice(0, last)) if last else ()
            held = whole.slice(last)
        if held is not None:
            yield from block(held)

    rows = around.select("n", "dst", "new", "worst", "q").repartition("n").sortWithinPartitions("n")
    return rows.mapInArrow(compare, "src bigint, dst bigint, sim float")


def descend(points: DataFrame, width: int, floor: float | None = None, dim: int = DIM, tables: int = TABLES, rounds: int = ROUNDS, change: float = 0.001) -> DataFrame:
    """The neighbour graph (src, dst, sim, new) of the points (id, q), ids unique. ``rounds`` bounds the rounds, which end earlier when
    less than ``change`` of the links are new."""
    numbered = keep(points.select(F.monotonically_increasing_id().alias("n"), "id", "q"), "points")
    count = numbered.count()
    begun = start(numbered.select(F.col("n").cast("string").alias("id"), "q"), count, width, floor, dim, tables)
    begun = begun.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "sim").withColumn("new", F.lit(1))
    graph = keep(_best(begun, width), "graph")
    for _ in range(rounds):
        worst = graph.groupBy(F.col("src").alias("dst")).agg(F.when(F.count("*") >= width, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "new")
        near = F.row_number().over(Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst"))
        both = graph.unionByName(back.withColumn("_r", near).where(F.col("_r") <= width).drop("_r")).groupBy("src", "dst").agg(F.max("new").alias("new"))
        around = both.select(F.col("src").alias("n"), "dst", "new").join(worst, "dst", "left").join(numbered.select(F.col("n").alias("dst"), "q"), "dst").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
        fresh = _tried(around, floor, dim).groupBy("src", "dst").agg(F.max("sim").alias("sim")).join(graph.select("src", "dst"), ["src", "dst"], "left_anti")
        grown, seen = counted(_best(graph.withColumn("new", F.lit(0)).unionByName(fresh.withColumn("new", F.lit(1))), width), "graph", new=F.count_if(F.col("new") == 1))
        drop(graph)
        graph = grown
        if seen.new <= change * width * count:
            break
    names = numbered.select("n", "id")
    return graph.join(names.select(F.col("n").alias("src"), F.col("id").alias("_a")), "src").join(names.select(F.col("n").alias("dst"), F.col("id").alias("_b")), "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "sim", "new")


def exact(links: DataFrame, vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(src, dst, cosine), both ways, of the links on the original vectors, rounded to six decimals."""
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    pairs = keep(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = keep(vectors.where(F.size("embedding") == dim).select("id", "embedding").join(ends, "id", "left_semi").dropDuplicates(["id"]), "ends")

    def cosine(batches):
        for batch in batches:
            a, left = _vectors(batch.column(2), dim)
            b, right = _vectors(batch.column(3), dim)
            if len(a):
                c = np.round((left * right).sum(axis=1), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], names=["a", "b", "cosine"])

    both = pairs.join(full.select(F.col("id").alias("a"), F.col("embedding").alias("ea")), "a").join(full.select(F.col("id").alias("b"), F.col("embedding").alias("eb")), "b")
    one = both.select("a", "b", "ea", "eb").mapInArrow(cosine, "a string, b string, cosine double")
    return one.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "cosine"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "cosine"))).alias("l")).select("l.*")


def nearest(vectors: DataFrame, k: int = LIMIT, least: float | None = None, dim: int = DIM, tables: int = TABLES, slack: float = 0.15, width: int | None = None) -> DataFrame:
    """(src, dst, cosine, rank): the k most similar vectors of each, ties by id; with ``least`` only those of at least that cosine.

    Vectors count once per id; null, zero, non-finite and other-length vectors have no neighbours. Links below least - slack are
    not followed.
    """
    seen = keep(directions(vectors, dim).groupBy("same", "id").agg(F.first("q").alias("q")), "directions")
    order = F.row_number().over(Window.partitionBy("same").orderBy("id"))
    chosen = keep(seen.withColumn("_r", order).where(F.col("_r") <= k + 1), "representatives")
    points = chosen.select("id", "q").dropDuplicates(["id"])
    graph = descend(points, width or 2 * k, None if least is None else least - slack, dim, tables)
    links = graph.select("src", "dst") if least is None else graph.where(F.col("sim") >= least - 0.02).select("src", "dst")
    scored = exact(links, vectors, dim)
    if least is not None:
        scored = scored.where(F.col("cosine") >= least)
    # copies beyond the representatives: the first k representatives are their neighbours
    crowd = chosen.where(F.col("_r") == k + 1).select("same")
    others = seen.join(crowd, "same", "left_semi").join(chosen.select("same", "id"), ["same", "id"], "left_anti").select("same", F.col("id").alias("src"))
    copies = others.join(chosen.where(F.col("_r") <= k).select("same", F.col("id").alias("dst")), "same").select("src", "dst", F.lit(1.0).alias("cosine"))
    ranked = F.row_number().over(Window.partitionBy("src").orderBy(F.col("cosine").desc(), "dst"))
    return scored.unionByName(copies).withColumn("rank", ranked).where(F.col("rank") <= k)


def found(vectors: DataFrame, k: int = LIMIT, least: float = 0.9, dim: int = DIM) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of cosine ``least`` or more of which one is among the other's k most similar."""
    return nearest(vectors, k, least, dim).select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b")).distinct()


def of_queries(vectors: DataFrame, k: int = LIMIT, width: int = WIDTH, part: int = 100, dim: int = DIM) -> DataFrame:
    """(id, other, cosine, rank): the k most similar vectors of those whose id, a number, is divisible by ``part``, out of the graph of
    all vectors."""
    rows = nearest(vectors, k, None, dim, START, width=width)
    return rows.where(F.expr(f"try_cast(src as decimal(38, 0)) % {part} = 0")).select(F.col("src").alias("id"), F.col("dst").alias("other"), "cosine", "rank")


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int = LIMIT, beam: int = 32, entries: int = 256, steps: int = 8, dim: int = DIM) -> DataFrame:
    """(query, id, sim, rank): greedy search of all queries (query, q) together over a graph (src, dst) of the points (id, q).

    Each query starts at the same ``entries`` points of smallest id hash, and in each step looks at the neighbours of its best ``beam``
    points that it has not looked from yet; it ends when no query finds better ones.
    """
    ask = queries.select(F.col("query").alias("a"), F.col("q").alias("qa"))
    edges = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def dot(batches):
        for batch in batches:
            if batch.num_rows:
                s = (_matrix(batch.column(2), dim) * _matrix(batch.column(3), dim)).sum(axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["query", "id", "sim"])

    def score(pairs: DataFrame) -> DataFrame:
        full = pairs.join(ask, pairs["query"] == ask["a"]).join(points.select(F.col("id").alias("b"), F.col("q").alias("qb")), F.col("id") == F.col("b"))
        return full.select("query", "id", "qa", "qb").mapInArrow(dot, "query string, id string, sim float")

    first = [r.id for r in points.select("id").orderBy(F.xxhash64("id"), "id").limit(entries).collect()]
    state = keep(score(queries.select("query", F.explode(F.array(*map(F.lit, first))).alias("id"))).withColumn("open", F.lit(1)), "beam")
    by = Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")
    for _ in range(steps):
        fresh = state.where("open = 1").join(edges, state["id"] == edges["src"]).select("query", F.col("dst").alias("id")).distinct().join(state.select("query", "id"), ["query", "id"], "left_anti")
        grown = state.withColumn("open", F.lit(0)).unionByName(score(fresh).withColumn("open", F.lit(1)))
        state = keep(grown.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= beam).drop("_r"), "beam")
        if not state.where("open = 1").count():
            break
    return state.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query", "id", "sim", "rank")


def searched(vectors: DataFrame, asked: Column, k: int = LIMIT, width: int = WIDTH, dim: int = DIM) -> DataFrame:
    """(id, other, sim, rank): for the vectors that ``asked`` holds for the k most similar others, found by ``search`` in the graph of
    all vectors."""
    points = keep(directions(vectors, dim).groupBy("id").agg(F.first("q").alias("q")), "points")
    graph = keep(descend(points, width, None, dim, START).select("src", "dst"), "searched")
    found = search(graph, points, points.where(asked).withColumnRenamed("id", "query"), k + 1, dim=dim).where("query <> id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("sim").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("id"), F.col("id").alias("other"), F.round("sim", 4).alias("sim"), "rank")
