import numpy as np

from brindle.llm import neighbours as n

SCHEMA = "id string, embedding array<float>, src string"


def rows(matrix, start=0):
    return [(f"{start + i:05}", [float(x) for x in v], "z") for i, v in enumerate(matrix)]


def brute(data, k, least):
    good = {}
    for i, v, _ in data:
        if v is not None and len(v) == 64 and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    ids = sorted(good)
    m = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = np.round(m @ m.T, 6)
    out = {}
    for a in range(len(ids)):
        s[a, a] = -2
        order = [b for b in np.lexsort((np.arange(len(ids)), -s[a])) if b != a and s[a, b] >= least][:k]
        out[ids[a]] = [ids[b] for b in order]
    return out


def test_planted_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 64))
    near = base[:60] + rng.normal(size=(60, 64)) * 0.2
    data = rows(base) + rows(near * rng.uniform(0.1, 9, (60, 1)), 1000)
    data += [("n1", None, "z"), ("n2", [0.0] * 64, "z"), ("n3", [1.0] * 63, "z"), data[5], data[5], (None, [1.0] * 64, "z")]
    df = spark.createDataFrame(data, SCHEMA)
    want = {tuple(sorted((a, b))) for a, bs in brute([d for d in data if d[0]], 5, 0.9).items() for b in bs}
    assert len(want) >= 50 and {tuple(r) for r in n.found(df).collect()} == want
    assert n.found(df.where("false")).count() == 0


def test_copies_of_a_third(spark):
    rng = np.random.default_rng(2)
    data = rows(rng.normal(size=(80, 64))) + rows(np.tile(rng.normal(size=(1, 64)), (60, 1)), 500)
    want = {tuple(sorted((a, b))) for a, bs in brute(data, 5, 0.9).items() for b in bs}
    assert {tuple(r) for r in n.found(spark.createDataFrame(data, SCHEMA)).collect()} == want


def test_recall_of_graph_and_search(spark):
    rng = np.random.default_rng(3)
    data = rows(rng.normal(size=(40, 64))[rng.integers(0, 40, 900)] + rng.normal(size=(900, 64)) * 0.8)
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data, 5, -1)
    got: dict = {}
    for r in n.nearest(df, 5, tables=3).collect():
        got.setdefault(r.src, set()).add(r.dst)
    assert np.mean([len(got[i] & set(w)) / 5 for i, w in want.items()]) >= 0.9
    points = n.directions(df).select("id", "q")
    graph = n.descend(points, 10, tables=2)
    asked = points.where("cast(id as int) % 100 = 0").withColumnRenamed("id", "query")
    found: dict = {}
    for r in n.search(graph, points, asked, 6, beam=48).collect():
        found.setdefault(r["query"], set()).add(r["id"])
    assert np.mean([len(v & {i, *want[i]}) / 6 for i, v in found.items()]) >= 0.9


def cone(count, pairs, seed=5):
    """Vectors of mutual cosine of about 0.6, and after them a near one of each of the first ``pairs``."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    rest = rng.normal(size=(count, 64)) / 8
    one = base * 0.6**0.5 + rest * 0.4**0.5
    return np.concatenate([one, one[:pairs] + rng.normal(size=(pairs, 64)) / 8 * 0.4])


def test_recall_in_a_cone(spark):
    """Buckets of many times BLOCK vectors."""
    matrix = cone(60_000, 1500).astype(np.float32)
    unit = (matrix / np.linalg.norm(matrix, axis=1)[:, None]).astype(np.float32)
    want = set()
    for low in range(0, len(unit), 1000):
        a, b = np.nonzero(unit[low : low + 1000] @ unit.T >= 0.9)
        want |= {(f"{min(x, y):05}", f"{max(x, y):05}") for x, y in zip((a + low).tolist(), b.tolist(), strict=True) if x != y}
    got = {tuple(r) for r in n.found(spark.createDataFrame(rows(matrix.tolist()), SCHEMA).repartition(4)).collect()}
    recall = len(got & want) / len(want)
    print("recall", recall, "of", len(want))
    assert len(want) > 1000 and recall >= 0.985
