import numpy as np
import pytest

from tessera.llm.vector_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, node string, label int"


def rows():
    r = np.random.default_rng(1)
    out = []
    for c in range(25):
        base = r.normal(size=16)
        for _ in range(r.integers(1, 15)):
            out.append((base + r.normal(size=16) * r.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist())
    out = [(i, v, None, c) for i, (c, v) in enumerate(zip(range(len(out)), out))]
    n = len(out)
    out += [(n, out[0][1], None, 1), (n, out[0][1], None, 1), (n + 1, [x * 2 for x in out[3][1]], "x", None), (n + 2, None, None, None), (n + 3, [0.0] * 16, None, 1)]
    out += [(n + 4, [1.0, None] + [0.0] * 14, None, 1), (n + 5, [float("nan")] + [1.0] * 15, None, 1), (n + 6, [float("inf")] * 16, None, 1), (n + 7, [], None, 1), (n + 8, [1.0, 2.0], None, 1), (n + 9, [1.0, 2.01], None, 1)]
    return out + [(None, out[5][1], None, 0), (n + 10, [1e-30] * 16, None, 1), (n + 11, [1e30] * 16, None, 1)]


def expected(data):
    vs = []
    for _, v, *_ in data:
        a = None if v is None or None in v or not len(v) else np.array(v, np.float32).astype(float)
        vs.append(None if a is None or not np.isfinite(a).all() or not a.any() else a)
    n = len(data)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j]):
                link[i, j] = vs[i] @ vs[j] / (np.linalg.norm(vs[i]) * np.linalg.norm(vs[j])) >= 0.95
    reach = link | np.eye(n, dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    out = []
    for i in range(n):
        ids = [data[j][0] for j in np.flatnonzero(reach[i]) if data[j][0] is not None]
        low = min(ids) if ids else None
        out.append((data[i][0], int(link[i].sum()), low, data[i][0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [4096, 20])
def test_against_brute_force(spark, tile):
    data = rows()
    got = near_vectors(spark.createDataFrame(data, SCHEMA).repartition(3), tile=tile).collect()
    assert sorted((tuple(x) for x in got), key=str) == expected(data)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
