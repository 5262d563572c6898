import math
import random

from pyspark.sql import functions as F

import tidemark.llm.topk as m

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def brute(rows, k=5, scale=256):
    use = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        z = [math.floor(scale * x) for x in v]
        use[i] = min(use.get(i, z), z)
    out = []
    for q in use:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(use[q], v, strict=False)), i) for i, v in use.items() if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "s", 1) for i, v in rows], SCHEMA)
    return sorted(map(tuple, m.exact_topk(df, F.col("vec_id") % 50 == 0).collect()))


def made(n, d, seed):
    r = random.Random(seed)
    exact = lambda x: round(x * 1024) / 1024  # noqa: E731  floats that hold exactly
    rows = [(i, [exact(r.gauss(0, 1 + (i % 7 == 0)) * (3 if j < 3 else 0.3)) for j in range(d)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]
    return rows


def test_matches_brute_force(spark):
    rows = made(900, 16, 1)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_and_groups(spark, monkeypatch):
    for name, v in (("BLOCK", 32), ("STEP", 8), ("HEAD", 20), ("QUERIES", 3), ("GROUP", 2)):
        monkeypatch.setattr(m, name, v)
    rows = made(400, 8, 2)
    assert run(spark, rows) == brute(rows)
    # Without room for the queries in every task they meet the data in the grid.
    monkeypatch.setattr(m, "RESIDENT", 0)
    rows += [(10_000, [3.0e6, -2.5e6, 1.0]), (10_001, [1.0e7])]
    assert run(spark, rows) == brute(rows)


def test_widths_of_blocks():
    for x in ([[0]], [[32767, -5]], [[40000]], [[-(2**40), 1]], [[2**62]]):
        x = m.np.array(x, m.np.int64)
        data = m._narrow(x)
        assert (m._wide(data, x.shape[1]) == x).all() and data[0] in (2, 4, 8)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [-1.0, 0.5]), (6, [1.0]), (7, [1.0]), (7, [0.5]), (50, [0.0, 0.0]), (8, [])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0])]) == []
    assert run(spark, [(1, [1.0])]) == []
