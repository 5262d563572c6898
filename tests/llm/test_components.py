import random

from tidemark.llm.common import Scratch
from tidemark.llm.components import components


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (2000, 2001), (2001, 2000)]
    edges += [(r.randrange(3000, 3200), r.randrange(3000, 3200)) for _ in range(150)]
    r.shuffle(edges)
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    scratch = Scratch(spark, "test")
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), scratch).collect() == []
