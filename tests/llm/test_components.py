import random

import pytest

from docsieve.llm.components import connected
from docsieve.llm.shared import Workspace

RANDOM = random.Random(1)
CASES = {
    "path and hub": [(i, i + 1) for i in range(30)] + [(100, 0), (100, 100)] + [(200, i) for i in range(201, 1500)],
    "loop only": [(5, 5)],
    "random with a hub": [(RANDOM.randrange(10**6), RANDOM.randrange(10**6)) for _ in range(2000)] + [(7, 7 + i * 3) for i in range(2000)],
}


@pytest.mark.parametrize("case", CASES)
def test_like_union_find(spark, case):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in CASES[case]:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    edges = spark.createDataFrame([*CASES[case], (None, 3)], "a long, b long")
    got = connected(edges, Workspace(spark, "test")).collect()
    assert len(got) == len(parent) and {r.node: r.root for r in got} == {x: find(x) for x in list(parent)}
