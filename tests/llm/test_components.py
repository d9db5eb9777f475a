import random

import pytest

from tidemark.llm.shared import connected_components


def brute(edges):
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return sorted((k, find(k)) for k in root)


@pytest.mark.parametrize("kind", ["none", "path", "star", "random"])
def test_components(spark, kind):
    r = random.Random(2)
    edges = {
        "none": [(None, 1), (3, 3)],
        "path": [(k, k + 1) for k in range(200)],
        "star": [(999, k) for k in range(300)] * 2,
        "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)],
    }[kind]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((x.node, x.component) for x in got) == brute(edges)
