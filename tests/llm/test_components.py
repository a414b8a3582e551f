import numpy as np

from tracewalk.llm.components import connected_components, forest


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_agree_with_union_find(spark):
    rng = np.random.default_rng(1)
    links = [tuple(map(int, x)) for x in rng.integers(0, 600, (400, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)] + [(-9, -8), (3, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == brute([x for x in links if x[0] != x[1]])


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans():
    a, b = np.array([1, 2, 3, 1, 7]), np.array([2, 3, 1, 3, 8])
    assert forest(a, b).tolist() == [True, True, False, False, True]
