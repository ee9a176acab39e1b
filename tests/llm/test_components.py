import random
from pagesift.llm.common import components


def test_components_from_labels_found_before(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    more = [(rng.randrange(500), rng.randrange(500)) for _ in range(60)]

    def frame(e):
        return spark.createDataFrame(e, "a long, b long")

    def brute(e):
        root = {}
        for x, y in e:
            root.setdefault(x, x), root.setdefault(y, y)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in e:
            a, b = sorted((find(x), find(y)))
            root[b] = a
        return {x: find(x) for x in root}
    first = components(frame(edges))
    loops = {x for x, y in edges + more if x == y}
    want = brute(edges + more)
    got = {r["node"]: r["label"] for r in components(frame(more), start=first).collect()}
    assert {k: v for k, v in got.items() if k not in loops} == {k: want[k] for k in got if k not in loops}
    part = {r["node"]: r["label"] for r in components(frame(edges + more), rounds=1).collect()}
    assert all(want[x] == want[label] for x, label in part.items())
    again = components(frame(edges + more), start=spark.createDataFrame(list(part.items()), "node long, label long"))
    assert {r["node"]: r["label"] for r in again.collect() if r["node"] in part} == {k: want[k] for k in part}
    assert components(frame([]), start=first).count() == first.count()
