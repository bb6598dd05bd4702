import random

from riskframe.llm.components import connected_components


def reference(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def found(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    rows = connected_components(df).collect()
    out = {r.node: r.component for r in rows}
    assert len(out) == len(rows)
    return out


def test_chain_star_and_random(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1100)]
    loose = [tuple(rng.sample(range(2000, 2100), 2)) for _ in range(60)]
    links = chain + star + loose
    assert found(spark, links + [(b, a) for a, b in links[:20]]) == reference(links)


def test_no_links_loops_and_nulls(spark):
    assert found(spark, [(5, 5), (None, 3), (4, None)]) == {}
    assert found(spark, [(7, 2), (2, 7), (7, 7)]) == {2: 2, 7: 2}
