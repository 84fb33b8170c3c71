"""Components against a plain union-find."""

import random

from freshet.llm.graph import components


def plain(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_random_links_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    chain = list(range(1000, 1300))
    rng.shuffle(chain)
    edges += list(zip(chain, chain[1:], strict=False)) + [(5000, x) for x in range(5001, 5100)] + [(7, 7), (None, 3), (4, None)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    assert {r["node"]: r["component"] for r in components(df).collect()} == plain(edges)
    # A few rounds join only what is connected.
    whole = plain(edges)
    part = {r["node"]: r["component"] for r in components(df, rounds=1).collect()}
    assert set(part) == set(whole) and all(whole[c] == whole[n] for n, c in part.items())
    assert components(df.limit(0)).count() == 0
