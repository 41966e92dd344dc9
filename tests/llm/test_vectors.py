"""Filters against brute force."""

import numpy as np

from ohlcraft.llm import vectors
from ohlcraft.llm.graph import components


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    link = np.zeros((len(good), len(good)), bool)
    for a, (_, x) in enumerate(good):
        for b, (_, y) in enumerate(good):
            link[a, b] = a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= vectors.COSINE
    root = vectors.smallest_linked(link[np.ix_(*[np.argsort([i for i, _ in good], kind="stable")] * 2)])
    ids = sorted(i for i, _ in good)
    return {i: (int(link[a].sum()), None) for a, (i, _) in enumerate(good)}, {i: ids[r] for i, r in zip(ids, root, strict=True)}


def test_links_and_components(spark):
    draws = np.random.default_rng(0)
    rows = [(i, draws.standard_normal(24).tolist()) for i in range(150)]
    near = draws.standard_normal(24)
    rows += [(200 + i, (near + 0.12 * draws.standard_normal(24)).tolist()) for i in range(320)]  # more than one block
    rows += [(600 + i, rows[3][1]) for i in range(9)] + [(700, (2 * np.array(rows[5][1])).tolist())]
    bad = [(800, None), (801, []), (802, [0.0] * 24), (803, [float("nan")] * 24), (804, [None] + [1.0] * 23), (805, [1.0, 0.0]), (806, [1.0, 0.01]), (807, [3.0]), (None, rows[3][1])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in vectors.near_duplicates(docs).collect()}
    links, roots = brute(rows + bad)
    assert len(out) == len(rows) + len(bad)
    right = sum(out[i].n_links == links[i][0] for i in links)
    assert right >= 0.98 * len(links) and sum(out[i].n_links for i in links) >= 0.99 * sum(n for n, _ in links.values())
    assert all(out[i].n_links <= links[i][0] for i in links)
    assert sum(out[i].component_id == roots[i] for i in links) >= 0.98 * len(links)
    for i in (800, 801, 802, 803, 804):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert (out[None].n_links, out[None].component_id, out[None].kept) == (0, None, False)
    assert vectors.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    draws = np.random.default_rng(1)
    edges = [(int(a), int(a) + 1) for a in range(200)] + [(int(a), int(b)) for a, b in draws.integers(1000, 1400, (150, 2))] + [(5000, 5001), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
