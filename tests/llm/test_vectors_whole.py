"""Vectors whose links the neighbour lists have no room for, or that the graph has missed."""

import numpy as np
import pytest

from pitwise.llm import nndescent
from tests.llm.brute import components


def brute(rows, threshold=0.98):
    x = np.array([v for _, v, _ in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    label = np.array([k for *_, k in rows])
    near = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [i for i, *_ in rows]
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    return {i: (int(n), comp[i], comp[i] == i) for i, n in zip(ids, near.sum(axis=1), strict=True)}


def told(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")


def clumps(rng, shift, count, start, label, size=64):
    """Two clumps: cosines about 0.995 within, lower across."""
    a = rng.standard_normal(size)
    a /= np.linalg.norm(a)
    off = rng.standard_normal(size)
    off -= (off @ a) * a
    off *= shift / np.linalg.norm(off)
    rows = []
    for i in range(2 * count):
        noise = rng.standard_normal(size)
        rows.append((start + i, (a if i % 2 else a + off) + 0.07 * noise / np.linalg.norm(noise), label))
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_linked_clumps_that_fill_their_lists(spark, monkeypatch, block):
    monkeypatch.setattr(nndescent, "BLOCK", block)
    rng = np.random.default_rng(11)
    rows = clumps(rng, 0.155, 40, 0, 0) + clumps(rng, 0.155, 40, 1000, 1) + clumps(rng, 0.6, 30, 2000, 0)
    rows += [(3000 + i, rows[i][1], 0) for i in range(5)]        # copies
    want = brute(rows)
    assert want[1][1:] == (0, False) and want[0][0] > 45         # the first two clumps are one component
    assert told(nndescent.link_vectors(frame(spark, rows))) == want


def sparse(rng, nodes, pairs):
    """Vectors far from each other, of which few have a near copy."""
    base = rng.standard_normal((nodes, 32))
    rows = [(i, v, i % 2) for i, v in enumerate(base)]
    return rows + [(10_000 + i, base[i] + 0.01 * rng.standard_normal(32), i % 2) for i in range(pairs)]


def test_links_that_the_graph_misses_are_noticed(spark, monkeypatch):
    rows = sparse(np.random.default_rng(12), 3000, 12)           # most queries have no link
    monkeypatch.setattr(nndescent, "ordered_neighbours", lambda nodes, seeds, keep=8: nodes.sparkSession.createDataFrame([], nndescent.EDGES))
    monkeypatch.setattr(nndescent, "MORE", 0)
    out, recall = nndescent.audited_links(frame(spark, rows))
    assert recall >= nndescent.RECALL
    assert told(out) == brute(rows)


def test_audit_counts_direct_links(spark):
    rows = sparse(np.random.default_rng(13), 1500, 20)
    nodes = nndescent.cut(nndescent.nodes_of(frame(spark, rows), "vec_id", "label", "embedding"))
    pairs = [(i, 10_000 + i) for i in range(20)]
    classes = spark.createDataFrame([(x, a) for a, b in pairs for x in (a, b)], "node long, component long")
    count = spark.createDataFrame([(x, 1) for a, b in pairs[:15] for x in (a, b)], "id long, n long")
    recall, missing = nndescent.audit(nodes, classes, count, 0.98)
    assert recall == pytest.approx(0.75) and missing.count() == 0     # in one component, but not counted
    recall, missing = nndescent.audit(nodes, classes.where("component < 10"), count.where("id % 10000 < 10"), 0.98)
    assert recall == pytest.approx(0.5) and {(r.u, r.v) for r in missing.collect()} == {p for a, b in pairs[10:] for p in ((a, b), (b, a))}


def test_repeated_ids_and_other_columns(spark):
    """One row per row: ids may repeat with other vectors; columns with the names used inside do not matter."""
    e = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(1, e[0], "a"), (1, e[1], "a"), (1, e[0], "a"), (2, e[0], "a"), (3, e[1], "a"), (4, e[2], "a"), (4, e[2], "b"), (5, e[2], "b"),
            (5, None, "b"), (None, e[2], "b"), (None, None, None), (6, [], "a"), (7, e[2], "b")]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, -1, -2, "x", 0.5) for r in rows],
                                   f"vec_id int, embedding array<{kind}>, label string, id int, node int, vec string, s double")
        out = nndescent.link_vectors(df)
        assert dict(out.dtypes) == {"vec_id": "int", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
        got = sorted((tuple(r) for r in out.collect()), key=str)
        want = [(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 2, 4, True),
                (5, 2, 4, False), (5, 0, 5, True), (None, 0, None, None), (None, 0, None, None), (6, 0, 6, True), (7, 2, 4, False)]
        assert got == sorted(want, key=str)


def test_full_lists_grow(spark):
    """Of 40 mutual near copies and some strangers: lists of 8 are full of links, and grow until they hold a stranger or 32 links."""
    rng = np.random.default_rng(14)
    base = rng.standard_normal((30, 32))
    rows = [(i, v, 0) for i, v in enumerate(base)]
    rows += [(100 + i, base[0] + 0.01 * rng.standard_normal(32), 0) for i in range(40)]
    rows += [(200 + i, base[1] + 0.01 * rng.standard_normal(32), 0) for i in range(12)]
    nodes = nndescent.cut(nndescent.nodes_of(frame(spark, rows), "vec_id", "label", "embedding"))
    graph = nndescent.refine(nodes, nndescent.cut(nndescent._best(nndescent.ordered_neighbours(nodes, [0, 1, 2, 3]), 8)))
    assert {n for (n,) in graph.groupBy("u").count().select("count").distinct().collect()} == {8}
    grown = nndescent.enlarge(nodes, graph, 0.98)
    size = {r.u: (r.n, r.worst) for r in grown.selectExpr("u", "s").groupBy("u").agg({"s": "min", "u": "count"}).toDF("u", "worst", "n").collect()}
    assert all(size[100 + i][0] == 32 and size[100 + i][1] >= 0.98 for i in range(40))
    assert all(size[200 + i][0] == 16 and size[200 + i][1] < 0.98 for i in range(12))
    assert all(size[i][0] == 8 for i in range(2, 30))
    assert told(nndescent.link_vectors(frame(spark, rows))) == brute(rows)
