"""Near-duplicate vectors by NN-descent.

Equal vectors of one label are one node with a weight.  A neighbour graph begins
with lists from a few random-hyperplane orders (rows that are close in an order
are compared in blocks) and is refined by rounds of neighbours-of-neighbours
joins: every node's neighbours, both ways, meet at the node and are compared
with each other there, and each keeps its best ``LIST``.  From the second round on,
only nodes at which something changed are met at.  Rounds end when hardly any
list changes.

A list that is full of links is saturated: it gets twice the room, and its node
meets its neighbours' neighbours again, until the list holds a neighbour below
the threshold or ``WIDEST`` of them.  There may still be more, also to nodes
that no list leads to.  So all nodes that have any link are then compared block
by block with each other and with all such nodes of their label (each pair of
blocks in one place; counts come back, and one link for two components that turn
out to be one), without emitting their pairs.  A pair of blocks is skipped only
if their centres and radii rule out a link.

The links counted are audited: sampled nodes, as many as it takes to see a
stated number of links, are compared with all rows.  Links that turn out to be
missing are added; below the goal, more orders and rounds follow, and then all
nodes of a label are compared.

Cosines are in double precision; vectors of floats travel as floats.  Defined
cases: vectors that are null, empty or zero, have null, non-finite or missing
components, or whose label or id is null link with nothing; repeated rows of one
id, with equal or different vectors, are one vector and one result row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.llm.components import connected_components
from pitwise.llm.storage import cut, small

THRESHOLD = 0.98
LIST = 8
WIDEST = 32                      # entries of the largest list; blocks find what is beyond
ORDERS = 4
ROUNDS = 4
NEAR = 192                       # rows of an order that are compared with each other
MEET = 128                       # members of a node that are compared with each other
BLOCK = 512                      # rows of a block in saturated groups
WHOLE = 8 * BLOCK                # rows that no block reaches (blocks are cut by hash)
PACK = 1024                      # block centres that are compared with each other in one place
SLACK = 1e-6                     # of angles, for rounding
SETTLED = 0.02                   # share of changed list entries at which rounds end
AUDITED = 256                    # queries of the audit that have links, at least (or all nodes are asked)
AUDITED_LINKS = 1_000            # links that the audit sees, at least (or all nodes are asked)
ASKED = 4_096                    # queries of one step of the audit, about
RECALL = 0.99
MORE = 3                         # times that an audit may ask for more orders, before all nodes are compared

EDGES = "u long, v long, s double"
CENTRES = "label string, component long, part long, n long, centre binary, radius double"


def _unit(column: pa.Array) -> np.ndarray:
    """Packed rows of one size as unit vectors of doubles, one a row."""
    if not len(column):
        return np.zeros((0, 1))
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    x = np.ascontiguousarray(raw[:, 1:]).view(f"<f{raw[0, 0]}").astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(width: int):
    """Vectors as binary, the bytes of a number (``width``) first; null for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[bytes | None] = []
            for i, label, vector in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vector")), strict=True):
                x = np.array(vector if i is not None and label is not None and vector and None not in vector else [], np.float64)
                sound = x.any() and np.isfinite(x).all() and 0 < (x * x).sum() < np.inf
                rows.append(bytes([width]) + (x + 0.0).astype(f"<f{width}").tobytes() if sound else None)      # -0.0 as 0.0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, pa.binary())], names=["id", "label", "vec"])

    return run


def packed_rows(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, vec) of every row; the label tells the size too, vec is null for vectors that link with nothing."""
    kind = vectors.schema[vector].dataType
    width = 4 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else 8
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.mapInArrow(_pack(width), "id long, label string, vec binary")
    return rows.withColumn("label", F.concat_ws(":", F.octet_length("vec"), "label"))


def nodes_of(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, vec, weight): distinct vectors of each label and size, by their least key."""
    rows = packed_rows(vectors, key, label, vector).where("vec is not null")
    return rows.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))


def _top(u: np.ndarray, v: np.ndarray, s: np.ndarray, keep: int) -> pa.RecordBatch:
    """The ``keep`` best distinct neighbours of each u."""
    order = np.lexsort((v, u))
    u, v, s = u[order], v[order], s[order]
    new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    u, v, s = u[new], v[new], s[new]
    order = np.lexsort((v, -s, u))
    u, v, s = u[order], v[order], s[order]
    first = np.append(True, u[1:] != u[:-1])[: len(u)]
    rank = np.arange(len(u)) - np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))
    best = rank < keep
    return pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (u, v, s)], names=["u", "v", "s"])


def _hyperplanes(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, 48))


def _codes(seeds: list[int]):
    """Each row under one 48-bit sign code per order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(47, -1, -1, dtype=np.int64)
        for batch in batches:
            # rows of one batch may have vectors of several sizes
            sizes = np.array([len(x.as_buffer()) for x in batch.column("vec")])
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                ids, labels, vec = (batch.column(c).take(at) for c in ("id", "label", "vec"))
                x = _unit(vec)
                for seed in seeds:
                    code = ((x @ _hyperplanes(seed, x.shape[1])) > 0) @ powers
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), seed), pa.int32()), labels, pa.array(code), ids, vec],
                                                     names=["place", "label", "code", "id", "vec"])

    return run


def _streamed_groups(batches: Iterator[pa.RecordBatch], by: list[str], most: int) -> Iterator[tuple[pa.Table, int, int]]:
    """(rows, start, stop) of consecutive groups of sorted rows; groups of over ``most`` rows come in parts."""
    held: list[pa.RecordBatch] = []
    for batch in batches_with_end(batches):
        if batch is not None and batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * most:
                continue
        if not held:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                if pa.types.is_string(rows.column(c).type) else rows.column(c).to_numpy() for c in by]
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.append(np.flatnonzero(change), rows.num_rows).tolist()
        stop = rows.num_rows if batch is None else starts[-2]
        for a, b in zip(starts, starts[1:], strict=False):
            if a >= stop:
                break
            for at in range(a, b, most):
                yield rows, at, min(at + most, b)
        if batch is not None and stop == 0:
            # one group goes on and on: what is held of it is compared now
            for at in range(0, rows.num_rows, most):
                yield rows, at, min(at + most, rows.num_rows)
            stop = rows.num_rows
        held = rows.slice(stop).to_batches() if stop < rows.num_rows else []


def batches_with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _near(keep: int):
    """Best neighbours of each row among the rows next to it in an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, a, b in _streamed_groups(batches, ["place", "label"], NEAR):
            if b - a < 2:
                continue
            part = rows.slice(a, b - a).combine_chunks()
            ids, x = part.column("id").to_numpy(), _unit(part.column("vec").combine_chunks())
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(keep, b - a - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield _top(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel(), keep)

    return run


def _meet(keep: int):
    """Members (neighbours both ways) of each node, compared with each other; pairs that beat a member's worst neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ss, n = [], [], [], 0
        for rows, a, b in _streamed_groups(batches, ["mid"], MEET):
            if b - a < 2:
                continue
            part = rows.slice(a, b - a).combine_chunks()
            ids, x, worst = part.column("id").to_numpy(), _unit(part.column("vec").combine_chunks()), part.column("worst").to_numpy()
            s = x @ x.T
            i, j = np.nonzero(s > worst[:, None])
            new = ids[i] != ids[j]
            us.append(ids[i[new]])
            vs.append(ids[j[new]])
            ss.append(s[i[new], j[new]])
            n += int(new.sum())
            if n > 400_000:
                yield _top(*map(np.concatenate, (us, vs, ss)), keep)
                us, vs, ss, n = [], [], [], 0
        if us:
            yield _top(*map(np.concatenate, (us, vs, ss)), keep)

    return run


def _best(edges: DataFrame, keep: int) -> DataFrame:
    """Each node's ``keep`` best neighbours in (u, v, s), with the largest value of any other column."""
    distinct = edges.groupBy("u", "v").agg(*[F.max(c).alias(c) for c in edges.columns if c not in ("u", "v")])
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("s").desc(), "v"))
    return distinct.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def ordered_neighbours(nodes: DataFrame, seeds: list[int], keep: int = LIST) -> DataFrame:
    """Neighbours of every node from random-hyperplane orders."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("id", "label", "vec").mapInArrow(_codes(seeds), "place int, label string, code long, id long, vec binary")
    ordered = rows.repartitionByRange(parts, "place", "label", "code", "id").sortWithinPartitions("place", "label", "code", "id")
    return ordered.mapInArrow(_near(keep), EDGES)


def _both_ways(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("u").alias("mid"), F.col("v").alias("id")).union(graph.select(F.col("v").alias("mid"), F.col("u").alias("id")))


def _met(nodes: DataFrame, graph: DataFrame, bars: DataFrame, bar: float, keep: int, turn: int, mids: DataFrame | None) -> DataFrame:
    """Edges from one round of meetings at ``mids`` (all nodes if none are given): each member takes pairs above its bar in ``bars``
    (id, worst), or ``bar``."""
    both = _both_ways(graph).union(nodes.select(F.col("id").alias("mid"), "id")).distinct()
    if mids is not None:
        both = both.join(mids.distinct(), "mid", "left_semi")
    told = nodes.select("id", "vec").join(bars, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(bar)))
    # a node to which very many point is met in parts, each with its share of them, another one each round
    hubs = cut(both.groupBy("mid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEET))
    members = both.join(small(hubs, hubs.count()), "mid", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("n") / MEET)), F.lit(0).cast("long"))).drop("n")
    return (members.join(told, "id").repartition("mid", "salt").sortWithinPartitions("mid", "salt", F.xxhash64("id", F.lit(turn)), "id")
            .mapInArrow(_meet(keep), EDGES))


def refine(nodes: DataFrame, graph: DataFrame, rounds: int = ROUNDS, keep: int = LIST, first: int = 0) -> DataFrame:
    """NN-descent: rounds (numbered from ``first``) of neighbours-of-neighbours joins until lists settle."""
    mids = None
    for turn in range(first, first + rounds):
        full = graph.groupBy("u").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= keep)
        met = _met(nodes, graph, full.select(F.col("u").alias("id"), "worst"), -2.0, keep, turn, mids)
        new = cut(_best(graph.withColumn("old", F.lit(1)).unionByName(met.withColumn("old", F.lit(0))), keep))
        total, kept = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("old"), F.lit(0))).first()
        mids, graph = _both_ways(new.where("old = 0")).select("mid"), new.drop("old")
        if total - kept <= SETTLED * max(total, 1):
            break
    return graph


def enlarge(nodes: DataFrame, graph: DataFrame, threshold: float, keep: int = LIST, widest: int = WIDEST, first: int = 0) -> DataFrame:
    """``graph`` with twice the room, again and again up to ``widest``, in lists that are full of links: their nodes alone take the
    neighbours of their neighbours, until they hold one below ``threshold``."""
    while keep < widest:
        full = cut(graph.groupBy("u").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("n"))
                   .where((F.col("n") >= keep) & (F.col("worst") >= threshold)).select(F.col("u").alias("id")))
        if full.isEmpty():
            break
        keep, first = 2 * keep, first + 1
        mids = _both_ways(graph).join(full, "id", "left_semi").select("mid")
        met = _met(nodes, graph, full.withColumn("worst", F.lit(-2.0)), 2.0, keep, first, mids)
        graph = cut(_best(graph.unionByName(met), keep))
    return graph


def _blocks(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(label, component, part, id, vec, weight): components of ``members`` (id, component), those of over BLOCK nodes in parts by hash."""
    large = cut(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1"))
    rows = members.join(small(large, large.count()), "component", "left").join(nodes.select("id", "label", "vec", "weight"), "id")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long"))
    return rows.select("label", "component", part.alias("part"), "id", "vec", "weight")


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's size, centre on the unit sphere, and largest angle from it."""
    out = []
    for rows, a, b in _streamed_groups(batches, ["component", "part"], WHOLE):
        block = rows.slice(a, b - a).combine_chunks()
        x = _unit(block.column("vec").combine_chunks())
        centre = x.sum(axis=0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 1e-9 else x[0]
        out.append((block.column("label")[0].as_py(), block.column("component")[0].as_py(), block.column("part")[0].as_py(), b - a,
                    centre.tobytes(), float(np.arccos(np.clip(x @ centre, -1, 1)).max())))
        if len(out) == 1000:
            yield _batch_of(out, CENTRES)
            out = []
    if out:
        yield _batch_of(out, CENTRES)


def _batch_of(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _close_blocks(threshold: float):
    """Pairs of blocks that may hold a link: by the triangle inequality of angles, no pair that does is left out."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, a, b in _streamed_groups(batches, ["label", "i", "j"], 8 * PACK):
            group = rows.slice(a, b - a).combine_chunks()
            x = np.frombuffer(b"".join(group.column("centre").to_pylist()), np.float64).reshape(b - a, -1)
            side, radius, n, component, part = (group.column(c).to_numpy() for c in ("side", "radius", "n", "component", "part"))
            own = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            left = np.flatnonzero(side == 0)
            right = left if own else np.flatnonzero(side == 1)
            if not len(right):
                continue
            for at in range(0, len(left), BLOCK):
                some = left[at:at + BLOCK]
                angle = np.arccos(np.clip(x[some] @ x[right].T, -1, 1))
                k, m = np.nonzero(angle <= radius[some][:, None] + radius[right] + reach)
                u, v = some[k], right[m]
                if own:                                          # each pair once; a block with itself if it holds any pair
                    once = (u < v) | ((u == v) & (n[u] > 1))
                    u, v = u[once], v[once]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (component[u], part[u], component[v], part[v])], names=["ca", "pa", "cb", "pb"])

    return run


def _count_links(threshold: float):
    """Links of each row with the other rows of one pair of blocks (a block with itself has side 0 only) as (u, null, n), and one
    link (u, v, 0) if the blocks are of two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, ns, held = [], [], [], 0
        for rows, a, b in _streamed_groups(batches, ["ca", "pa", "cb", "pb"], 2 * WHOLE):
            pair = rows.slice(a, b - a).combine_chunks()
            side, ids, weight = (pair.column(c).to_numpy() for c in ("side", "id", "weight"))
            ca, pa_, cb, pb = (pair.column(c)[0].as_py() for c in ("ca", "pa", "cb", "pb"))
            x = _unit(pair.column("vec").combine_chunks())
            own = (ca, pa_) == (cb, pb)
            left = np.flatnonzero(side == 0)
            right = left if own else np.flatnonzero(side == 1)
            counts, seen = np.zeros(len(ids), np.int64), ca == cb
            for at in range(0, len(left), BLOCK):
                some = left[at:at + BLOCK]
                near = x[some] @ x[right].T >= threshold
                if own:
                    near[np.arange(len(some)), at + np.arange(len(some))] = False
                else:
                    counts[right] += weight[some] @ near
                counts[some] += near @ weight[right]
                if not seen and near.any():
                    k, m = np.unravel_index(near.argmax(), near.shape)
                    us.append(ids[some[k:k + 1]])
                    vs.append(ids[right[m:m + 1]])
                    ns.append(np.zeros(1, np.int64))
                    seen = True
            some = np.flatnonzero(counts)
            us.append(ids[some])
            vs.append(np.full(len(some), -1))
            ns.append(counts[some])
            held += len(some) + 1
            if held > 50_000:
                yield _counted(us, vs, ns)
                us, vs, ns, held = [], [], [], 0
        if us:
            yield _counted(us, vs, ns)

    return run


def _counted(us: list[np.ndarray], vs: list[np.ndarray], ns: list[np.ndarray]) -> pa.RecordBatch:
    n = np.concatenate(ns)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs), mask=n > 0), pa.array(n)], names=["u", "v", "n"])


def block_links(nodes: DataFrame, members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of all links between nodes of ``members`` (id, component; connected by links), whatever their components: (id, n), how many
    each node has, copies counted, and (u, v), one link for each pair of blocks of two components that are linked.

    Blocks of one label are compared unless their centres are further apart than their radii and the threshold's angle.
    """
    rows = cut(_blocks(nodes, members))
    centres = cut(rows.repartition("component", "part").sortWithinPartitions("component", "part").mapInArrow(_centres, CENTRES))
    packs = centres.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
    packed = centres.join(packs, "label").withColumn("own", F.pmod(F.xxhash64("component", "part"), F.col("packs")))
    packed = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)))
    packed = packed.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                           (F.col("own") > F.col("other")).cast("int").alias("side"), "component", "part", "n", "centre", "radius")
    pairs = cut(packed.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
                .mapInArrow(_close_blocks(threshold), "ca long, pa long, cb long, pb long"))
    left = rows.join(pairs, (F.col("component") == F.col("ca")) & (F.col("part") == F.col("pa"))).withColumn("side", F.lit(0))
    right = rows.join(pairs.where("ca != cb or pa != pb"),
                      (F.col("component") == F.col("cb")) & (F.col("part") == F.col("pb"))).withColumn("side", F.lit(1))
    met = left.unionByName(right).select("ca", "pa", "cb", "pb", "side", "id", "vec", "weight")
    key = ["ca", "pa", "cb", "pb"]
    found = cut(met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_count_links(threshold), "u long, v long, n long"))
    return (found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n")),
            found.where("v is not null").select("u", "v"))


def _against(queries, threshold: float):
    """Of the audited vectors with the rows of a batch: (u, null, null, n), links with copies counted, and (u, v, s, 0), links to
    other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        for batch in batches:
            labels, vec = batch.column("label").to_pylist(), batch.column("vec")
            ids, weight, component = (batch.column(c).to_numpy() for c in ("id", "weight", "component"))
            at: dict[str, list[int]] = {}
            for k, label in enumerate(labels):
                at.setdefault(label, []).append(k)
            for label, (own, parts, q) in asked.items():
                rows = np.array(at.get(label, []), np.int64)
                step = max(1, 2_000_000 // len(own))
                for k in range(0, len(rows), step):
                    mine = rows[k:k + step]
                    s = q @ _unit(vec.take(pa.array(mine))).T
                    near = (s >= threshold) & (own[:, None] != ids[mine])
                    n = near @ weight[mine]
                    some = np.flatnonzero(n)
                    i, j = np.nonzero(near & (parts[:, None] != component[mine]))
                    none = np.zeros(len(some), np.int64)
                    v, score = np.concatenate((none, ids[mine[j]])), np.concatenate((none.astype(float), s[i, j]))
                    blank = np.arange(len(v)) < len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate((own[some], own[i]))), pa.array(v, mask=blank), pa.array(score, mask=blank),
                         pa.array(np.concatenate((n[some], np.zeros(len(i), np.int64))))], names=["u", "v", "s", "n"])

    return run


def audit(nodes: DataFrame, classes: DataFrame, counts: DataFrame, threshold: float) -> tuple[float, DataFrame]:
    """(recall, missing): the share of the true links of sampled nodes, compared with all rows, that ``counts`` (id, n) holds, and
    those (u, v, s) whose ends are in two ``classes`` (node, component).

    Nodes are asked in the order of a hash until AUDITED of them have links and AUDITED_LINKS links are seen, or there are no
    more.  The recall is the lower one of that of all links and the mean of that of nodes, so that a few nodes of very many
    links do not hide the others; 1 if no node has a link.
    """
    rows = cut(nodes.join(classes.select(F.col("node").alias("id"), "component"), "id", "left")
               .select("label", "id", "vec", "weight", F.coalesce("component", "id").alias("component")))
    steps = max(1, -(-rows.count() // AUDITED))
    place = F.pmod(F.xxhash64("id", F.lit(AUDITED)), F.lit(steps))
    links = kept = linked = 0
    shares, missing, done, width = 0.0, None, 0, 4
    while done < steps and (links < AUDITED_LINKS or linked < AUDITED):
        some = rows.where((place >= done) & (place < done + width)).select("label", "id", "vec", "component").toArrow()
        done, width = done + width, min(max(done + width, 1), ASKED // AUDITED)
        asked: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for label in set(some.column("label").to_pylist()):
            part = some.filter(pa.compute.equal(some.column("label"), label)).combine_chunks()
            asked[label] = part.column("id").to_numpy(), part.column("component").to_numpy(), _unit(part.column("vec").combine_chunks())
        shared = rows.sparkSession.sparkContext.broadcast(asked)
        seen = cut(rows.mapInArrow(_against(shared, threshold), f"{EDGES}, n long"))
        shared.unpersist()
        true = seen.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("true"))
        share = F.least(F.coalesce("n", F.lit(0).cast("long")), F.col("true"))
        total = true.join(counts, "id", "left").agg(F.sum("true"), F.sum(share), F.count(F.lit(1)), F.sum(share / F.col("true"))).first()
        links, kept, linked, shares = links + (total[0] or 0), kept + (total[1] or 0), linked + total[2], shares + (total[3] or 0.0)
        lost = seen.where("v is not null").select("u", "v", "s")
        missing = lost if missing is None else missing.unionByName(lost)
    return (min(kept / links, shares / linked) if links else 1.0), missing


def linked_classes(nodes: DataFrame, threshold: float = THRESHOLD, keep: int = LIST) -> tuple[DataFrame, DataFrame, float]:
    """(node, component) of nodes with links, (id, n) of their links, copies counted, and the audited recall of links.

    While the recall is below RECALL, more orders and rounds follow; if that is not enough, all nodes of a label are compared.
    Links that an audit has found missing are always added.
    """
    graph, recall = None, 0.0
    for turn in range(1 + MORE):
        seeds = list(range(turn * ORDERS, (turn + 1) * ORDERS))
        found = ordered_neighbours(nodes, seeds, keep)
        graph = cut(_best(found if graph is None else graph.unionByName(found), keep))
        graph = refine(nodes, graph, keep=keep, first=turn * ROUNDS)
        graph = enlarge(nodes, graph, threshold, keep, first=(1 + MORE) * ROUNDS)
        links = graph.where(F.col("s") >= threshold).select("u", "v")
        classes, counts = _whole(nodes, cut(connected_components(links)), threshold)
        recall, missing = audit(nodes, classes, counts, threshold)
        lost = missing.count()
        if recall >= RECALL:
            if lost:
                known = links.unionByName(classes.select(F.col("node").alias("u"), F.col("component").alias("v")))
                classes, counts = _whole(nodes, cut(connected_components(known.unionByName(missing.select("u", "v")))), threshold)
            return classes, counts, recall
        graph = cut(_best(graph.unionByName(missing).unionByName(missing.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")), keep))
    alone = nodes.select("id").join(classes.select(F.col("node").alias("id"), "component"), "id", "left")
    classes, counts = _whole(nodes, alone.select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component")), threshold)
    recall, _ = audit(nodes, classes, counts, threshold)
    if recall < RECALL:
        raise RuntimeError(f"recall of links {recall:.4f} is below {RECALL}")
    return classes, counts, recall


def _whole(nodes: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``classes`` (node, component) merged where block_links finds them linked, and its counts (id, n)."""
    counts, crossing = block_links(nodes, classes.select(F.col("node").alias("id"), "component"), threshold)
    if not crossing.isEmpty():
        held = classes.select(F.col("node").alias("u"), F.col("component").alias("v"))
        merged = connected_components(held.unionByName(crossing))
        classes = cut(classes.select("node").join(merged, "node"))
    return classes, cut(counts)


def link_vectors(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                 threshold: float = THRESHOLD, keep: int = LIST) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept."""
    return audited_links(vectors, key, label, vector, threshold, keep)[0]


def audited_links(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                  threshold: float = THRESHOLD, keep: int = LIST) -> tuple[DataFrame, float]:
    """The rows of link_vectors and the audited recall of their links."""
    numbered = nodes_of(vectors, key, label, vector).withColumnRenamed("id", "least").withColumn("id", F.monotonically_increasing_id())
    nodes = cut(numbered)                                       # numbers are given once: an id may have several vectors
    classes, counts, recall = linked_classes(nodes.drop("least"), threshold, keep)
    joined = nodes.select(F.col("id").alias("node"), "least").join(classes, "node")
    named = joined.groupBy("component").agg(F.min("least").alias("first"))
    of = classes.join(named, "component").select(F.col("node").alias("id"), "first")
    told = (nodes.join(counts, "id", "left").join(of, "id", "left")
            .select("label", "vec", (F.coalesce("n", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("first", "least").alias("first")))
    rows = packed_rows(vectors, key, label, vector).join(told, ["label", "vec"], "left")
    own = F.col("id").cast(vectors.schema[key].dataType)
    component = F.coalesce("first", "id")
    out = rows.select(own.alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
    return out, recall
