"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of one label are points on the unit sphere. Equal ones are one point
with a count. The upper levels of the tree are tables: a label is a cell, and
each level deals the points of cells that are too large for a task to children
around centres half the cell's radius apart. Pairs of cells go down together:
the children of a pair are paired only if their centres are no further apart
than both covering radii and the threshold together, and a pair that lies within
the threshold as a whole is taken as a whole. So points of no pair are compared,
or even copied, before radii have told where they may link. Within a pair of
small cells two trees are built, whose levels halve the radius, and walked by
the same rules. Points that are left are compared by cosine in double precision,
so the result is exact.

A task returns, per point, how many vectors it is linked with, and a spanning
part of the links. Pairs are never emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fissura.llm.graph import components
from fissura.llm.shared import stored

CELL = 4096  # cells of more than twice as many points are split
FAN = 32  # children of a cell, on average at most
FEW = 4  # children that are worth a level
PART = 16_384  # points of a cell that one task deals to its children
MOST_LEVELS = 60  # of cells; each divides large ones by FAN or so
LEAF = 512  # points of a tree's leaf
CHILDREN = 16  # of a node of a tree
LEVELS = 7  # radii 1, 1/2, ... 1/64 of the trees within a task
TINY = 1e-18  # squared distance of centres that are one direction
SLACK = 1e-9  # on bounds, far above rounding errors and far below the distances told apart


class Node:
    """A centre, the radius that covers all points below, and children or points."""

    __slots__ = ("centre", "radius", "children", "points")

    def __init__(self, centre, radius, children, points):
        self.centre, self.radius, self.children, self.points = centre, radius, children, points


def build(x: np.ndarray, points: np.ndarray, level: int = 0, leaf: int = LEAF) -> Node:
    """The cover tree of ``x[points]``; the first point is the centre.

    Centres of children are apart by the radius of the level. Where points are so
    spread that there were many, those beyond ``CHILDREN`` go to the nearest; all
    radii are measured, so bounds hold.
    """
    centre = x[points[0]]
    away = np.sqrt(np.maximum(((x[points] - centre) ** 2).sum(axis=1), 0))
    radius = float(away.max()) + SLACK
    if len(points) <= leaf or level >= LEVELS or radius <= 2 * SLACK:
        return Node(centre, radius, None, points)
    reach = 0.5**level
    net, nearest = [], np.full(len(points), np.inf)
    own = np.zeros(len(points), np.int64)
    while len(net) < CHILDREN and (far := nearest > reach * reach).any():
        k = int(far.argmax())
        gap = ((x[points] - x[points[k]]) ** 2).sum(axis=1)
        gap[k] = -1.0  # its own, also beside an equal one
        closer = gap < nearest
        own[closer], nearest[closer] = len(net), gap[closer]
        net.append(k)
    if len(net) == 1:
        return build(x, points, level + 1, leaf)
    children = []
    for c, k in enumerate(net):
        mine = np.flatnonzero(own == c)
        first = points[[k]]
        children.append(build(x, np.concatenate([first, points[mine[mine != k]]]), level + 1, leaf))
    return Node(centre, radius, children, points)


class Links:
    """What a traversal finds: linked vectors of each point, and a spanning forest."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.found = np.zeros(len(counts), np.int64)
        self.root = np.arange(len(counts))

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        self.root[max(a, b)] = min(a, b)

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of a with every one of b; the same array: with every other."""
        same = a is b
        self.found[a] += self.counts[b].sum() - (self.counts[a] if same else 0)
        if not same:
            self.found[b] += self.counts[a].sum()
        for i in a[1:].tolist():
            self.join(int(a[0]), i)
        if not same:
            for j in b.tolist():
                self.join(int(a[0]), j)

    def some_of(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """linked[i, j]: a[i] with b[j]."""
        same = a is b
        self.found[a] += linked @ self.counts[b]
        if not same:
            self.found[b] += self.counts[a] @ linked
        p, q = np.nonzero(linked)
        tops = [self.tops(a)[p], self.tops(b)[q]]
        # Points that are joined already are most of those in a dense place.
        pairs = np.unique(np.sort(np.stack(tops)[:, tops[0] != tops[1]], axis=0), axis=1)
        for i, j in pairs.T.tolist():
            self.join(i, j)

    def tops(self, points: np.ndarray) -> np.ndarray:
        found = self.root[points]
        while (self.root[found] != found).any():
            found = self.root[found]
        return found


def traverse(x: np.ndarray, raw: np.ndarray, norm: np.ndarray, one: Node, two: Node, cosine: float, links: Links) -> None:
    """Find the pairs of two trees, or of one with itself, whose cosine reaches the threshold."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    pending = [(one, two)]
    while pending:
        a, b = pending.pop()
        same = a is b
        apart = 0.0 if same else float(np.sqrt(((a.centre - b.centre) ** 2).sum()))
        if apart > a.radius + b.radius + reach + SLACK:
            continue
        if apart + a.radius + b.radius < reach - SLACK:
            links.all_of(a.points, b.points)
            continue
        if a.children is None and b.children is None:
            p, q = a.points, b.points
            linked = (raw[p] @ raw[q].T) / (norm[p][:, None] * norm[q]) >= cosine
            if same:
                np.fill_diagonal(linked, False)
            links.some_of(p, q, linked)
            continue
        left = a.children or [a]
        right = left if same else (b.children or [b])
        if same:
            i, j = np.triu_indices(len(left))
        else:
            i, j = (v.ravel() for v in np.indices((len(left), len(right))))
        # All children at once, before any of their pairs is looked at on its own.
        c, d = np.array([n.centre for n in left]), np.array([n.centre for n in right])
        r, s = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        gap = (c * c).sum(axis=1)[:, None] + (d * d).sum(axis=1) - 2 * c @ d.T
        bound = r[:, None] + s + reach + 1e-6
        close = gap[i, j] <= bound[i, j] ** 2
        pending += [(left[u], right[v]) for u, v in zip(i[close].tolist(), j[close].tolist())]


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / norm[:, None], norm


@F.arrow_udf(T.DoubleType())
def _apart(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distance of two vectors of one length, row by row."""
    starts = np.cumsum([0, *pc.list_value_length(a).to_pylist()])[:-1]
    gap = (a.flatten().to_numpy() - b.flatten().to_numpy()) ** 2
    return pa.array(np.sqrt(np.add.reduceat(gap, starts)) if len(starts) else np.zeros(0))


def _rows(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _net(table: pa.Table) -> pa.Table:
    """Of the points drawn from one cell, the centres of its children.

    They are half the cell's radius apart; but where that leaves few, as in a
    cell that is dense in one place, all are taken, so that every level gets on.
    """
    order = np.argsort(table.column("draw").to_numpy(), kind="stable")
    x = _unit(_rows(table, "vector"))[0][order]
    reach, net = table.column("radius")[0].as_py() / 2, []
    for k in range(len(x)):
        if not net or ((x[net] - x[k]) ** 2).sum(axis=1).min() > reach * reach:
            net.append(k)
    x = x[net] if len(net) >= FEW else x
    return pa.table(
        {"parent": [table.column("cell")[0].as_py()] * len(x), "child": np.arange(len(x)), "centre": list(x)},
        schema=pa.schema([("parent", pa.int64()), ("child", pa.int64()), ("centre", pa.list_(pa.float64()))]),
    )


POINTS = "id long, vector array<double>, count long, cell long, away double"


def _deal(points: pa.Table, centres: pa.Table) -> pa.Table:
    """Part of a cell's points, each to the nearest child."""
    if len(points) and len(centres):
        x, c = _unit(_rows(points, "vector"))[0], _rows(centres, "centre")
        ids = points.column("id").to_numpy()
        if ((c - c[0]) ** 2).sum(axis=1).max() > TINY:
            own = np.maximum(2 - 2 * x @ c.T, 0).argmin(axis=1)
        else:  # one direction in many lengths: any part will do
            own = (ids.view(np.uint64) % np.uint64(len(c))).astype(np.int64)
        cells = centres.column("cell").to_numpy()[own]
        away = np.sqrt(((x - c[own]) ** 2).sum(axis=1))
        points = points.set_column(points.schema.get_field_index("cell"), "cell", pa.array(cells))
        points = points.set_column(points.schema.get_field_index("away"), "away", pa.array(away))
    elif not len(points):
        points = points.slice(0, 0)
    return points.select(["id", "vector", "count", "cell", "away"])


def _split(points: DataFrame, large: DataFrame, level: int, cell: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The points with those of large cells dealt to children, and ``parent, cell, centre`` of these.

    A cell has about ``fan`` children at most, drawn by a hash of the points. Its
    points meet them in parts of bounded size, so no cell is one task's work.
    """
    wanted = F.least(F.lit(fan), F.greatest(F.lit(2 * FEW), F.ceil(F.col("n") * 2 / cell)))
    marks = large.select("cell", "n", "radius", wanted.alias("wanted"), F.ceil(F.col("n") / PART).alias("parts"))
    tagged = points.join(marks, "cell")
    draw = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 40))
    drawn = tagged.withColumn("draw", draw).filter(F.col("draw") * F.col("n") < F.col("wanted") * F.lit(1 << 40).cast("double"))
    nets = drawn.select("cell", "radius", "draw", "vector").groupBy("cell").applyInArrow(
        _net, "parent long, child long, centre array<double>"
    )
    nets = stored(nets.select("parent", F.xxhash64("parent", "child").alias("cell"), "centre"), "centres")
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    copies = marks.select(F.col("cell").alias("parent"), parts.alias("part")).join(nets, "parent")
    mine = tagged.select(
        F.col("cell").alias("parent"), F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).alias("part"),
        "id", "vector", "count", "cell", "away",
    )
    dealt = mine.groupBy("parent", "part").cogroup(copies.groupBy("parent", "part")).applyInArrow(_deal, POINTS)
    rest = points.join(marks, "cell", "left_anti").select("id", "vector", "count", "cell", "away")
    return stored(dealt.union(rest), "level"), nets


def _cells(points: DataFrame) -> DataFrame:
    return points.groupBy("cell").agg(
        (F.max("away") + SLACK).alias("radius"), F.count("*").alias("n"), F.sum("count").alias("weight"), F.min("id").alias("low")
    )


def _expanded(pairs: DataFrame, children: DataFrame, reach: float) -> DataFrame:
    """Pairs of children of paired cells that the covering radii do not rule out; ``whole`` where all link."""
    side = lambda s: children.select(*(F.col(c).alias(c + s) for c in children.columns))
    both = pairs.join(side("1"), F.col("a") == F.col("parent1")).join(side("2"), F.col("b") == F.col("parent2"))
    both = both.filter((F.col("a") != F.col("b")) | (F.col("cell1") <= F.col("cell2")))
    radii = F.col("radius1") + F.col("radius2")
    both = both.withColumn("apart", _apart("centre1", "centre2")).filter(F.col("apart") <= radii + reach + SLACK)
    return both.filter((F.col("cell1") != F.col("cell2")) | (F.col("n1") > 1)).select(
        F.col("cell1").alias("a"), F.col("cell2").alias("b"), (F.col("apart") + radii < reach - SLACK).alias("whole"),
        "weight1", "weight2", F.least("low1", "low2").alias("low"),
    )


def _whole_links(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, links, low`` of the points in pairs of cells that link as a whole."""
    same = F.col("a") == F.col("b")
    one = pairs.select(F.col("a").alias("cell"), F.col("weight2").alias("weight"), "low", same.cast("long").alias("own"))
    two = pairs.filter(~same).select(F.col("b").alias("cell"), F.col("weight1").alias("weight"), "low", F.lit(0).cast("long").alias("own"))
    of_cell = one.union(two).groupBy("cell").agg(
        F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("own").alias("own")
    )
    return points.join(of_cell, "cell").select(
        "id", (F.col("weight") - F.col("own") * F.col("count")).alias("links"), "low"
    )


def _compare(cosine: float):
    """The work on one pair of cells: two trees, or one with itself."""

    def compare(table: pa.Table) -> pa.Table:
        raw = _rows(table, "vector")
        x, norm = _unit(raw)
        ids, left = table.column("id").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        links = Links(table.column("count").to_numpy())
        if left.all():
            tree = build(x, np.arange(len(ids)))
            traverse(x, raw, norm, tree, tree, cosine, links)
        else:
            trees = [build(x, np.flatnonzero(side)) for side in (left, ~left)]
            traverse(x, raw, norm, *trees, cosine, links)
        at = np.flatnonzero(links.found)
        low: dict = {}
        for i in at.tolist():
            k = links.top(i)
            low[k] = min(low.get(k, ids[i]), ids[i])
        return pa.table(
            {"id": ids[at], "links": links.found[at], "low": np.array([low[links.top(i)] for i in at.tolist()], np.int64)},
            schema=pa.schema([("id", pa.int64()), ("links", pa.int64()), ("low", pa.int64())]),
        )

    return compare


def _links(points: DataFrame, cosine: float, cell: int, fan: int) -> DataFrame:
    """``id, links, low``, in parts, of ``points (id, vector, count, cell)``, a cell for each label."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    points = stored(points.withColumn("away", F.lit(2.0)).select("id", "vector", "count", "cell", "away"), "level")
    first = points.groupBy("cell").agg(F.min_by("vector", "id").alias("centre"))
    norm = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, v: s + v * v))
    known = first.withColumn("norm", norm).select("cell", F.transform("centre", lambda v: v / F.col("norm")).alias("centre"))
    cells = stored(_cells(points).join(known, "cell"), "cells")
    pairs = stored(cells.select(F.col("cell").alias("a"), F.col("cell").alias("b")), "pairs")
    found = []
    for level in range(MOST_LEVELS):
        alive = pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        large = stored(cells.join(alive, "cell", "left_semi").filter(F.col("n") > 2 * cell), "large")
        if large.isEmpty():
            break
        # What is in no pair any more stays behind.
        points, nets = _split(points.join(alive, "cell", "left_semi"), large, level, cell, fan)
        sizes = stored(_cells(points), "sizes")
        new = sizes.join(nets, "cell").select("parent", *sizes.columns, "centre")
        # A cell that is small, or whose draw was empty, is its own child.
        old = cells.join(sizes.select("cell"), "cell", "left_semi").select(F.col("cell").alias("parent"), *sizes.columns, "centre")
        children = stored(new.union(old), "cells")
        cells = children.drop("parent")
        both = stored(_expanded(pairs, children, reach), "expanded")
        found.append(_whole_links(points, both.filter("whole")))
        pairs = both.filter("not whole").select("a", "b")
    else:
        raise RuntimeError("cells did not get small")
    one = pairs.select(F.col("a").alias("cell"), "a", "b", F.lit(True).alias("left"))
    two = pairs.filter("a <> b").select(F.col("b").alias("cell"), "a", "b", F.lit(False).alias("left"))
    met = points.join(one.union(two), "cell").select("a", "b", "left", "id", "vector", "count")
    some = met.groupBy("a", "b").applyInArrow(_compare(cosine), "id long, links long, low long")
    for part in found:
        some = some.union(part)
    return stored(some, "links")


def link_vectors(
    df: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cell: int = CELL, fan: int = FAN,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``df``.

    Vectors of one label link when their cosine in double precision is at least
    ``cosine``. Null vectors or labels, zero vectors, and those with null, NaN
    or infinite components link with nothing; vectors of different lengths do
    not link. A component is named by its smallest id, and ``kept`` marks that
    row. Repeated rows link like other copies, each a vector of its own; a null
    id links with nothing and has a null component. An empty table gives no
    rows; other columns are ignored. Nothing is collected to the driver; cells of
    more than ``2 * cell`` points are split, level by level, into ``fan`` at most or so.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = (
        rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
        .filter(~bad & F.exists("vector", lambda v: v != 0))
        .withColumn("vector", F.transform("vector", lambda v: v + 0.0))  # -0.0 equals 0.0
    )
    copies = stored(
        usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("count")), "points"
    )
    # Vectors of another length never link, so the length is part of the key.
    key = F.concat_ws("/", F.col("label").cast("string"), F.size("vector").cast("string"))
    points = copies.select(F.col("rep").alias("id"), "vector", "count", F.xxhash64(key).alias("cell"))
    found = _links(points, cosine, cell, fan)
    comps = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = (
        copies.join(degree.withColumnRenamed("id", "rep"), "rep", "left")
        .join(comps.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "vector", "rep", "count", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    linked = usable.join(classes, ["label", "vector"]).select(
        "id", (F.col("links") + F.col("count") - 1).alias("n_links"), F.col("component").alias("component_id")
    )
    # A row that takes no part keeps its id as component.
    part = ~bad & F.exists("vector", lambda v: v != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rest = rows.filter(~F.coalesce(part, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(rest).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
