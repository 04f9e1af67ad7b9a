"""Density trees as tables: lightest spanning trees under mutual reachability, single linkage, condensed trees, selection.

Every function takes many trees at once, told apart by the column `tree`. Points are 0 to n - 1 within a tree; merge r is node
n + r, and merges are in order of distance, then of their edge's ends, so all is determined. Distances are at 6 decimals.

An edge of the lightest tree is an edge of the lightest tree of any part of the graph that holds it. So of few blocks each pair
keeps its own part's tree, and only these edges go on; they are contracted by components until one task can hold a tree's rest.
Of more points, the lightest tree of nearest neighbours, joined to one, bounds what else can count: a pair that comes before the
last edge of the path between them. All pairs are searched for these (`pairs`), and they and the tree's edges are contracted.
Merges are made in spans of the order: the light half of a span is contracted to tell what the heavy half joins.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import dendrogram, pairs
from cairn.operators.pairs import EDGE
from cairn.operators.steps import SPAN, Steps, components, follow, keyed, numbered, together

#: Points in a block; edges of a tree that one task holds; neighbours that a spanning tree begins with.
BLOCK, EDGES, NEAR = 1024, 1 << 20, 10


def block_pairs(points: DataFrame, block: int = BLOCK, place: Column | None = None) -> DataFrame:
    """A row for each pair of blocks of a tree (lo <= hi): tree, lo, hi, and both blocks' rows. points: tree, n, pos and others.

    Blocks have about block rows, by hash or as place says (0 to ceil(n / block) - 1). A task holds two of them.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
    rows = points.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("pos"), "blocks") if place is None else place)
    own = [c for c in points.columns if c not in ("tree", "n")]
    packed = rows.groupBy("tree", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("pos", *(c for c in own if c != "pos")))).alias("rows"))
    with_ = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = with_.select("tree", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.struct("block", "rows").alias("side"))
    sides = F.sort_array(F.collect_list("side"))
    return pair.groupBy("tree", "lo", "hi").agg(sides.alias("sides")).filter((F.col("lo") == F.col("hi")) | (F.size("sides") == 2)).select("tree", "lo", "hi", F.col("sides")[0]["rows"].alias("a"), F.element_at("sides", -1)["rows"].alias("b"))


def rows_of(rows, field: str) -> np.ndarray:
    """A field of a block's rows, a row each."""
    return np.array([r[field] for r in rows], float).reshape(len(rows), -1)


def distances(x: np.ndarray, y: np.ndarray, metric: str, digits: int | None = 6) -> np.ndarray:
    """Of all rows of x to all of y, at so many decimals; what is not a number is infinite."""
    if metric == "cosine":
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8) for m in (x, y))
        d = 1 - np.clip(x @ y.T, -1, 1)
    else:
        d = np.stack([np.sqrt(((y - v) ** 2).sum(1)) for v in x])
    d = d if digits is None else np.round(d, digits) + 0.0
    return np.where(np.isnan(d), np.inf, d)


def core_distances(points: DataFrame, samples: list[int], metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """points (tree, n, pos, embedding) with cores: for each of samples, the distance to the k-th nearest other point, or to the
    farthest if there are fewer; 0 in a tree of one. near: the nearest others (distance, near), as many as samples ask for or NEAR."""
    most = max(*samples, NEAR)
    near = F.slice(F.sort_array(F.collect_list(F.struct("distance", "near"))), 1, most).alias("near")
    found = pairs.near_pairs(points, most, metric, block).groupBy("tree", "pos").agg(near)
    at = lambda k: F.try_element_at("near.distance", F.greatest(F.lit(1), F.least(F.lit(k), F.col("n") - 1)).cast("int"))
    cores = F.array(*(F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(at(k), F.lit(float("inf")))) for k in samples))
    return points.join(found, ["tree", "pos"], "left").withColumn("cores", cores)


def _lightest(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lightest tree of a symmetric matrix, from its first node; of equal weights, the edge of the least, then least other end."""
    n = len(w)
    best, via, open_ = w[0].copy(), np.zeros(n, int), np.ones(n, bool)
    open_[0] = False
    ends, weights = np.zeros((n - 1, 2), int), np.zeros(n - 1)
    for k in range(n - 1):
        least = best[open_].min()
        at = np.nonzero(open_ & (best == least))[0]
        i = at[0] if len(at) == 1 else min(at, key=lambda j: (min(j, via[j]), max(j, via[j])))
        ends[k], weights[k] = (min(i, via[i]), max(i, via[i])), least
        open_[i] = False
        better = (w[i] < best) | ((w[i] == best) & (i < via))
        best, via = np.where(better, w[i], best), np.where(better, i, via)
    return ends[:, 0], ends[:, 1], weights


def _kruskal(g: pd.DataFrame, a: str = "a", b: str = "b") -> pd.DataFrame:
    """The rows of g (w, and ends a, b) that its lightest tree holds, or the lightest tree of each group."""
    g = g.sort_values(["w", "a", "b"], kind="stable")
    ends = keyed(g, a, b) if "group" in g else (g[a].to_numpy(), g[b].to_numpy())
    top: dict[int, int] = {}

    def find(i: int) -> int:
        while top.get(i, i) != i:
            top[i] = top.get(top[i], top[i])
            i = top[i]
        return i

    keep = []
    for i, j in zip(*(e.tolist() for e in ends), strict=True):
        i, j = find(i), find(j)
        keep.append(i != j)
        top[max(i, j)] = min(i, j)
    return g[keep]


def reachability(names: list[str]):
    """Weighs pairs of rows with cores: the largest of the distance and both cores, for each of cores."""

    def weigh(d: np.ndarray, rows: list) -> list[np.ndarray]:
        cores = rows_of(rows, "cores")
        return [np.maximum(d, np.maximum(cores[:, j, None], cores[None, :, j])) for j in range(len(names))]

    return weigh


def spanning_trees(points: DataFrame, steps: Steps, names: list[str], metric: str = "euclidean", block: int = BLOCK, most: int = EDGES, weigh=None) -> DataFrame:
    """tree, a, b, w: the lightest trees of each tree's points (tree, n, pos, embedding and what weigh reads).

    weigh: gives a matrix for each of names, which follow the tree's name; by default mutual reachability for each of cores.
    Infinite weights join what nothing else does. Mutual reachability in trees of over two blocks goes by `_searched`.
    """
    large = None
    if weigh is None:
        large = points.filter(F.col("n") > 2 * block)
        if large.take(1):
            points = points.filter(F.col("n") <= 2 * block)
        else:
            large = None
    points = points.drop("near")
    weigh = weigh or reachability(names)

    def part(batches):
        for batch in batches:
            for tree, lo, hi, left, right in zip(batch["tree"], batch["lo"], batch["hi"], batch["a"], batch["b"], strict=True):
                rows = list(left) if lo == hi else [*left, *right]
                pos = np.array([r["pos"] for r in rows])
                if len(pos) < 2:
                    continue
                k = len(left)
                d = np.full((len(rows), len(rows)), np.inf)
                if lo == hi:
                    d[:] = distances(rows_of(left, "embedding"), rows_of(left, "embedding"), metric)
                else:
                    d[:k, k:] = distances(rows_of(left, "embedding"), rows_of(right, "embedding"), metric)
                    d[k:, :k] = d[:k, k:].T
                order = np.argsort(pos)
                pos, d = pos[order], d[np.ix_(order, order)]
                for name, m in zip(names, weigh(d, [rows[i] for i in order]), strict=True):
                    a, b, w = _lightest(m)
                    yield pd.DataFrame({"tree": f"{tree}{name}", "a": pos[a], "b": pos[b], "w": w})

    parts = steps.cut(block_pairs(points, block).mapInPandas(part, EDGE))
    out = contracted(parts, steps, most)
    return out if large is None else out.unionByName(_searched(large, steps, names, metric, block, most))


def _joined(edges: DataFrame, each: DataFrame, steps: Steps, metric: str, block: int) -> DataFrame:
    """Forests of edges (tree, a, b, w) of the points each (tree, n, pos, embedding, core, lead) with the edges that make them trees:
    rounds in which each part but the largest takes its lightest edge. What no finite edge joins, the first point does. lead: all
    points but those that edges join with an equal one, which need not be searched again."""
    while True:
        sizes = each.select("tree", "n").distinct().join(edges.groupBy("tree").agg(F.count("*").alias("k")), "tree", "left")
        open_ = steps.cut(sizes.filter(F.coalesce("k", F.lit(0)) < F.col("n") - 1).select("tree"))
        if not open_.take(1):
            return edges
        known = components(edges.join(open_, "tree", "left_semi"), ["tree"], steps).withColumnRenamed("node", "pos")
        label = steps.cut(each.join(open_, "tree", "left_semi").select("tree", "pos").join(known, ["tree", "pos"], "left").withColumn("component", F.coalesce("component", "pos")))
        first = label.groupBy("tree", "component").agg(F.count("*").alias("m")).groupBy("tree").agg(F.max(F.struct("m", "component"))["component"].alias("first"))
        part = F.when(F.col("component") == F.col("first"), -1).otherwise(F.col("component")).alias("part")
        rows = steps.cut(each.join(label, ["tree", "pos"]).join(first, "tree").select(*each.columns, part))
        found = pairs.leaving_edges(rows.filter("lead"), block, metric).groupBy("tree", "part").agg(F.min(F.struct("w", "a", "b")).alias("e"))
        new = steps.cut(found.select("tree", "e.a", "e.b", "e.w").distinct())
        stuck = label.join(new, "tree", "left_anti").filter("component > 0").select("tree", F.lit(0).cast("long").alias("a"), F.col("component").alias("b"), F.lit(float("inf")).alias("w")).distinct()
        edges = steps.cut(edges.unionByName(new).unionByName(stuck))


def _firsts(points: DataFrame, metric: str) -> DataFrame:
    """points (tree, pos, embedding and others) with first: the least pos of the rows of its tree that equal it, its own if none does
    or if equal rows may not be at distance 0."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = (square < 1e300) & ((square > 1e-12) | F.lit(metric != "cosine"))
    least = points.filter(sound).groupBy("tree", "embedding").agg(F.min("pos").alias("first"))
    return points.join(least, ["tree", "embedding"], "left").withColumn("first", F.coalesce("first", "pos"))


def _searched(points: DataFrame, steps: Steps, names: list[str], metric: str, block: int, most: int) -> DataFrame:
    """spanning_trees under mutual reachability, from a tree of nearest neighbours and the pairs that come before its paths' last edges.

    Copies of a row would be each other's neighbours only, so that hardly any trees met: they have an edge to the first of them, and
    the neighbours of first rows are searched among first rows.
    """
    points = steps.cut(_firsts(points, metric))
    if points.filter("first <> pos").take(1):
        leads = points.filter("first = pos").select("tree", "pos", "embedding")
        leads = steps.cut(leads.join(leads.groupBy("tree").agg(F.count("*").alias("n")), "tree"))
        found = pairs.near_pairs(leads, NEAR, metric, block).unionByName(points.filter("first <> pos").select("tree", "pos", F.col("first").alias("near"), F.lit(0.0).alias("distance")))
        near = F.collect_list(F.struct("distance", "near")).alias("near")
        points = points.drop("near").join(found.groupBy("tree", "pos").agg(near), ["tree", "pos"], "left")
    elif "near" not in points.columns:
        near = F.slice(F.sort_array(F.collect_list(F.struct("distance", "near"))), 1, NEAR).alias("near")
        points = points.join(pairs.near_pairs(points, NEAR, metric, block).groupBy("tree", "pos").agg(near), ["tree", "pos"], "left")
    name = F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col("cores")[j].alias("core")) for j, v in enumerate(names)))).alias("_v")
    whole = steps.cut(points.select("tree", "n", "pos", "embedding", "near", "first", name).select(F.concat("tree", "_v.name").alias("tree"), "n", "pos", "embedding", "near", "_v.core", ((F.col("first") == F.col("pos")) | (F.col("_v.core") == float("inf"))).alias("lead")))
    each = whole.drop("near")
    listed = whole.select("tree", "pos", "core", F.explode("near").alias("e")).select("tree", "pos", "core", "e.near", "e.distance")
    listed = listed.join(whole.select("tree", F.col("pos").alias("near"), F.col("core").alias("_core")), ["tree", "near"])
    listed = listed.select("tree", F.least("pos", "near").alias("a"), F.greatest("pos", "near").alias("b"), F.greatest("distance", "core", "_core").alias("w"))
    listed = steps.cut(listed.filter(F.col("w") < float("inf")).distinct())
    tree = _joined(steps.cut(contracted(listed, steps, most)), each, steps, metric, block)
    merges = steps.cut(single_linkage(tree, steps))
    start = dendrogram.node_places(merges, steps)
    size = merges.select("tree", (F.col("n") + F.col("r")).alias("left"), F.col("size").alias("_l"))
    gaps = merges.withColumn("id", F.col("n") + F.col("r")).join(start, ["tree", "id"], "left").join(size, ["tree", "left"], "left")
    gaps = gaps.select("tree", "r", (F.coalesce("place", F.lit(0)) + F.coalesce("_l", F.lit(1)) - 1).alias("place"))
    ranked = numbered(tree, ["tree"], ["w", "a", "b"], steps, "r", "_n").select("tree", "r", F.col("r").cast("double").alias("gap_r"), F.col("w").alias("gap_w"), F.col("a").cast("double").alias("gap_a"), F.col("b").cast("double").alias("gap_b"))
    gaps = gaps.join(ranked, ["tree", "r"]).drop("r")
    leaves = start.select("tree", F.col("id").alias("pos"), "place")
    placed = each.join(leaves, ["tree", "pos"]).join(gaps, ["tree", "place"], "left").fillna(-1.0, ["gap_r", "gap_a", "gap_b"]).fillna(float("-inf"), ["gap_w"])
    lighter = pairs.lighter_edges(placed, block, metric, _kruskal, steps)
    return contracted(steps.cut(tree.unionByName(lighter)), steps, most)


def contracted(edges: DataFrame, steps: Steps, most: int = EDGES) -> DataFrame:
    """The lightest spanning tree of each tree's graph of edges (tree, a, b, w), by w, then a, b.

    Each round, every component takes its lightest edge to another one, so their number at least halves. A tree of no more than
    most edges between components is finished in a task of its own.
    """
    now = edges.select("tree", "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    out = []
    while True:
        sized = now.join(now.groupBy("tree").agg(F.count("*").alias("k")), "tree")
        out.append(steps.cut(together(sized.filter(F.col("k") <= most).drop("k"), ["tree"], lambda g: _kruskal(g, "ca", "cb")[["tree", "a", "b", "w"]], EDGE)))
        large = sized.filter(F.col("k") > most).drop("k")
        if not large.take(1):
            break
        both = large.unionByName(large.select("tree", "a", "b", "w", F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        best = both.groupBy("tree", "ca").agg(F.min(F.struct("w", "a", "b", F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v"))).alias("e"))
        chosen = steps.cut(best.select("tree", "e.*").distinct())
        out.append(chosen.select("tree", "a", "b", "w"))
        label = steps.cut(components(chosen.select("tree", F.col("u").alias("a"), F.col("v").alias("b")), ["tree"], steps))
        for c in ("ca", "cb"):
            large = large.join(label.select("tree", F.col("node").alias(c), "component"), ["tree", c]).drop(c).withColumnRenamed("component", c)
        light = F.min(F.struct("w", "a", "b")).alias("e")
        now = steps.cut(large.filter("ca <> cb").groupBy("tree", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(light).select("tree", "e.*", "ca", "cb"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def single_linkage(edges: DataFrame, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, n, r, left, right, distance, size: the merges of spanning trees (tree, a, b, w); left is the side of the edge's a.

    Spans of merges are made by a task each. What their ends belong to by then comes from halving the order: the components of
    a light half are nodes of the heavy half, with their sizes and last merges.
    """
    ranked = numbered(edges, ["tree"], ["w", "a", "b"], steps, "r", "k")
    e = steps.cut(ranked.select("tree", (F.col("k") + 1).alias("n"), "r", "a", "b", "w"))
    most = e.agg(F.max("n")).first()[0] or 0
    width = span
    while width < most:
        width *= 2
    # Nodes that are more than a point: the part of the order that they stand in, their points and last merge.
    grown = None
    e = e.withColumn("part", F.lit(0).cast("long"))
    while width > span:
        width //= 2
        half = F.floor(F.col("r") / width)
        light, heavy = e.filter(half % 2 == 0), e.filter(half % 2 == 1)
        label = steps.cut(components(light.select("tree", "part", "a", "b"), ["tree", "part"], steps))
        last = light.join(label.withColumnRenamed("node", "a"), ["tree", "part", "a"]).groupBy("tree", "part", "component").agg(F.max(F.col("n") + F.col("r")).alias("last"))
        known = label if grown is None else label.join(grown.select("tree", "part", "node", "size"), ["tree", "part", "node"], "left")
        sizes = known.groupBy("tree", "part", "component").agg(F.sum(F.lit(1) if grown is None else F.coalesce("size", F.lit(1))).alias("size"))
        new = sizes.join(last, ["tree", "part", "component"]).withColumnRenamed("component", "node")
        upper = new
        if grown is not None:
            upper = upper.unionByName(grown.join(label, ["tree", "part", "node"], "left_anti"))
        for c in ("a", "b"):
            heavy = heavy.join(label.withColumnRenamed("node", c), ["tree", "part", c], "left").withColumn(c, F.coalesce("component", c)).drop("component")
        upper = upper.withColumn("part", F.col("part") * 2 + 1)
        grown = steps.cut(upper if grown is None else upper.unionByName(grown.withColumn("part", F.col("part") * 2)))
        e = steps.cut(light.withColumn("part", F.col("part") * 2).unionByName(heavy.withColumn("part", F.col("part") * 2 + 1)))
    for c in ("a", "b"):
        if grown is None:
            e = e.withColumns({f"size_{c}": F.lit(1).cast("long"), f"last_{c}": F.col(c)})
        else:
            e = e.join(grown.select("tree", "part", F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("last").alias(f"last_{c}")), ["tree", "part", c], "left").withColumns({f"size_{c}": F.coalesce(f"size_{c}", F.lit(1)), f"last_{c}": F.coalesce(f"last_{c}", c)})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["group", "r"])
        top, state, rows = {}, {}, []

        def find(i: int) -> int:
            while top.get(i, i) != i:
                top[i] = top.get(top[i], top[i])
                i = top[i]
            return i

        ends = (e.tolist() for e in keyed(g, "a", "b"))
        for n, r, a, b, sa, la, sb, lb in zip(*(g[c].tolist() for c in ("n", "r")), *ends, *(g[c].tolist() for c in ("size_a", "last_a", "size_b", "last_b")), strict=True):
            i, j = find(a), find(b)
            (si, li), (sj, lj) = state.get(i, (sa, la)), state.get(j, (sb, lb))
            top[max(i, j)] = min(i, j)
            state[min(i, j)] = si + sj, n + r
            rows.append((li, lj, si + sj))
        left, right, size = np.array(rows).T
        return pd.DataFrame({"tree": g["tree"], "n": g["n"], "r": g["r"], "left": left, "right": right, "distance": g["w"], "size": size})

    return together(e, ["tree", "part"], merge, "tree string, n long, r long, left long, right long, distance double, size long")


def inverse(distance: Column) -> Column:
    return F.when(distance > 0, 1 / distance).otherwise(float("inf"))


def condensed(merges: DataFrame, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, n, parent, child, lambda_val, child_size of merges (tree, n, r, left, right, distance, size, least).

    A merge of two sides of at least `least` points (2 or more) splits its cluster; a smaller side's points fall out of it. The
    root is cluster n; others are numbered from n + 1, later merges first, left before right.
    """
    m = merges.withColumn("id", F.col("n") + F.col("r"))
    top = m.agg(F.max("id")).first()[0] or 0
    kids = m.select("tree", "n", "least", F.col("id").alias("parent"), "distance", F.posexplode(F.array("left", "right")).alias("side", "id"))
    kids = kids.join(m.select("tree", "id", "size"), ["tree", "id"], "left").withColumn("size", F.coalesce("size", F.lit(1)))
    big = (F.col("size") >= F.col("least")).cast("int")
    kids = steps.cut(kids.withColumn("big", big == 1).withColumn("both", F.sum(big).over(Window.partitionBy("tree", "parent")) == 2))
    # A large side without a large twin goes on as its parent's cluster; others, and the root, begin one.
    heads = kids.filter("big AND both").select("tree", "n", "id", "parent", "distance", "size", (-F.col("parent")).alias("late"), "side")
    names = numbered(heads, ["tree"], ["late", "side"], steps, "k", "_k").drop("_k", "late", "side").withColumn("name", F.col("n") + 1 + F.col("k"))
    names = steps.cut(names.drop("k"))
    goes = follow(kids.filter("big AND NOT both").select("tree", "id", F.col("parent").alias("next")), top + 1, steps, span)
    goes = steps.cut(goes.join(names.select("tree", F.col("id").alias("end"), "name"), ["tree", "end"], "left").select("tree", "id", "name"))
    named = goes.unionByName(names.select("tree", "id", "name"))
    owner = lambda rows, c: rows.join(named.withColumnRenamed("id", c), ["tree", c], "left").withColumn("name", F.coalesce("name", "n"))
    falls = follow(kids.filter("NOT big").select("tree", "id", F.col("parent").alias("next")), top + 1, steps, span)
    points = falls.join(m.select("tree", F.col("id").alias("end"), "n", "distance"), ["tree", "end"]).filter("id < n")
    out = owner(points, "end").select("tree", "n", F.col("name").alias("parent"), F.col("id").alias("child"), inverse(F.col("distance")).alias("lambda_val"), F.lit(1).cast("long").alias("child_size"))
    born = owner(names.withColumnRenamed("name", "child"), "parent").select("tree", "n", F.col("name").alias("parent"), "child", inverse(F.col("distance")).alias("lambda_val"), F.col("size").alias("child_size"))
    return out.unionByName(born)


def _up(g: pd.DataFrame) -> pd.DataFrame:
    """Whether each cluster outweighs the best of those below it. Clusters come with what earlier spans found below them."""
    g = g.sort_values(["group", "cluster"], ascending=False)
    own, over = (e.tolist() for e in keyed(g, "cluster", "parent"))
    below, kids = dict(zip(own, g["below"], strict=True)), dict(zip(own, g["kids"], strict=True))
    rows = []
    for c, up, p, score, leaf, root_ok in zip(own, over, g["parent"].tolist(), g["score"].tolist(), g["leaf"].tolist(), g["root_ok"].tolist(), strict=True):
        chosen = kids[c] == 0 if leaf else not (kids[c] and below[c] > score)
        best = score if chosen or (p < 0 and not root_ok) else below[c]
        if up in below:
            below[up] += best
            kids[up] += 1
        rows.append((best, bool(chosen and (p >= 0 or root_ok))))
    best, chosen = zip(*rows, strict=True)
    return pd.DataFrame({"tree": g["tree"], "cluster": g["cluster"], "parent": g["parent"], "best": best, "chosen": chosen})


def _down(g: pd.DataFrame) -> pd.DataFrame:
    """Each cluster's mark: its parent's, or its own if that has none. Parents of other spans come as `above`."""
    g = g.sort_values(["group", "cluster"])
    mark: dict[int, int] = {}
    for c, p, above, own in zip(*(e.tolist() for e in keyed(g, "cluster", "parent")), g["above"].tolist(), g["own"].tolist(), strict=True):
        mark[c] = mark[p] if mark.get(p, -1) >= 0 else above if above >= 0 else own
    return pd.DataFrame({"tree": g["tree"], "cluster": g["cluster"], "mark": list(mark.values())})


def _sweep_up(k: DataFrame, spans: int, span: int, steps: Steps) -> DataFrame:
    """tree, cluster, chosen: from the last clusters to the root, a span of numbers at a time."""
    out = carried = None
    for s in range(spans - 1, -1, -1):
        part = k.filter(F.floor(F.col("k") / span) == s)
        if carried is None:
            part = part.withColumns({"below": F.lit(0.0), "kids": F.lit(0).cast("long")})
        else:
            sums = carried.groupBy("tree", "parent").agg(F.sum("best").alias("below"), F.count("*").alias("kids")).withColumnRenamed("parent", "cluster")
            part = part.join(sums, ["tree", "cluster"], "left").fillna(0, ["below", "kids"])
        found = steps.cut(together(part.select("tree", "cluster", "parent", "score", "leaf", "root_ok", "below", "kids"), ["tree"], _up, "tree string, cluster long, parent long, best double, chosen boolean"))
        out = found if out is None else out.unionByName(found)
        carried = out
    return out.select("tree", "cluster", "chosen")


def _sweep_down(k: DataFrame, own: Column, spans: int, span: int, steps: Steps) -> DataFrame:
    """tree, cluster, mark: the topmost own (a cluster, or -1) from the root to the cluster; -1 if none."""
    rows = k.select("tree", "cluster", "parent", "k", own.alias("own"))
    out = None
    for s in range(spans):
        part = rows.filter(F.floor(F.col("k") / span) == s)
        if out is None:
            part = part.withColumn("above", F.lit(-1).cast("long"))
        else:
            part = part.join(out.select("tree", F.col("cluster").alias("parent"), F.col("mark").alias("above")), ["tree", "parent"], "left").fillna(-1, ["above"])
        found = steps.cut(together(part.select("tree", "cluster", "parent", "above", "own"), ["tree"], _down, "tree string, cluster long, mark long"))
        out = found if out is None else out.unionByName(found)
    return out


def clusters_of(tree: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """The condensed rows with lambdas capped at their tree's largest finite one, and the clusters: tree, n, cluster, k (from 0),
    parent (-1 of the root), birth, score (their stability), kids, and the caller's columns, which are one for each tree."""
    finite = F.max(F.when(F.col("lambda_val") < float("inf"), F.col("lambda_val")))
    caps = tree.groupBy("tree").agg(F.coalesce(finite, F.lit(1.0)).alias("cap"))
    rows = steps.cut(tree.join(caps, "tree").withColumn("lam", F.least("lambda_val", "cap")).drop("cap"))
    born = rows.filter("child > n").select("tree", "n", F.col("child").alias("cluster"), "parent", F.col("lam").alias("birth"))
    roots = rows.select("tree", "n").distinct().select("tree", "n", F.col("n").alias("cluster"), F.lit(-1).cast("long").alias("parent"), F.lit(0.0).alias("birth"))
    k = born.unionByName(roots)
    own = rows.groupBy("tree", F.col("parent").alias("cluster")).agg(F.sum("child_size").alias("total"), F.sum(F.col("lam") * F.col("child_size")).alias("mass"))
    return rows, k.join(own, ["tree", "cluster"], "left").withColumn("score", F.coalesce(F.col("mass") - F.col("birth") * F.col("total"), F.lit(0.0))).withColumn("k", F.col("cluster") - F.col("n")).drop("mass", "total")


def selected(tree: DataFrame, config: DataFrame, steps: Steps, span: int = SPAN) -> DataFrame:
    """tree, pos, label, prob, cluster of the points that have one, from condensed trees (tree, n, parent, child, lambda_val, child_size).

    config: tree, of (the name that the result has instead), leaf, root_ok, epsilon; several may read one tree. Labels are in
    order of their first points. prob: the point's lambda over the largest in its cluster. Clusters are settled a span at a time.
    """
    rows, k = clusters_of(tree, steps)
    k = steps.cut(k.join(config, "tree").withColumnRenamed("tree", "_of").withColumnRenamed("of", "tree"))
    last = k.agg(F.max("k")).first()[0] or 0
    spans = last // span + 1
    chosen = _sweep_up(k, spans, span, steps)
    if k.filter("epsilon > 0").take(1):
        # A chosen cluster that parted at under epsilon gives way to its first ancestor that parted at more, or to the root's child.
        stays = (F.col("parent") < 0) | (1 / F.greatest("birth", F.lit(1e-300)) >= F.col("epsilon")) | ((F.col("parent") == F.col("n")) & ~F.col("root_ok"))
        climbs = k.filter(~stays).select("tree", (F.lit(last + 1) - F.col("k")).alias("id"), (F.lit(last + 1) - (F.col("parent") - F.col("n"))).alias("next"))
        ends = follow(climbs, last + 2, steps, span).join(k.select("tree", "n").distinct(), "tree").select("tree", (F.lit(last + 1) - F.col("id") + F.col("n")).alias("cluster"), (F.lit(last + 1) - F.col("end") + F.col("n")).alias("to"))
        up = chosen.filter("chosen").join(ends, ["tree", "cluster"], "left").select("tree", F.coalesce("to", "cluster").alias("cluster")).distinct()
        chosen = steps.cut(up.withColumn("chosen", F.lit(True)))
    marks = _sweep_down(k.join(chosen, ["tree", "cluster"], "left"), F.when(F.coalesce("chosen", F.lit(False)), F.col("cluster")).otherwise(-1).cast("long"), spans, span, steps)
    count = chosen.filter("chosen").groupBy("tree").agg(F.count("*").alias("chosen_count"))
    owned = marks.filter("mark >= 0").join(k.select("tree", "cluster", "_of", "n", "root_ok", "epsilon"), ["tree", "cluster"]).join(count, "tree")
    members = rows.filter("child < n").select(F.col("tree").alias("_of"), F.col("parent").alias("cluster"), F.col("child").alias("pos"), "lam")
    got = steps.cut(members.join(owned, ["_of", "cluster"]))
    most = got.groupBy("tree", "mark").agg(F.max("lam").alias("most"))
    # Of one cluster that is all, what leaves it at more than epsilon is noise.
    kept = got.filter(~((F.col("mark") == F.col("n")) & F.col("root_ok") & (F.col("chosen_count") == 1) & (F.col("epsilon") > 0) & (F.col("lam") < 1 / F.col("epsilon"))))
    first = numbered(kept.groupBy("tree", "mark").agg(F.min("pos").alias("first")), ["tree"], ["first"], steps, "label", "_n").select("tree", "mark", "label")
    out = kept.join(first, ["tree", "mark"]).join(most, ["tree", "mark"])
    return out.select("tree", "pos", F.col("label").cast("int").alias("label"), F.when(F.col("most") > 0, F.col("lam") / F.col("most")).otherwise(1.0).alias("prob"), F.col("mark").alias("cluster"))
