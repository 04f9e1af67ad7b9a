"""Searches over all pairs of rows: tasks multiply pairs of large blocks, a tile at a time.

A tile's distances come from one product of matrices, which errs in its last places. They only tell which pairs can count; these,
few of a tile, are measured by their differences. So results are those of plain distances, at 6 decimals.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.steps import held

#: Rows that a block has before there are SPREAD blocks; rows that it has at most; rows and columns of a tile; pairs measured at a time.
LEAST, SPREAD, LARGE, TILE, PIECE = 2048, 12, 1 << 15, 1024, 1 << 15
#: Rows that tell whether single precision serves a pair of blocks; pairs that wait before they are sorted in; blocks of rows whose
#: neighbours are searched, before they have LARGE rows.
SAMPLE, HELD, ASKED = 256, 1 << 14, 36
#: How many times a product's error a squared distance is at least where it serves.
CLOSE = 1e8


def _blocks(least: int, spread: int = SPREAD) -> Column:
    return F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / least), F.greatest(F.lit(spread), F.ceil(F.col("n") / LARGE)))).cast("long")


def packed(rows: DataFrame, fields: tuple[str, ...] = (), least: int = LEAST, place: Column | None = None, spread: int = SPREAD) -> DataFrame:
    """tree, n, block, blocks, width, and as bytes pos (long), vec (floats of width bytes) and each of fields (doubles).
    rows: tree, n, pos, embedding, fields.

    Rows are dealt by hash, or are in order of place (0 to n - 1), so many to a block.
    """
    blocks = _blocks(least, spread)
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    of = F.pmod(F.xxhash64("pos"), "blocks") if place is None else F.floor(F.col("at") * F.col("blocks") / F.col("n"))
    dealt = rows.select("tree", "pos", "embedding", *fields, blocks.cast("long").alias("blocks"), "n", (F.col("pos") if place is None else place).alias("at")).withColumn("block", of)

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        vec = np.array([np.asarray(v, float) for v in g["embedding"]], np.float32 if single else float)
        one = {"tree": g["tree"].iloc[0], "n": g["n"].iloc[0], "block": g["block"].iloc[0], "blocks": g["blocks"].iloc[0], "width": vec.itemsize, "pos": g["pos"].to_numpy(np.int64).tobytes(), "vec": vec.tobytes()}
        return pd.DataFrame([one | {f: g[f].to_numpy(float).tobytes() for f in fields}])

    return dealt.groupBy("tree", "block").applyInPandas(pack, ", ".join(["tree string, n long, block long, blocks long, width long, pos binary, vec binary", *(f"{f} binary" for f in fields)]))


def _side(blocks: DataFrame) -> Column:
    return F.struct("block", *(c for c in blocks.columns if c not in ("tree", "n", "block", "blocks")))


def _tasks(blocks: DataFrame) -> int:
    """Over how many tasks pairs of blocks are dealt: many for each core, as hashes are uneven and few bytes are much work."""
    return 12 * blocks.sparkSession.sparkContext.defaultParallelism


def each_pair(blocks: DataFrame) -> DataFrame:
    """tree, lo, hi, a, b: each pair of a tree's blocks once, a the block lo, b the block hi (null if they are one)."""
    with_ = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = with_.select("tree", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), _side(blocks).alias("side"))
    sides = pair.repartition(_tasks(blocks), "tree", "lo", "hi").groupBy("tree", "lo", "hi").agg(F.sort_array(F.collect_list("side")).alias("s"))
    return sides.filter((F.col("lo") == F.col("hi")) | (F.size("s") == 2)).select("tree", "lo", "hi", F.col("s")[0].alias("a"), F.try_element_at("s", F.lit(2)).alias("b"))


def across(left: DataFrame, right: DataFrame) -> DataFrame:
    """tree, a, b: each block of left with each of right in its tree."""
    a = left.select("tree", _side(left).alias("a"), F.col("block").alias("_a"))
    b = right.select("tree", _side(right).alias("b"), F.col("block").alias("_b"))
    return a.join(b, "tree").repartition(_tasks(left), "tree", "_a", "_b").select("tree", "a", "b")


class Rows:
    """What a block's bytes hold: pos, x (a row each) and the fields."""

    def __init__(self, side):
        self.pos = np.frombuffer(side["pos"], np.int64)
        single = "width" in side and side["width"] == 4
        self.x = np.frombuffer(side["vec"], np.float32 if single else float).astype(float, copy=False).reshape(len(self.pos), -1)
        self.side = side

    def __len__(self) -> int:
        return len(self.pos)

    def field(self, name: str) -> np.ndarray:
        return np.frombuffer(self.side[name], float)


class Product:
    """Distances of rows of x to rows of y: of tiles, roughly and on a scale of its own, and of single pairs.

    Tiles are in single precision, unless its error counts beside the distances of a sample, or double says so.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str, double: bool = False):
        self.cosine, self.slack = metric == "cosine", 0.0
        if self.cosine:
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8) for m in (x, y))
        self.x, self.y = x, y
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        self.odd = not (np.isfinite(xx).all() and np.isfinite(yy).all())  # no product then
        if self.odd:
            return
        ones = [np.ones((len(m), 1)) for m in (x, y)]
        if self.cosine:
            self.left, self.right, scale = np.hstack([x, ones[0]]), np.hstack([-y, ones[1]]), 1.0
        else:
            self.left, self.right, scale = np.hstack([x, xx[:, None], ones[0]]), np.hstack([-2 * y, ones[1], yy[:, None]]), xx.max(initial=0) + yy.max(initial=0)
            self.slack = 4.5e-16 * (x.shape[1] + 16) * scale
        rough = 2.4e-7 * (x.shape[1] + 16) * scale + 1e-36
        if not double and len(x) >= SAMPLE and len(y) >= SAMPLE and scale < 1e30:
            some = self.left[:SAMPLE] @ self.right[: 8 * SAMPLE].T
            if rough < 0.01 * np.median(np.partition(some, 1, axis=1)[:, 1]):  # the least may be the row itself
                self.left, self.right, self.slack = self.left.astype(np.float32), self.right.astype(np.float32), rough

    def tile(self, i: slice, j: slice) -> np.ndarray:
        if self.odd:
            x, y = self.x[i], self.y[j]
            with np.errstate(all="ignore"):
                d = 1 - np.stack([(y * v).sum(1) for v in x]) if self.cosine else np.stack([((y - v) ** 2).sum(1) for v in x])
            return np.where(np.isnan(d), np.inf, d)
        return self.left[i] @ self.right[j].T

    def limit(self, d: np.ndarray) -> np.ndarray:
        """What a tile's value doesn't exceed where the distance, at 6 decimals, doesn't exceed d; -inf stays under all."""
        most = d + 1e-6 + self.slack if self.cosine else np.where(d < 0, d, (d + 1e-6) ** 2 * (1 + 1e-12) + self.slack)
        if self.odd or self.left.dtype != np.float32:
            return most
        with np.errstate(over="ignore"):
            return np.nextafter(most.astype(np.float32), np.float32(np.inf))

    def distance(self, t: np.ndarray) -> np.ndarray:
        """The most that the distance can be where a tile has t."""
        t = t.astype(float)
        return t + 1e-6 + self.slack if self.cosine else np.sqrt(np.maximum(t, 0) + self.slack) + 1e-6

    def exact(self, r: np.ndarray, c: np.ndarray, digits: int | None = 6) -> np.ndarray:
        """The distances of rows r of x to rows c of y, at so many decimals; inf where there is none."""
        out = np.empty(len(r))
        for k in range(0, len(r), PIECE):
            x, y = self.x[r[k : k + PIECE]], self.y[c[k : k + PIECE]]
            with np.errstate(all="ignore"):
                out[k : k + PIECE] = 1 - np.clip((x * y).sum(1), -1, 1) if self.cosine else np.sqrt(((x - y) ** 2).sum(1))
        out = out if digits is None else np.round(out, digits) + 0.0
        return np.where(np.isnan(out), np.inf, out)

    def measured(self, i: slice, j: slice) -> np.ndarray:
        """A tile's distances, of a product in double precision; where its error would count they are measured one by one."""
        t = self.tile(i, j)
        if self.cosine:
            return np.where(t == np.inf, t, np.clip(t, 0, 2))
        r, c = places(t < CLOSE * self.slack)
        np.sqrt(np.maximum(t, 0, out=t), out=t)
        t[r, c] = self.exact(r + i.start, c + j.start, None)
        return t


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what few a mask has; eight of its bytes are looked at as one."""
    if mask.size % 8 or not mask.flags.c_contiguous:
        return np.divmod(np.flatnonzero(mask), mask.shape[1])
    flat = mask.reshape(-1, 8)
    some = np.flatnonzero(flat.view(np.uint64)[:, 0])
    at, of = np.nonzero(flat[some])
    return np.divmod(some[at] * 8 + of, mask.shape[1])


def tiles(n: int, size: int = 0) -> list[slice]:
    size = size or TILE
    return [slice(k, min(k + size, n)) for k in range(0, n, size)]


class Nearest:
    """The k nearest so far of each of n rows, by distance, then id. What is held is not yet among them."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids = k, np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        self.held, self.waiting = [], 0

    def settle(self) -> None:
        if self.held:
            rows, d, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.held, self.waiting = [], 0
            keep = d <= self.d[rows, -1]
            if keep.any():
                self.add(rows[keep], d[keep], ids[keep])

    def add(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows, d, ids = rows[order], d[order], ids[order]
        mine, first, count = np.unique(rows, return_index=True, return_counts=True)
        line, slot = np.repeat(np.arange(len(mine)), count), self.k + np.arange(len(rows)) - np.repeat(first, count)
        # What a row has and what comes, side by side: lines are short, so sorting each costs less than sorting all.
        near, names = np.full((len(mine), self.k + count.max()), np.inf), np.full((len(mine), self.k + count.max()), -1, np.int64)
        near[:, : self.k], names[:, : self.k] = self.d[mine], self.ids[mine]
        near[line, slot], names[line, slot] = d, ids
        for key in (0, 1):
            order = np.argsort((names, near)[key], axis=1, kind="stable")[:, : self.k if key else None]
            near, names = np.take_along_axis(near, order, 1), np.take_along_axis(names, order, 1)
        self.d[mine], self.ids[mine] = near, names

    def see(self, t: np.ndarray, i: slice, j: slice, product: Product, own: np.ndarray, other: np.ndarray, turned: bool) -> None:
        """Takes what a tile t has for its rows i (its columns j, if turned)."""
        mine, axis = (j, 0) if turned else (i, 1)
        limit = product.limit(self.d[mine, -1])
        if np.isinf(limit).any() and t.shape[axis] > self.k + 1:
            least = np.take(np.partition(t, self.k, axis=axis), self.k, axis=axis)  # one may be the row itself
            limit = np.minimum(limit, product.limit(product.distance(least)))
        r, c = places(t <= np.expand_dims(limit, axis))
        r, c = (c + j.start, r + i.start) if turned else (r + i.start, c + j.start)
        keep = own[r] != other[c]
        r, c = r[keep], c[keep]
        d = product.exact(c, r) if turned else product.exact(r, c)
        keep = np.isfinite(d) & (d <= self.d[r, -1])
        if keep.any():
            self.held.append((r[keep], d[keep], other[c[keep]]))
            self.waiting += len(d[keep])
        if self.waiting > HELD or np.isinf(limit).any() or np.isinf(self.d[mine, -1]).any():
            self.settle()

    def frame(self, tree: str, own: np.ndarray) -> pd.DataFrame:
        ok = self.ids >= 0
        return pd.DataFrame({"tree": tree, "pos": np.repeat(own, ok.sum(1)), "near": self.ids[ok], "distance": self.d[ok]})


def nearest(a: Rows, b: Rows | None, k: int, metric: str, both: bool = True, found: Nearest | None = None) -> list[Nearest]:
    """The k nearest of a's rows among b's (or a's own others) and, if both, of b's among a's. found: what a's rows have already."""
    other = a if b is None else b
    product, out = Product(a.x, other.x, metric), [found or Nearest(len(a), k)]
    if both and b is not None:
        out.append(Nearest(len(b), k))
    # Low and wide tiles stay in a core's cache.
    for i in tiles(len(a), max(1, TILE // 4)):
        for j in tiles(len(other), 2 * TILE):
            t = product.tile(i, j)
            out[0].see(t, i, j, product, a.pos, other.pos, False)
            if len(out) > 1:
                out[1].see(t, i, j, product, other.pos, a.pos, True)
                out[1].settle()
        out[0].settle()
    return out


NEAR = "tree string, pos long, near long, distance double"


def _near(asked: DataFrame, given: DataFrame, k: int, metric: str) -> DataFrame:
    """asked: blocks; given: blocks with key, the block of asked that searches them. A task has one block of asked and what its rows
    have found; the given blocks pass by it, and only k neighbours of each row leave it."""

    def search(batches):
        tree = a = found = None
        for batch in batches:
            for name, key, block, side in zip(batch["tree"], batch["key"], batch["block"], batch["side"], strict=True):
                if block < 0:
                    if found is not None:
                        yield found.frame(tree, a.pos)
                    tree, own, a = name, key, Rows(side)
                    found = Nearest(len(a), k)
                elif found is not None and (tree, own) == (name, key):
                    nearest(a, Rows(side), k, metric, False, found)
        if found is not None:
            yield found.frame(tree, a.pos)

    rows = asked.select("tree", F.col("block").alias("key"), F.lit(-1).cast("long").alias("block"), F.struct("width", "pos", "vec").alias("side"))
    rows = rows.unionByName(given.select("tree", "key", "block", F.struct("width", "pos", "vec").alias("side")))
    return rows.repartition(_tasks(asked), held("tree", "key")).sortWithinPartitions("tree", "key", "block").mapInPandas(search, NEAR)


def near_pairs(points: DataFrame, k: int, metric: str, least: int = LEAST) -> DataFrame:
    """tree, pos, near, distance: of each of points (tree, n, pos, embedding) its k nearest others in its tree. Ties go by pos."""
    rows = points.select("tree", "n", "pos", "embedding")
    asked = packed(rows, (), least, spread=ASKED)
    keys = F.explode(F.sequence(F.lit(0).cast("long"), _blocks(least, ASKED) - 1))
    return _near(asked, packed(rows, (), least).withColumn("key", keys), k, metric)


def near_across(queries: DataFrame, points: DataFrame, k: int, metric: str, least: int = LEAST) -> DataFrame:
    """As near_pairs, of queries (tree, n, pos, embedding) among the points of their tree."""
    c = ["tree", "n", "pos", "embedding"]
    asked = packed(queries.select(c), (), least, spread=ASKED)
    return _near(asked, packed(points.select(c), (), least).join(asked.select("tree", F.col("block").alias("key")), "tree"), k, metric)


def measured(a: Rows, b: Rows | None, metric: str):
    """(i, j, d) of all tiles: the distances d of a's rows i to b's rows j (to a's own, itself too, if b is None)."""
    other = a if b is None else b
    product = Product(a.x, other.x, metric, True)
    # Low and wide tiles stay in a core's cache.
    for i in tiles(len(a), max(1, TILE // 4)):
        for j in tiles(len(other), 2 * TILE):
            yield i, j, product.measured(i, j)


def inverse_powers(d: np.ndarray, k: int) -> np.ndarray:
    """d ** -k of distances at 6 decimals, 0 where d is 0; by squares, which costs less than a power each."""
    square, out = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0), None
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                out = square.copy() if out is None else out * square
            k >>= 1
            if k:
                square *= square
    return out


def power_sums(points: DataFrame, metric: str, least: int = LEAST) -> DataFrame:
    """tree, pos, p: the sums of inverse_powers of each of points' (tree, n, pos, embedding) distances in its tree, by as many as its
    dimensions; a row for each block that its own met."""

    def add(batches):
        for batch in batches:
            for tree, one, two in zip(batch["tree"], batch["a"], batch["b"], strict=True):
                a, b = Rows(one), None if two is None else Rows(two)
                p = [np.zeros(len(r)) for r in (a, b) if r is not None]
                for i, j, d in measured(a, b, metric):
                    m = inverse_powers(np.round(d, 6), a.x.shape[1])
                    p[0][i] += m.sum(1)
                    if b is not None:
                        p[1][j] += m.sum(0)
                for rows, sums in zip((a, b), p, strict=False):
                    yield pd.DataFrame({"tree": tree, "pos": rows.pos, "p": sums})

    return each_pair(packed(points, (), least)).mapInPandas(add, "tree string, pos long, p double")


EDGE = "tree string, a long, b long, w double"


def _ends(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(r, c), np.maximum(r, c)


def _leaving(a: Rows, b: Rows, metric: str) -> pd.DataFrame:
    """part, w, a, b: of each part of a's rows the lightest edge under mutual reachability to b's rows of other parts."""
    product, (core, core_b) = Product(a.x, b.x, metric), (r.field("core") for r in (a, b))
    names, part = np.unique(a.field("part"), return_inverse=True)
    part_b = b.field("part")
    best = [(np.inf, -1, -1)] * len(names)
    most = np.full(len(names), np.inf)
    for i in tiles(len(a)):
        for j in tiles(len(b)):
            t = product.tile(i, j)
            t = np.where(a.field("part")[i][:, None] == part_b[j][None], np.inf, t)
            limit = most[part[i]]
            if np.isinf(limit).any():
                at = np.argmin(t, axis=1)
                reach = np.maximum(np.maximum(product.distance(t[np.arange(len(t)), at]), core[i]), core_b[j][at])
                limit = np.minimum(limit, reach)
            r, c = places((t <= product.limit(limit)[:, None]) & np.isfinite(t))
            r, c = r + i.start, c + j.start
            w = np.maximum(np.maximum(product.exact(r, c), core[r]), core_b[c])
            keep = np.isfinite(w) & (w <= most[part[r]])
            r, c, w = r[keep], c[keep], w[keep]
            lo, hi = _ends(a.pos[r], b.pos[c])
            order = np.lexsort((hi, lo, w, part[r]))
            p, first = np.unique(part[r][order], return_index=True)
            for q, e in zip(p, order[first], strict=True):
                best[q] = min(best[q], (w[e], int(lo[e]), int(hi[e])))
                most[q] = best[q][0]
    found = [(int(names[q]), *e) for q, e in enumerate(best) if e[1] >= 0]
    return pd.DataFrame(found, columns=["part", "w", "a", "b"])


def leaving_edges(points: DataFrame, least: int, metric: str) -> DataFrame:
    """tree, part, w, a, b: the lightest edges, one or few for each part but a tree's first, to points of other parts; of infinite
    ones none. points: tree, n, pos, embedding, core, part (-1: the first)."""

    def search(batches):
        for batch in batches:
            for tree, one, two in zip(batch["tree"], batch["a"], batch["b"], strict=True):
                yield _leaving(Rows(one), Rows(two), metric).assign(tree=tree)[["tree", "part", "w", "a", "b"]]

    fields = ("core", "part")
    every = packed(points, fields, least)
    return across(packed(points.filter("part >= 0"), fields, least), every).mapInPandas(search, "tree string, part long, w double, a long, b long")


GAP = ("gap_r", "gap_w", "gap_a", "gap_b")


def _highest(gaps: np.ndarray) -> np.ndarray:
    """Of columns (rank, w, a, b) the one of the highest rank."""
    return gaps[:, np.argmax(gaps[0])] if gaps.shape[1] else np.array([-1, -np.inf, -1, -1])


def _running(gaps: np.ndarray) -> np.ndarray:
    """The column of the highest rank up to each."""
    if not gaps.shape[1]:
        return gaps
    new = np.r_[True, gaps[0, 1:] > np.maximum.accumulate(gaps[0])[:-1]]
    return gaps[:, np.maximum.accumulate(np.where(new, np.arange(gaps.shape[1]), 0))]


def _below(a: Rows, b: Rows | None, between: np.ndarray, metric: str, reduce) -> pd.DataFrame:
    """The pairs that are lighter than the heaviest edge of the path between them. Rows are in the order of the tree's leaves; a gap
    is the heaviest edge between a leaf and the next one, so the heaviest of a path is the highest gap between its ends."""
    other = a if b is None else b
    product, (core, core_b) = Product(a.x, other.x, metric), (r.field("core") for r in (a, other))
    gaps, gaps_b = (np.stack([r.field(g) for g in GAP]) for r in (a, other))
    none = np.array([[-1], [-np.inf], [-1], [-1]], float)
    out, held = [], 0

    def finite(w: np.ndarray) -> np.ndarray:
        # Over an infinite gap there is no finite edge.
        return product.limit(np.where(np.isfinite(w), w, -np.inf))

    for i in tiles(len(a)):
        for j in tiles(len(other)):
            if b is None and j.start < i.start:
                continue
            if b is None and i == j:
                t = product.tile(i, j)
                k = i.stop - i.start
                high = np.full((k, k), -1, int)
                own = gaps[:, i]
                rank = np.argsort(np.argsort(own[0]))
                for row in range(k - 1):
                    high[row, row + 1 :] = np.maximum.accumulate(rank[row : k - 1])
                sorted_ = own[:, np.argsort(own[0])]
                limit = np.append(finite(sorted_[1]), -np.inf)
                r, c = places(t <= limit[high])
                top = sorted_[:, high[r, c]]
            else:
                rest = _highest(np.concatenate([gaps[:, i.stop : j.start], none], 1) if b is None else np.concatenate([gaps[:, i.stop :], between, gaps_b[:, : j.start], none], 1))
                up = _running(np.column_stack([rest, gaps[:, i][:, ::-1]]))[:, :0:-1]
                down = _running(np.column_stack([none, gaps_b[:, j]]))[:, :-1]
                over, under, found = finite(up[1]), finite(down[1])[None], []
                # Low tiles stay in a core's cache.
                for s in tiles(i.stop - i.start, max(1, TILE // 4)):
                    t = product.tile(slice(i.start + s.start, i.start + s.stop), j)
                    mask = t <= over[s, None]
                    mask |= t <= under
                    r, c = places(mask)
                    found.append((r + s.start, c))
                r, c = (np.concatenate(x) for x in zip(*found, strict=True))
                top = np.where(up[0, r] >= down[0, c], up[:, r], down[:, c])
            r, c = r + i.start, c + j.start
            w = np.maximum(np.maximum(product.exact(r, c), core[r]), core_b[c])
            lo, hi = _ends(a.pos[r], other.pos[c])
            less = (w < top[1]) | (w == top[1]) & ((lo < top[2]) | (lo == top[2]) & (hi < top[3]))
            less &= np.isfinite(w)
            if less.any():
                out.append(pd.DataFrame({"a": lo[less], "b": hi[less], "w": w[less]}))
                held += int(less.sum())
                if held > 1 << 20:
                    out = [reduce(pd.concat(out))]
                    held = len(out[0])
    return reduce(pd.concat(out)) if held > 4 * (len(a) + len(other)) else pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "w": []})


def lighter_edges(points: DataFrame, least: int, metric: str, reduce, steps) -> DataFrame:
    """tree, a, b, w: all pairs under mutual reachability that come, by w, a and b, before the last edge of the path between them in a
    spanning tree; where they are many, those that reduce (a lightest tree) leaves of a pair of blocks.

    points: tree, n, pos, embedding, core, place (in the order of the tree's leaves), gap_r, gap_w, gap_a, gap_b (rank, weight and
    ends of the merge that joins the leaf's place and the next).
    """
    blocks = steps.cut(packed(points, ("core", *GAP), least, F.col("place")))

    def highest(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        tops = np.stack([_highest(np.stack([np.frombuffer(x, float) for x in row])) for row in zip(*(g[c] for c in GAP), strict=True)])
        return pd.DataFrame([{"tree": g["tree"].iloc[0], "tops": tops.T.tobytes()}])

    tops = blocks.select("tree", "block", *GAP).groupBy("tree").applyInPandas(highest, "tree string, tops binary")

    def search(batches):
        for batch in batches:
            for tree, lo, hi, one, two, top in zip(batch["tree"], batch["lo"], batch["hi"], batch["a"], batch["b"], batch["tops"], strict=True):
                b = None if two is None else Rows(two)
                between = np.frombuffer(top, float).reshape(4, -1)[:, lo + 1 : hi]
                yield _below(Rows(one), b, between, metric, reduce).assign(tree=tree)[["tree", "a", "b", "w"]].astype({"a": "int64", "b": "int64", "w": float})

    return each_pair(blocks).join(F.broadcast(tops), "tree").mapInPandas(search, EDGE)
