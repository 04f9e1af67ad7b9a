"""HDBSCAN of one array in NumPy, as the engine's tables are held against it: a tree over all items, one step at a time."""

from types import SimpleNamespace

import numpy as np


def _from(x: np.ndarray, i: int, metric: str) -> np.ndarray:
    return np.round(1 - np.clip(x @ x[i], -1, 1) if metric == "cosine" else np.sqrt(((x - x[i]) ** 2).sum(1)), 6)


def core_distances(x: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Each row's distance to its k-th nearest other row (to the farthest, if there are fewer)."""
    k = min(k, len(x) - 1)
    return np.array([np.partition(np.delete(_from(x, i, metric), i), k - 1)[k - 1] if k > 0 else 0.0 for i in range(len(x))])


def spanning_tree(x: np.ndarray, core: np.ndarray, metric: str) -> np.ndarray:
    """Prim's tree over mutual reachability: rows (a, b, weight), lightest first; ties by the smaller, then larger end."""
    n = len(x)
    best, via, out = np.full(n, np.inf), np.zeros(n, int), []
    open_, at = np.ones(n, bool), 0
    open_[0] = False
    for _ in range(n - 1):
        w = np.maximum(np.maximum(_from(x, at, metric), core), core[at])
        better = open_ & (w < best)
        best[better], via[better] = w[better], at
        at = int(np.argmin(np.where(open_, best, np.inf)))
        open_[at] = False
        out.append((min(at, via[at]), max(at, via[at]), best[at]))
    return np.array(sorted(out, key=lambda e: (e[2], e[0], e[1]))).reshape(-1, 3)


def single_linkage(edges: np.ndarray, n: int) -> np.ndarray:
    """Merges (left, right, distance, size); node n + i is the i-th merge."""
    top, size, out = list(range(2 * n)), [1] * n + [0] * n, []

    def find(a: int) -> int:
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    for i, (a, b, w) in enumerate(edges):
        a, b = find(int(a)), find(int(b))
        size[n + i] = size[a] + size[b]
        top[a] = top[b] = n + i
        out.append((a, b, w, size[n + i]))
    return np.array(out).reshape(-1, 4)


def condense(merges: np.ndarray, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, lambda, size): clusters are numbered from n (the root) on; children under least fall out as points."""
    if n < 2:
        return []
    members: dict[int, list[int]] = {}

    def points(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            a = stack.pop()
            if a < n:
                out.append(a)
            else:
                stack += [int(merges[a - n][0]), int(merges[a - n][1])]
        return out

    out, names, stack = [], n + 1, [(2 * n - 2, n)]
    while stack:
        node, name = stack.pop()
        while node >= n:
            left, right, d, _ = merges[node - n]
            lam = 1 / d if d > 0 else np.inf
            sides = [(int(c), 1 if c < n else int(merges[int(c) - n][3])) for c in (left, right)]
            large = [c for c in sides if c[1] >= least]
            if len(large) == 2:
                for c, s in large:
                    out.append((name, names, lam, s))
                    stack.append((c, names))
                    names += 1
                break
            for c, s in sides:
                if s < least:
                    out += [(name, p, lam, 1) for p in points(c)]
            if not large:
                break
            node = large[0][0]
        else:
            out.append((name, node, np.inf, 1))
    return out


def select(tree: list[tuple[int, int, float, int]], n: int, c: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """Labels and membership of the points 0 to n - 1; labels are in order of their first member."""
    labels, prob = np.full(n, -1), np.zeros(n)
    if not tree:
        return labels, prob
    finite = [lam for *_, lam, _ in tree if np.isfinite(lam)]
    cap = max(finite, default=1.0)
    rows = [(p, ch, min(lam, cap), s) for p, ch, lam, s in tree]
    clusters = sorted({p for p, *_ in rows} | {ch for _, ch, _, _ in rows if ch >= n})
    birth = {n: 0.0} | {ch: lam for _, ch, lam, _ in rows if ch >= n}
    kids: dict[int, list[int]] = {k: [] for k in clusters}
    score = dict.fromkeys(clusters, 0.0)
    for p, ch, lam, s in rows:
        score[p] += (lam - birth[p]) * s
        if ch >= n:
            kids[p].append(ch)
    chosen: set[int] = set()
    if c.selection == "leaf":
        chosen = {k for k in clusters if not kids[k] and (k != n or c.allow_single_cluster)}
    else:
        for k in reversed(clusters):
            below = sum(score[x] for x in kids[k])
            if k == n and not c.allow_single_cluster:
                continue
            if kids[k] and below > score[k]:
                score[k] = below
            else:
                chosen.add(k)
    parent = {ch: p for p, ch, _, _ in rows if ch >= n}
    if c.epsilon > 0:
        up = set()
        for k in chosen:
            while k != n and 1 / max(birth[k], 1e-300) < c.epsilon and (parent[k] != n or c.allow_single_cluster):
                k = parent[k]
            up.add(k)
        chosen = up

    def covered(k: int) -> int | None:
        found = None
        while True:
            if k in chosen:
                found = k
            if k == n:
                return found
            k = parent[k]

    owner = {k: covered(k) for k in clusters}
    most: dict[int, float] = {}
    for p, ch, lam, _ in rows:
        if ch < n and owner[p] is not None:
            most[owner[p]] = max(most.get(owner[p], 0.0), lam)
    for p, ch, lam, _ in rows:
        if ch < n and owner[p] is not None:
            if owner[p] == n and c.allow_single_cluster and len(chosen) == 1 and c.epsilon and lam < 1 / c.epsilon:
                continue
            labels[ch], prob[ch] = owner[p], (lam / most[owner[p]] if most[owner[p]] else 1.0)
    order = {k: i for i, k in enumerate(dict.fromkeys(labels[labels >= 0].tolist()))}
    return np.array([order.get(v, -1) for v in labels]), prob


def trees(x: np.ndarray, least: int, samples: int) -> tuple[np.ndarray, list[tuple[int, int, float, int]]]:
    """The single-linkage and the condensed tree; distances at 6 decimals."""
    merges = single_linkage(spanning_tree(x, core_distances(x, samples, "euclidean"), "euclidean"), len(x))
    return merges, condense(merges, len(x), least)


def fit(x: np.ndarray, least: int, samples: int, **more) -> tuple[np.ndarray, np.ndarray]:
    c = SimpleNamespace(**{"selection": "eom", "allow_single_cluster": False, "epsilon": 0.0} | more)
    return select(trees(x, least, samples)[1], len(x), c) if len(x) > 1 else (np.full(len(x), -1), np.zeros(len(x)))
