"""Graph and clustering operators: components, spanning trees, greedy choices, density clusters.

Items here are effects, groups or chips, of which there are thousands, not the corpus; what must see a whole
ordered group runs in one task per group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of each component, by minima along edges and their roots until nothing moves."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = roots.join(near, "node").select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = stored(step.join(up, "root").select("node", F.col("top").alias("root"), (F.col("moved") | (F.col("top") < F.col("root"))).alias("moved")))
        roots = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return roots


def greedy_distinct(rows: list[tuple[str, set]], most: float) -> list[str]:
    """Names kept in order, each less alike than most (Jaccard) to all kept before."""
    kept: list[tuple[str, set]] = []
    for name, own in rows:
        if all(len(own & o) < most * len(own | o) or not own | o for _, o in kept):
            kept.append((name, own))
    return [n for n, _ in kept]


def chips(df: DataFrame, group: str, name: str, order: list[str], tokens: str, most: float = 0.7, keep: int = 60) -> DataFrame:
    """Per group, names in order without those near to an earlier one."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        kept = greedy_distinct([(n, set(t)) for n, t in zip(own[name], own[tokens])], most)[:keep]
        return pd.DataFrame({group: [own[group].iloc[0]] * len(kept), name: kept, "place": range(1, len(kept) + 1)})

    return df.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {name} {kinds[name]}, place long")


def leaders(df: DataFrame, group: str, name: str, tokens: str, least: float = 0.6) -> DataFrame:
    """Leader clustering in order of name: a row joins the first leader at least so alike, else leads."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(own: pd.DataFrame) -> pd.DataFrame:
        led: list[tuple[str, set]] = []
        out = []
        for n, t in own.sort_values(name)[[name, tokens]].itertuples(index=False):
            s = set(t)
            head = next((h for h, o in led if len(s & o) >= least * len(s | o)), None)
            if head is None:
                led.append((n, s))
            out.append((own[group].iloc[0], n, head or n))
        return pd.DataFrame(out, columns=[group, name, "leader"])

    return df.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {name} {kinds[name]}, leader {kinds[name]}")


def spanning_tree(points: np.ndarray, far: float = np.inf) -> list[tuple[int, int, float]]:
    """Edges (a, b, length) of the least spanning forest of a distance matrix without edges longer than far (Prim)."""
    n = len(points)
    best, source, out = np.full(n, np.inf), np.full(n, -1), []
    done = np.zeros(n, bool)
    for _ in range(n):
        i = int(np.where(done, np.inf, best).argmin()) if (~done & np.isfinite(best)).any() else int(np.flatnonzero(~done)[0])
        done[i] = True
        if source[i] >= 0 and best[i] <= far:
            out.append((int(source[i]), i, float(best[i])))
        closer = ~done & (points[i] < best)
        best[closer], source[closer] = points[i][closer], i
    return out


def reach_tree(n: int, row: Callable[[int], np.ndarray], near: int) -> list[tuple[int, int, float]]:
    """Edges of the least spanning tree by mutual reachability (Prim), from one row of distances at a time."""
    core = np.array([np.partition(row(i), min(near, n - 1))[min(near, n - 1)] for i in range(n)])
    best, source, done, out, i = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), [], 0
    for _ in range(n):
        done[i] = True
        if source[i] >= 0:
            out.append((int(source[i]), i, float(best[i])))
        reach = np.maximum(np.maximum(row(i), core), core[i])
        closer = ~done & (reach < best)
        best[closer], source[closer] = reach[closer], i
        i = int(np.where(done, np.inf, best).argmin())
    return out


def density_clusters(distance: np.ndarray, least: int = 5, near: int = 5) -> np.ndarray:
    """Labels by density of a distance matrix."""
    return density_labels(len(distance), lambda i: distance[i], least, near)


def density_labels(n: int, row: Callable[[int], np.ndarray], least: int = 5, near: int = 5) -> np.ndarray:
    """HDBSCAN labels (Campello, Moulavi, Sander 2013): mutual reachability, spanning tree, condensed tree, excess of mass; -1 is noise.

    row(i): distances of point i to all.  Memory follows n and time its square, as no matrix is held."""
    if n < least:
        return np.full(n, -1)
    edges = sorted(reach_tree(n, row, near), key=lambda e: e[2])
    parent = list(range(2 * n))
    size = [1] * n + [0] * n
    merge: dict[int, tuple[int, int, float]] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    node = n
    for a, b, d in edges:
        x, y = find(a), find(b)
        merge[node] = (x, y, d)
        size[node] = size[x] + size[y]
        parent[x] = parent[y] = node
        node += 1
    strength: dict[int, float] = {}
    born: dict[int, float] = {}
    children: dict[int, list[int]] = {}

    def leaves(x: int) -> list[int]:
        out, stack = [], [x]
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += merge[y][:2]
        return out

    root = node - 1
    stack = [(root, root)]
    born[root], strength[root], children[root] = 0.0, 0.0, []
    while stack:
        x, cluster = stack.pop()
        if x < n:
            continue
        a, b, d = merge[x]
        level = 1 / d if d > 0 else 1e12
        big = [y for y in (a, b) if size[y] >= least]
        if len(big) == 2:
            strength[cluster] += (level - born[cluster]) * size[x]
            for y in big:
                born[y], strength[y], children[y] = level, 0.0, []
                children[cluster].append(y)
                stack.append((y, y))
        else:
            gone = sum(size[y] for y in (a, b) if size[y] < least)
            strength[cluster] += (level - born[cluster]) * gone
            stack += [(y, cluster) for y in big]
    chosen: set[int] = set()
    worth: dict[int, float] = {}
    for c in sorted(born, key=lambda c: size[c]):
        below = sum(worth[k] for k in children[c])
        if c == root or below > strength[c]:
            worth[c] = below
        else:
            worth[c] = strength[c]
            stack = list(children[c])
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += children[k]
            chosen.add(c)
    labels, members = np.full(n, -1), {c: leaves(c) for c in chosen}  # chosen clusters share no point
    for k, c in enumerate(sorted(chosen, key=lambda c: min(members[c]))):
        labels[members[c]] = k
    return labels


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ends of blocks by x and their means, to be read by interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            top = blocks.pop()
            low = blocks[-1]
            low[1] = (low[1] * low[2] + top[1] * top[2]) / (low[2] + top[2])
            low[2] += top[2]
            low[0] = top[0]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])
