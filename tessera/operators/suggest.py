"""Groups suggested for lines of text, by the lines of their members.

Score of a group for a line: z of its best member similarity plus z of its part of the K most similar lines, squared, over the fourth root of its size.
Both z are over ALL groups; groups that share no word with the line count with 0 through their number, so only sums travel.  An
owner's own lines never speak for it: they count -1, and a group that has no others has -1 as its best.

Lines of members meet queries in blocks of bounded size: a task holds BLOCK lines at about and CHUNK queries, adds up products in place, and emits per query and
block its K best lines, its KEPT best groups, the groups of those lines and two sums, never pairs.  What a query gathers is so bounded by blocks.
Groups larger than a block are spread over blocks by line and their bests meet afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

K, KEPT, BLOCK, CHUNK, LEAST_DF = 25, 7, 16384, 4096, 2
#: Bounds of the confidence, most for lines that are reminders only, tokens of the buckets, least points of a bucket's own curve, cards to calibrate on.
BOUNDS, REMINDER, BUCKETS, OWN_CURVE, SAMPLE = (0.02, 0.99), 0.25, (3, 6), 1500, 6000
_FOUND = pa.schema([("kind", pa.int32()), ("q", pa.int64()), ("gid", pa.string()), ("heavy", pa.bool_()), ("line", pa.int64()), ("a", pa.float64()), ("b", pa.float64())])


def _weighted(lines: DataFrame) -> DataFrame:
    """(side, line, t, v): hashes of the terms of each line and their TF-IDF weights of length 1; terms: side, line, terms."""
    n = F.lit(lines.count())
    tf = lines.select("side", "line", F.explode("terms").alias("term")).groupBy("side", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= LEAST_DF).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(df, "term").select("side", "line", F.xxhash64("term").alias("t"), ((1 + F.log("tf")) * F.col("idf")).alias("v"))
    out = w.groupBy("side", "line").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return out.select("side", "line", F.col("p.t").alias("t"), F.transform("p.v", lambda v: v / F.col("l")).alias("v"))


def _lists(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], column.type)
    sizes = np.array([0 if x is None else x for x in flat.value_lengths().to_pylist()], np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), flat.flatten().to_numpy(zero_copy_only=False).astype(kind)


def score_block(members: pa.Table, queries: pa.Table, k: int, kept: int) -> pa.Table:
    """What one block of member lines says about one chunk of queries."""
    order = members.sort_by([("gid", "ascending"), ("line", "ascending")])
    gids = order["gid"].to_pylist()
    starts = np.array([i for i in range(len(gids)) if not i or gids[i] != gids[i - 1]], np.int64)
    names, heavy = [gids[i] for i in starts], np.array(order["heavy"].to_pylist(), bool)[starts]
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(gids)]))
    line, weight = np.array(order["line"].to_pylist(), np.int64), np.array(order["weight"].to_pylist(), float)
    own: dict[str, list[int]] = {}
    for i, o in enumerate(order["owner"].to_pylist()):
        own.setdefault(o, []).append(i)
    ends, terms = _lists(order["t"], np.int64)
    _, values = _lists(order["v"], float)
    holder = np.repeat(np.arange(len(gids)), np.diff(ends))
    by_term = np.argsort(terms, kind="stable")
    terms, values, holder = terms[by_term], values[by_term], holder[by_term]
    rows: list[tuple] = []
    q_ends, q_terms = _lists(queries["t"], np.int64)
    _, q_values = _lists(queries["v"], float)
    place = {g: i for i, g in enumerate(names)}
    for r, (q, owner, excluded) in enumerate(zip(queries["q"].to_pylist(), queries["owner"].to_pylist(), queries["excluded"].to_pylist())):
        sim = np.zeros(len(gids))
        asked = slice(q_ends[r], q_ends[r + 1])
        for t, v, a, b in zip(q_terms[asked], q_values[asked], np.searchsorted(terms, q_terms[asked], "left"), np.searchsorted(terms, q_terms[asked], "right")):
            sim[holder[a:b]] += values[a:b] * v
        sim = np.round(sim * weight, 9)
        sim[own.get(owner, []) if owner is not None else []] = -1
        best = np.maximum.reduceat(sim, starts)
        whole = best[~heavy]
        rows.append((0, q, None, False, None, whole.sum(), (whole * whole).sum()))
        positive = np.flatnonzero(sim > 0)
        top = positive[np.lexsort((line[positive], -sim[positive]))[:k]]
        rows += [(1, q, names[group[i]], False, int(line[i]), sim[i], 0.0) for i in top]
        barred = {place[g] for g in excluded or [] if g in place}
        free = np.array([i for i in range(len(names)) if i not in barred], np.int64)
        near = set(free[np.lexsort((free, -best[free]))[:kept]].tolist()) | {int(g) for g in group[top]} | set(np.flatnonzero(heavy).tolist())
        rows += [(2, q, names[g], bool(heavy[g]), None, best[g], float(g in barred)) for g in sorted(near)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND) if rows else _FOUND.empty_table()


def suggestions(members: DataFrame, queries: DataFrame, k: int = K, kept: int = KEPT, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(q, gid, score) of the kept best groups of each query line, ties by gid.

    members: gid, owner, line (a number of its own), weight, terms; queries: q (a number of its own), owner, excluded (groups never offered), terms.
    A group's size is its number of owners.  Lines without known terms count with 0; a null owner owns no line.
    """
    lines = members.select(F.lit(0).alias("side"), "line", "terms").unionByName(queries.select(F.lit(1).alias("side"), F.col("q").alias("line"), "terms"))
    vectors = stored(_weighted(lines))
    sizes = members.groupBy("gid").agg(F.count(F.lit(1)).alias("lines"), F.greatest(F.count_distinct("owner"), F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("groups")).first()
    blocks = max(1, -(-(total["lines"] or 0) // block))
    chunks = max(1, -(-queries.count() // chunk))
    heavy = F.col("lines") > block
    owner = F.col("owner").cast("string")
    of = lambda side, name: vectors.where(F.col("side") == side).toDF("side", name, "t", "v").drop("side")
    left = members.join(of(0, "line"), "line", "left").join(sizes.select("gid", "lines"), "gid").withColumn("heavy", heavy)
    cell = F.when(F.col("heavy"), F.pmod(F.xxhash64("line"), F.lit(blocks))).otherwise(F.pmod(F.xxhash64("gid"), F.lit(blocks)))
    left = left.select(cell.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "gid", "heavy", "line", owner.alias("owner"), "weight", "t", "v")
    right = queries.join(of(1, "q"), "q", "left")
    right = right.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("chunk"), "q", owner.alias("owner"), "excluded", "t", "v")

    def run(m: pa.Table, q: pa.Table) -> pa.Table:
        return score_block(m, q, k, kept) if m.num_rows and q.num_rows else _FOUND.empty_table()

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, "kind int, q bigint, gid string, heavy boolean, line bigint, a double, b double")
    found = stored(found)
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("kind", "q").orderBy(F.desc("a"), "line"))).where((F.col("kind") == 1) & (F.col("place") <= k))
    part = best.groupBy("q", "gid").agg(F.sum(F.col("a") * F.col("a")).alias("mass")).join(sizes.select("gid", "size"), "gid").withColumn("mass", F.col("mass") / F.pow("size", F.lit(0.25)))
    groups = found.where("kind = 2").groupBy("q", "gid").agg(F.max("a").alias("best"), F.bool_or("heavy").alias("heavy"), F.max("b").alias("barred"))
    one = groups.where("heavy").select("q", F.col("best").alias("a"), (F.col("best") * F.col("best")).alias("b"), F.lit(0.0).alias("m"))
    sums = found.where("kind = 0").select("q", "a", "b", F.lit(0.0).alias("m")).unionByName(one).unionByName(part.select("q", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.col("mass").alias("m")))
    sums = sums.groupBy("q").agg(*[F.sum(c).alias(n) for c, n in ((F.col("a"), "s1"), (F.col("b"), "s2"), (F.col("m"), "m1"), (F.col("m") * F.col("m"), "m2"))])
    n = F.lit(float(total["groups"] or 1))
    z = lambda x, s, ss: (x - F.col(s) / n) / (F.sqrt(F.greatest(F.col(ss) / n - (F.col(s) / n) * (F.col(s) / n), F.lit(0.0))) + 1e-9)
    scored = groups.where("barred = 0").join(part.select("q", "gid", "mass"), ["q", "gid"], "left").join(sums, "q")
    scored = scored.select("q", "gid", (z(F.col("best"), "s1", "s2") + z(F.coalesce("mass", F.lit(0.0)), "m1", "m2")).alias("score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "gid"))
    return scored.withColumn("place", place).where(F.col("place") <= kept).select("q", "gid", "score", "place")


def by_owner(found: DataFrame, queries: DataFrame, kept: int = KEPT) -> DataFrame:
    """(owner, gid, score, n_tokens, kind, place): each owner's kept best groups by their best line; queries: q, owner, n_tokens, kind."""
    each = found.join(queries.select("q", "owner", "n_tokens", "kind"), "q")
    best = each.groupBy("owner", "gid").agg(F.max_by(F.struct("score", "n_tokens", "kind"), F.struct(F.round("score", 6), -F.col("q"))).alias("b"))
    best = best.select("owner", "gid", "b.score", "b.n_tokens", "b.kind")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.round("score", 6).desc(), "gid"))
    return best.withColumn("place", place).where(F.col("place") <= kept)


def token_bucket(n: Column) -> Column:
    return F.when(n <= BUCKETS[0], 0).when(n <= BUCKETS[1], 1).otherwise(2)


def isotonic_curve(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Non-decreasing means of y along x: both ends of each pooled run with its mean, to be interpolated."""
    ends: list[list[float]] = []  # first x, last x, sum, rows
    for i in np.argsort(x, kind="stable"):
        ends.append([float(x[i]), float(x[i]), float(y[i]), 1.0])
        while len(ends) > 1 and ends[-2][2] * ends[-1][3] >= ends[-1][2] * ends[-2][3]:
            _, last, total, rows = ends.pop()
            ends[-1][1:] = [last, ends[-1][2] + total, ends[-1][3] + rows]
    return [e for run in ends for e in run[:2]], [run[2] / run[3] for run in ends for _ in (0, 1)]


def calibration(found: DataFrame, truth: DataFrame, own_curve: int = OWN_CURVE) -> dict[object, tuple[list[float], list[float]]]:
    """Curves from score to share of hits, over all and by bucket of tokens where that has enough points.

    found: by_owner() of a bounded sample of owners whose groups are known (SAMPLE at most, KEPT rows each); truth: owner, gid."""
    hits = found.join(truth.select("owner", "gid", F.lit(1.0).alias("hit")).distinct(), ["owner", "gid"], "left")
    points = hits.select("score", F.coalesce("hit", F.lit(0.0)).alias("hit"), token_bucket(F.col("n_tokens")).alias("bucket"), "owner", "gid").toPandas().sort_values(["score", "owner", "gid"])
    curves: dict[object, tuple[list[float], list[float]]] = {"all": isotonic_curve(points["score"].to_numpy(float), points["hit"].to_numpy(float))}
    for bucket, own in points.groupby("bucket"):
        if len(own) >= own_curve:
            curves[int(bucket)] = isotonic_curve(own["score"].to_numpy(float), own["hit"].to_numpy(float))
    return curves


def confident(found: DataFrame, curves: dict[object, tuple[list[float], list[float]]]) -> DataFrame:
    """found with confidence: the curve of its bucket, within BOUNDS; of reminders at most REMINDER."""

    @F.pandas_udf("double")
    def read(score: pd.Series, bucket: pd.Series) -> pd.Series:
        out = np.full(len(score), BOUNDS[0])
        for b in bucket.unique():
            x, y = curves.get(int(b), curves["all"])
            at = (bucket == b).to_numpy()
            if x:
                out[at] = np.interp(score.to_numpy(float)[at], x, y)
        return pd.Series(np.clip(out, *BOUNDS))

    value = read("score", token_bucket(F.col("n_tokens")))
    return found.withColumn("confidence", value).withColumn("confidence", F.when(F.col("kind") == "reminder", F.least("confidence", F.lit(REMINDER))).otherwise(F.col("confidence")))
