"""Embedding near-dup by a pivot-permutation index (Chavez, Figueroa, Navarro, TPAMI 2008).

Each vector is described by its NEAREST nearest pivots.  Pivots are vectors of a sample by least hash, taken in turn
if no earlier pivot is within cosine APART, so that a dense group has one pivot and not many whose order among near
vectors would be noise.  Their number grows with the root of the number of vectors, so that lists grow with the root
too: PIVOTS at least, MOST_PIVOTS at most, and no more than SAMPLE_BYTES of vectors are drawn to choose them from.
Two vectors are candidates if they share SHARED of them.  Lists of vectors by (label, pivot)
are inverted on each vector's NEAREST - SHARED + 1 rarest pivots only (by the sample): two vectors that share SHARED pivots
meet in one of these lists.  In a list shared pivots are counted and candidates verified in double
precision (where there are fewer pivots than SHARED, all must be shared); a pair counts only in the first list in which it meets.

Copies of a vector under one label are one class of known size before indexing.  Lists longer than CHUNK are
cut into chunks that meet in pairs of chunks, so a task's memory has a bound.  A list yields, per vector, its
number of links and one edge to the root of its component in the list, never the pairs.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components, and all without a
label, link with nothing; vectors of different lengths don't link; rows of one vec_id count as
vectors each; ids may be of any type that has an order; a vector without an id links and counts like others, but a
component is named by its least vec_id, and has none only if no vector in it has one (all of these are kept).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, hash_sample

PIVOTS, MOST_PIVOTS, SAMPLE_BYTES, APART, NEAREST, SHARED, CHUNK, COSINE, BUCKET_ROWS = 512, 8192, 64 << 20, 0.9, 8, 4, 1024, 0.98, 2048


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivot_count(n: int, dim: int) -> int:
    """Pivots for n vectors: about twice the root, within bounds; four to eight times as many are drawn to choose from."""
    return max(1, min(max(PIVOTS, 2 * int(n**0.5)), MOST_PIVOTS, max(PIVOTS, SAMPLE_BYTES // (64 * dim))))


def _apart(sample: np.ndarray, most: int) -> np.ndarray:
    chosen = np.empty((min(most, len(sample)), sample.shape[1]))
    n = 0
    for x in sample:
        if n < len(chosen) and (not n or (chosen[:n] @ x).max() < APART):
            chosen[n] = x
            n += 1
    return chosen[:n]


def _rarity(sample: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of each pivot in the order of how many vectors of the sample have it among their nearest."""
    near = min(NEAREST, len(pivots))
    seen = np.zeros(len(pivots), np.int64)
    for a in range(0, len(sample), 1024):
        seen += np.bincount(_nearest(sample[a : a + 1024], pivots, near).ravel(), minlength=len(pivots))
    order = np.empty(len(pivots), np.int64)
    order[np.argsort(seen, kind="stable")] = np.arange(len(pivots))
    return order


def _nearest(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :near].astype(np.int32)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component, by repeated minima along links."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def _verify(rep: np.ndarray, copies: np.ndarray, chunk: np.ndarray, vectors: np.ndarray, perms: np.ndarray, held: np.ndarray, pivot: int, order: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of one pair of chunks, by number of vectors, and the least row of its component here."""
    n = len(rep)
    if n < 2:
        return np.zeros(n, np.int64), np.arange(n)
    names, cells = np.unique(perms, return_inverse=True)
    near = np.zeros((n, len(names)), np.float32)
    near[np.repeat(np.arange(n), perms.shape[1]), cells.ravel()] = 1
    earlier = np.zeros((n, len(names)), np.float32)
    before = held & (order[perms] < order[pivot])
    earlier[np.repeat(np.arange(n), perms.shape[1])[before.ravel()], cells.ravel()[before.ravel()]] = 1
    ok = (near @ near.T >= min(SHARED, perms.shape[1])) & (earlier @ earlier.T == 0) & (vectors @ vectors.T >= cosine)
    np.fill_diagonal(ok, False)
    if chunk.min() != chunk.max():
        ok &= chunk[:, None] != chunk[None, :]
    a, b = np.nonzero(np.triu(ok))
    return ok @ copies, _roots(n, a, b)


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark: SparkSession = rows.sparkSession
    scratch = Scratch(spark)
    held = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("v"), F.col(f"`{label}`").alias("label"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("label").isNotNull() & F.coalesce(F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = held.where(sound)
    classes = valid.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = classes.withColumns({"space": F.xxhash64("label", F.size("v")), "dim": F.size("v"), "node": F.monotonically_increasing_id()})
    classes = scratch.write(classes, "classes")  # numbers are fixed from here on
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for d, n in sizes.items():
        most = pivot_count(n, d)
        sample = _unit(np.array([r["v"] for r in hash_sample(classes.where(F.col("dim") == d).select("v"), 4 * most).collect()], np.float64))
        own = _apart(sample, most)
        pivots[d] = own, _rarity(sample, own)
    sent = spark.sparkContext.broadcast(pivots)

    def describe(parts):
        for part in parts:
            dim = part.column(3).to_numpy()
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                for a in range(0, len(rows), 1024):
                    own = part.take(pa.array(rows[a : a + 1024]))
                    x = _unit(_matrix(own.column(4), d))
                    centres, order = sent.value[d]
                    near = min(NEAREST, len(centres))
                    perm = _nearest(x, centres, near)
                    kept = near - min(SHARED, near) + 1
                    keep = np.take_along_axis(perm, np.argsort(order[perm], axis=1)[:, :kept], axis=1)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel())) for y in (perm, keep)]
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), own.column(3), pa.array([v.tobytes() for v in x], pa.binary()), *lists], ["space", "node", "copies", "dim", "unit", "perm", "keep"])

    source = classes.select("space", "node", "copies", "dim", "v")
    described = scratch.write(source.mapInArrow(describe, "space long, node long, copies long, dim int, unit binary, perm array<int>, keep array<int>"), "described")
    listed = described.withColumn("pivot", F.explode("keep"))
    lists = listed.groupBy("space", "pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    lists = scratch.write(lists.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "sizes")
    total = lists.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0
    buckets = max(1, int(total) // BUCKET_ROWS)
    dealt = listed.join(lists.select("space", "pivot", "chunks"), ["space", "pivot"])
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("space", "pivot", "low", "high"), F.lit(buckets)).cast("int"))
    dealt = dealt.select("bucket", "space", "pivot", "low", "high", "chunk", "node", "copies", "dim", "unit", "perm", "keep")

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("space", "ascending"), ("pivot", "ascending"), ("low", "ascending"), ("high", "ascending"), ("node", "ascending")])
        keys = np.stack([table[c].to_numpy() for c in ("space", "pivot", "low", "high")], axis=1)
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        nodes, links, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = table.slice(a, b - a)
            ids, chunk = own["node"].to_numpy(), own["chunk"].to_numpy()
            x = np.frombuffer(b"".join(own["unit"].to_pylist()), np.float64).reshape(b - a, -1)
            perms, keep = (np.asarray(own[c].combine_chunks().flatten(), np.int64).reshape(b - a, -1) for c in ("perm", "keep"))
            held = (perms[:, :, None] == keep[:, None, :]).any(axis=2)
            n, root = _verify(ids, own["copies"].to_numpy(), chunk, x, perms, held, int(keys[a, 1]), sent.value[own["dim"][0].as_py()][1], cosine)
            some = np.flatnonzero(n)
            nodes.append(ids[some])
            links.append(n[some])
            roots.append(ids[root[some]])
        return pa.table({"node": pa.array(np.concatenate(nodes)), "links": pa.array(np.concatenate(links)), "root": pa.array(np.concatenate(roots))})

    found = scratch.write(dealt.groupBy("bucket").applyInArrow(work, "node long, links long, root long"), "found")
    scratch.free()
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(links, "node", "left").join(linked.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(names, "root").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = valid.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = held.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB SQL of query(), whose index finds all links that there are on the test tables.
ORACLE = """
with recursive v as (select vec_id, label, embedding::double[] v from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
r(vec_id, near) as (select vec_id, vec_id from embeddings union select r.vec_id, e.y from r join e on e.x = r.near),
c as (select vec_id, min(near) component_id from r group by 1)
select c.vec_id, cast(count(e.y) as bigint) n_links, component_id, c.vec_id = component_id kept from c left join e on e.x = c.vec_id group by all
"""
