"""Embedding whitening by TSQR (Demmel, Grigori, Hoemmen, Langou, SIAM J. Sci. Comput. 2012).

Entries become integers, so sums are exact.  Rows are centred by these (n*x - S is an integer, divided by n once), each
task reduces its centred rows to an R factor batch by batch, R factors merge in a tree of FAN a task until one is left, and its SVD
gives the components: right singular vectors, with eigenvalues sigma**2 / n.  No covariance is formed to find them.

The driver and each task hold d sums and d x d factors, where d is the length of a vector, and never rows beyond a
slice of SLICE entries; the number of R factors is that of tasks.  The input is read four times (lengths and sums, factors, the check of the whitened
rows, the result) and must give the same rows each time, as a table does.  Lost executors cost their own tasks.

Defined cases: vectors that are null, empty, or hold null or non-finite entries go; if vectors differ in length, those of the most frequent length (the
shortest of several) are the fit list and others go; entries that would pass 2**53 count as 2**53 (their double has no digits left);
rows of one id, or without one, count each; a component without variance (beyond the rank of the rows) has null in `whitened`, and where no row
varies, in `explained` too; without any valid vector there are no rows.  Rank is judged at double precision of the largest singular value.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .scratch import Scratch

SCALE, SHIFT, COMPONENTS, FAN, SLICE, FARTHEST = 1024, 100_000, 8, 16, 1 << 22, 1 << 53
HELD_SUMS = 1 << 16


def integers(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the valid vectors of a column, by length, or of length dim alone; at most SLICE entries at once."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in [dim] if dim else np.unique(length[length > 0]):
        at = np.flatnonzero(length == d)
        step = max(1, SLICE // int(d))
        for a in range(0, len(at), step):
            own = at[a : a + step]
            flat = column.take(pa.array(own)).flatten()
            c = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
            ok = np.isfinite(c).all(axis=1)
            x = np.clip(np.floor(c[ok] * SCALE), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT
            if ok.any():
                yield own[ok], x


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python integers: high and low halves are summed apart, so that no sum of 2**22 rows overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(v) for h, v in zip(high.sum(axis=0), low.sum(axis=0))]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(x - S/n in doubles, each from an exact integer; sum of squares of n*x - S per row, exact)."""
    far = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums))
    if far * far * x.shape[1] < 1 << 63:
        d = x * n - np.array(sums, np.int64)
        return d / n, (d * d).sum(axis=1).tolist()
    near = n * int(x.min()) - max(sums), n * int(x.max()) - min(sums)
    if max(map(abs, near)) < 1 << 62 and far < 1 << 63:
        d = x * n - np.array(sums, np.int64)
        a, b = d >> 31, d & 0x7FFFFFFF  # d*d = a*a*2**62 + a*b*2**32 + b*b, and each product is below 2**62
        total = [0] * len(d)
        for term, bits in ((a * a, 62), (a * b, 32), (b * b, 0)):
            high, low = term >> 31, term & 0x7FFFFFFF
            total = [t + (((int(h) << 31) + int(v)) << bits) for t, h, v in zip(total, high.sum(axis=1), low.sum(axis=1))]
        return d / n, total
    wide = x.astype(object) * n - np.array(sums, object)
    return np.array(wide / n, np.float64), [int(v) for v in (wide * wide).sum(axis=1)]


def triangle(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """R of the rows of all blocks, one block at a time."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def _lengths_and_sums(rows: DataFrame) -> DataFrame:
    """length, dim, n and total (sum of x) of the valid vectors."""
    schema = pa.schema([("length", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def told(held: dict[int, list]) -> pa.RecordBatch:
        flat = [(d, i, n, Decimal(s)) for d, (n, sums) in held.items() for i, s in enumerate(sums)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*flat), schema.types)], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in integers(batch.column("v")):
                n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = [n + len(x), [a + b for a, b in zip(sums, exact_sums(x))]]
                if len(held) > 1 and sum(map(len, (v for _, v in held.values()))) > HELD_SUMS:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    out = rows.select("v").mapInArrow(add, "length int, dim int, n bigint, total decimal(38,0)")
    return out.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


def _factor(rows: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: one per task, then FAN at a time."""
    def one(r: np.ndarray | None, group: int) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.record_batch({"group": pa.array([group], pa.int64()), "height": pa.array([len(r)], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from one(triangle(centred(x, n, sums)[0] for batch in batches for _, x in integers(batch.column("v"), dim)), TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None

        def blocks() -> Iterator[np.ndarray]:
            nonlocal group
            for batch in batches:
                for g, height, raw in zip(*[batch.column(c).to_pylist() for c in ("group", "height", "r")]):
                    group = g
                    yield np.frombuffer(raw).reshape(height, dim)

        r = triangle(blocks())
        yield from one(r, group)

    kind = "group bigint, height int, r binary"
    scratch = Scratch(rows.sparkSession)
    level, left = scratch.write(rows.select("v").mapInArrow(leaf, kind), "level0"), 0
    tasks = (level.agg(F.max("group")).first()[0] or 0) + 1
    while tasks > 1:
        left, tasks = left + 1, -(-tasks // FAN)
        above = level.withColumn("group", F.floor(F.col("group") / FAN)).repartition(tasks, "group")
        level = scratch.write(above.sortWithinPartitions("group").mapInArrow(_by_group(merge), kind), f"level{left}")
        scratch.drop(f"level{left - 1}")
    found = level.collect()  # one d x d factor
    return np.frombuffer(found[0]["r"]).reshape(found[0]["height"], dim) if found else np.zeros((0, dim))


def _by_group(merge):
    """A task's factors in runs of one group, each run merged on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
        ahead = next(singles, None)
        while ahead is not None:
            group = ahead.column("group")[0].as_py()

            def own() -> Iterator[pa.RecordBatch]:
                nonlocal ahead
                while ahead is not None and ahead.column("group")[0].as_py() == group:
                    yield ahead
                    ahead = next(singles, None)

            yield from merge(own())

    return run


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as columns, eigenvalues with 0 beyond the rank, share of the trace) of the first components."""
    dim = r.shape[1]
    _, s, vt = np.linalg.svd(r, full_matrices=True)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    e = s * s / n
    e[s <= max(n, dim) * np.finfo(float).eps * s[0]] = 0.0
    share = e / e.sum() if e.sum() > 0 else np.full(dim, np.nan)
    return vt[:most].T, e[:most], share[:most]


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per valid vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark: SparkSession = rows.sparkSession
    held = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))
    scratch = Scratch(spark)
    found = scratch.write(_lengths_and_sums(held), "sums")
    best = found.where("dim = 0").orderBy(F.desc("n"), "length").first()
    kind = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = StructType([held.schema["vec_id"], *StructType.fromDDL(kind).fields])
    if best is None:
        return held.select("vec_id").where(F.lit(False)).select("vec_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]])
    dim, n = best["length"], best["n"]
    sums = [int(r["total"]) for r in found.where(F.col("length") == dim).orderBy("dim").collect()]  # one row a dimension
    vectors, e, share = components(_factor(held, dim, n, sums), n, most)
    scale = np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), np.nan)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(e) + 1, len(e))), False
        for batch in batches:
            for _, x in integers(batch.column("v"), dim):
                w = (centred(x, n, sums)[0] @ vectors) * scale
                total += np.vstack([w.T @ w, w.sum(axis=0)])
                seen = True
        if seen:
            yield pa.record_batch({"i": pa.array(np.arange(total.size), pa.int32()), "s": pa.array(total.ravel())})

    moments = held.select("v").mapInArrow(gram, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()  # (most + 1) * most rows
    table = np.array([m["s"] for m in moments]).reshape(-1, len(e)) / n
    off = np.abs(table[:-1] - np.outer(table[-1], table[-1]) - np.eye(len(e)))[np.ix_(e > 0, e > 0)]
    error = float(off.max()) if off.size else None

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            for at, x in integers(batch.column("v"), dim):
                d, squares = centred(x, n, sums)
                w = ((d @ vectors) * scale).ravel()
                each = pa.array(np.repeat(np.arange(len(at)), k))
                total = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(total, n)),
                        pa.array([Decimal(s) for s in squares], pa.decimal128(38, 0)).take(each), pa.array(w, mask=np.isnan(w)),
                        pa.array(np.tile(share, len(at)), mask=np.tile(np.isnan(share), len(at))), pa.array([error] * total, pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return held.mapInArrow(result, StructType([StructField("vec_id", held.schema["vec_id"].dataType), *schema.fields[1:]]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long; one that passes a long is an error, not a wrong number."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
