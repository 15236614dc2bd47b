"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in order of their names share SHARE times all words by repeating weights; a target stops at
CAP times its source's words and the excess is shared anew among the rest.  The water level that gives is
found by repeated sums over the table of sources.

Blocks: a seeded hash puts each source's documents in an order; the order is cut into a power of two of
blocks of about BLOCK_WORDS words.  A source is taken whole as often as its target allows, then up to a cut
in that order, found by three rounds of sums over 12 bits of the hash, so no source's documents are ever
sorted in one task.  The cut may fall inside a block, so sources meet their targets to within a document.

Shards: the exact numbers of block draws are split among output shards by a binary tree whose nodes are
multivariate hypergeometric draws; sources are first split by GROUPS of them, then inside each group,
which has the same distribution and keeps both steps small.  A source's draws, in an order that permutes the blocks
of each pass, the last partial one included, go to shards in runs of these numbers, so the blocks of one pass are
disjoint; inside a shard documents follow a hash (shuffle locally).  Shards and the cells a shard is written in are
parameters, as many as the output needs.

Defined cases: a null text has no words and is drawn like the others of its source; null is a source of its
own, in the last place; without any word all targets are 0; rows of one id in one source are drawn alike; an
input column named like a result is replaced, others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, inner, keep_names
from .words import SPACED, batches, text_buffer, tokenize

WEIGHTS, SHARE, CAP, SHARDS, BLOCK_WORDS, SEED, GROUPS, CELLS = (5.0, 2.0, 1.0), 1.5, 2.0, 8, 1 << 16, 11, 512, 64
_BITS, _STEP = 36, 12


def with_sizes(docs: DataFrame, text: str, size: str) -> DataFrame:
    """docs and the number of words of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column, counts = part.column(part.schema.get_field_index(text)), []
            for a, b in batches(column):
                counts.append(np.diff(tokenize(*text_buffer(column.slice(a, b - a)), SPACED, hashes=False).first))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(counts) if counts else [], pa.int64())], [*part.schema.names, size])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(size, T.LongType())]))


def split(counts: np.ndarray, capacities: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Deal counts of each kind to bins of given capacities: at each node of the tree the left half's share is hypergeometric."""
    if len(capacities) == 1:
        return counts[:, None]
    half = len(capacities) // 2
    left = np.zeros_like(counts)
    if counts.sum():
        left = rng.multivariate_hypergeometric(counts, int(capacities[:half].sum()), method="marginals")
    return np.hstack([split(left, capacities[:half], rng), split(counts - left, capacities[half:], rng)])


def _level(sources: DataFrame, total: float) -> float:
    """The water level: targets are the lesser of level times weight and cap times size."""
    level = None
    while True:
        full = F.lit(False) if level is None else F.lit(CAP) * F.col("source_size") <= F.lit(level) * F.col("weight")
        x = sources.agg(F.sum(F.when(full, CAP * F.col("source_size")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        now = (total - (x["held"] or 0.0)) / x["weight"] if x["weight"] else level or 0.0
        if now == level or not x["weight"]:
            return now
        level = now


def _ranked(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with size and weight; their places come from a range partitioning, not from one task."""
    grouped = sizes.groupBy("__key").agg(F.first("__source").alias("__source"), F.sum("__size").alias("source_size"))
    order = [F.col("__source").isNull(), F.col("__source")]
    placed = scratch.write(grouped.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    held = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, at = {}, 0
    for part in sorted(held):
        offsets[part] = at
        at += held[part]
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("part")] if offsets else F.lit(0)
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + offset
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (number % len(WEIGHTS) + 1).cast("int"))
    return scratch.write(placed.select("__key", "source_size", weight.alias("weight")), "ranked")


def _cuts(sizes: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """plan (__key, rest words) with cut: documents whose order number is below it hold about rest words."""
    state = plan.select("__key", F.col("rest").cast("double").alias("left"), F.lit(0).cast("long").alias("low"))
    for done in range(_STEP, _BITS + 1, _STEP):
        shift = _BITS - done
        inside = sizes.join(state, "__key").where(F.shiftright("__order", shift + _STEP) == F.col("low"))
        cells = inside.groupBy("__key", "low", "left", F.shiftright("__order", shift).alias("cell")).agg(F.sum("__size").alias("words"))
        run = Window.partitionBy("__key").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("upto", F.sum("words").over(run)).where(F.col("upto") >= F.col("left"))
        first = cells.groupBy("__key").agg(F.min_by(F.struct("cell", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "words"), "cell").alias("c"))
        state = scratch.write(first.select("__key", F.col("c.cell").alias("low"), F.col("c.left").alias("left"), F.col("c.words").alias("words")), f"cut{done}")
        last = state
        state = state.drop("words")
    cut = F.col("low") + F.when(2 * F.col("left") >= F.col("words"), 1).otherwise(0)
    return last.select("__key", cut.alias("cut"))


def plan_sources(sizes: DataFrame, scratch: Scratch, shards: int, seed: int) -> DataFrame:
    """Per source: size, target, whole passes, cut, bits of its block number, and the ends of its runs of draws by shard."""
    sources = _ranked(sizes, scratch)
    words = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = _level(sources, SHARE * words) if words else 0.0
    target = F.least(F.lit(CAP) * F.col("source_size"), F.lit(level) * F.col("weight"))
    plan = sources.select("__key", "source_size", target.alias("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("passes", passes.cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    cuts = _cuts(sizes, plan.where("rest > 0"), scratch)
    blocks = F.greatest(F.lit(0), F.least(F.lit(20), F.ceil(F.log2(F.greatest(F.col("source_size"), F.lit(1)) / BLOCK_WORDS)))).cast("int")
    plan = plan.join(cuts, "__key", "left").withColumns({"cut": F.coalesce("cut", F.lit(0).cast("long")), "bits": blocks})
    per = F.expr(f"shiftleft(1L, {_BITS} - bits)")
    draws = F.col("passes") * F.expr("shiftleft(1L, bits)") + F.ceil(F.col("cut") / per)
    plan = plan.withColumns({"draws": draws.cast("long"), "group": F.pmod(F.xxhash64("__key"), F.lit(GROUPS)).cast("int")})
    plan = scratch.write(plan.drop("rest"), "plan")
    groups = plan.groupBy("group").agg(F.sum("draws").alias("draws")).orderBy("group").collect()  # GROUPS rows at most
    totals = np.array([r["draws"] for r in groups], np.int64)
    total = int(totals.sum())
    capacities = np.array([total // shards + (k < total % shards) for k in range(shards)], np.int64)
    dealt = {r["group"]: row for r, row in zip(groups, split(totals, capacities, np.random.default_rng(seed)) if len(totals) else [])}

    def inside(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("__key").reset_index(drop=True)
        group = int(own["group"].iloc[0])
        table = split(own["draws"].to_numpy(np.int64), dealt[group], np.random.default_rng([seed, group]))
        return pd.DataFrame({"__key": own["__key"], "ends": list(np.cumsum(table, axis=1))})

    ends = plan.select("__key", "draws", "group").groupBy("group").applyInPandas(inside, "__key string, ends array<bigint>")
    return scratch.write(plan.drop("draws", "group").join(ends, "__key"), "ends")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and draws: an array of (pass, shard, place), one for each time the mix takes the row."""
    kept = keep_names(docs, ["size", "source_size", "target", "draws"])
    scratch = Scratch(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`")), 64 - _BITS)
    held = docs.select(F.col(f"`{text}`").alias("__text"), F.col(f"`{source}`").cast("string").alias("__source"), key.alias("__key"), order.alias("__order"))
    sizes = scratch.write(with_sizes(held, "__text", "__size").drop("__text"), "sizes")
    plan = plan_sources(sizes, scratch, shards, seed)
    k, o = inner("key", kept), inner("order", kept)
    mine = {c: inner(c, kept) for c in ("passes", "cut", "bits", "ends")}
    rows = with_sizes(docs.select(*[F.col(f"`{c}`") for c in kept], key.alias(k), order.alias(o), F.col(f"`{text}`").alias(inner("text", kept))), inner("text", kept), "size").drop(inner("text", kept))
    joined = rows.join(plan.withColumnsRenamed({**mine, "__key": k}), k)
    passes, cut, ends = F.col(mine["passes"]), F.col(mine["cut"]), F.col(mine["ends"])
    count = passes + F.when(F.col(o) < cut, 1).otherwise(0)
    whole, block = F.expr(f"shiftleft(1L, `{mine['bits']}`)"), F.expr(f"shiftright(`{o}`, {_BITS} - `{mine['bits']}`)")
    partial = F.greatest(F.lit(1), F.ceil(cut / F.expr(f"shiftleft(1L, {_BITS} - `{mine['bits']}`)")))  # blocks of the partial pass
    place = lambda t: (block * 0x9E3779B1 + t * 0x85EBCA77) % F.when(t < passes, whole).otherwise(partial)  # noqa: E731  0x9E3779B1 is prime
    draw = lambda t: t * whole + place(t)
    one = lambda t: F.struct(
        t.cast("int").alias("pass"),
        F.size(F.filter(ends, lambda e: e <= draw(t))).cast("int").alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col(f"`{doc_id}`"), t).alias("place"),
    )
    draws = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.expr("cast(array() as array<struct<pass:int,shard:int,place:bigint>>)"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", draws.alias("draws"))


def shards(mixed: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per draw, with pass, shard and place; each task holds some of a shard's cells, in the order of place."""
    mark = inner("d", mixed.columns)
    rows = mixed.withColumn(mark, F.explode("draws")).drop("draws")
    names = ["pass", "shard", "place"]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep_names(rows, [*names, mark])], *[F.col(f"{mark}.{n}").alias(n) for n in names])
    return rows.repartition("shard", F.pmod("place", F.lit(cells))).sortWithinPartitions("shard", "place")


def stage(docs: DataFrame, outputs: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """The mix itself: each draw of a document as a row, with its shard and its place there."""
    return shards(mix(docs, shards=outputs), cells)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))
