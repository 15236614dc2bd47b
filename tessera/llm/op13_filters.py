"""Filter interaction audit: what each filter removes at each place of each order, from a packed bitmap index.

A filter's verdict on a row doesn't depend on what ran before it, so the rows alive after any prefix of any order
depend on the prefix's SET alone: five filters have 120 orders of 600 steps, but only 32 sets.  Tasks pack each filter's and
each label's verdicts into NumPy bitsets, rows laid out by part with each part from a fresh byte on, so that a part's bitmap is a run
of whole bytes.  For each of the 32 sets they AND-NOT the bitsets of the set, and count the bits of each part: alive at all, alive with each label.
Partition counts are summed by Spark, and all columns of all orders are differences of these counts; a filter's Shapley sum
weighs each set that it can follow by the number of orders in which it does.

Verdicts on a text alone are built-in functions.  Copies (filter E) meet by SHA-256 of the text in an aggregate of its least id, so no group of copies is
ever in one place; hashes that many rows share (more than one in HEAVY, so HEAVY of them at most) are broadcast, all others joined.

Defined cases: a null text is an empty one; a null source is part '' with the empty sources; a row without an id is a copy of no smaller one
and makes no other row a copy; rows of one id are rows each, and copies of a smaller id only; several labels of an id
count as 1 if one is; an unlabelled row has neither label; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

HEAVY, HELD_PARTS = 1000, 4096
WORD = r"[^\x20\x09-\x0D]+"
#: The five filters of the audit; E needs the whole table.
LETTERS = "ABCDE"
SETS = 1 << len(LETTERS)


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone: short, repetitive, shouting, with symbols."""
    words = F.regexp_count(text, F.lit(WORD))
    distinct = F.size(F.array_distinct(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": words < 50, "B": 100 * distinct < 65 * words, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def repeated(rows: DataFrame, key: str, order: str, heavy: int = HEAVY) -> DataFrame:
    """rows with E: whether a row of the same key has a smaller order.  No key's rows come together: its least order comes to them."""
    scratch = Scratch(rows.sparkSession)
    heads = rows.groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = scratch.write(heads, "heads")
    total = heads.agg(F.sum("n").alias("n")).first()["n"] or 0
    large = F.col("n") > total / heavy
    few = F.broadcast(heads.where(large).select(key, F.col("first").alias("few")))  # fewer than heavy rows
    many = heads.where(~large).select(key, F.col("first").alias("many"))
    joined = rows.join(few, key, "left").join(many, key, "left")
    return joined.withColumn("E", F.coalesce(F.col(order) > F.coalesce("few", "many"), F.lit(False))).drop("few", "many")


def _padded(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit of each row when rows of a part (0, 1, ... in turn) lie together, each part from a fresh byte on; first byte of each part; bytes."""
    sizes = np.bincount(parts)
    width = (sizes + 7) // 8
    first = np.concatenate([[0], np.cumsum(width)])
    order = np.argsort(parts, kind="stable")
    rank = np.arange(len(parts)) - np.concatenate([[0], np.cumsum(sizes)])[parts[order]]
    bit = np.empty(len(parts), np.int64)
    bit[order] = first[parts[order]] * 8 + rank
    return bit, first[:-1], int(first[-1])


def bitmap_counts(parts: np.ndarray, fails: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows alive by (part, set of filters, 0 for all or 1 + a label's place); fails and labels: one boolean row per filter or label."""
    bit, first, size = _padded(parts)

    def packed(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(size * 8, np.uint8)
        bits[bit] = flags
        return np.packbits(bits)

    filters, everything = [packed(f) for f in fails], packed(np.ones(len(parts), bool))
    named = [None, *[packed(x) for x in labels]]
    out = np.zeros((len(first), 1 << len(filters), len(named)), np.int64)
    alive: list[np.ndarray] = [everything]
    for chosen in range(1 << len(filters)):
        if chosen:
            top = chosen.bit_length() - 1
            alive.append(alive[chosen ^ (1 << top)] & ~filters[top])
        for k, label in enumerate(named):
            ones = np.bitwise_count(alive[chosen] if label is None else alive[chosen] & label)
            out[:, chosen, k] = np.add.reduceat(ones, first, dtype=np.int64)
    return out


def counts(rows: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, chosen (bits of a set of filters), alive and, by label, how many rows with it are alive; rows: part and boolean columns."""
    names = ["alive", *labels]
    schema = pa.schema([("part", pa.string()), ("chosen", pa.int32()), *[(n, pa.int64()) for n in names]])

    def told(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        table = np.stack(list(held.values())).reshape(-1, len(names))
        sets = table.shape[0] // len(held)
        part = pa.array(list(held)).take(pa.array(np.repeat(np.arange(len(held)), sets)))
        return pa.record_batch([part, pa.array(np.tile(np.arange(sets, dtype=np.int32), len(held))), *[pa.array(c) for c in table.T]], schema=schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").dictionary_encode()
            flags = lambda own: np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in own], bool).reshape(len(own), -1)
            table = bitmap_counts(part.indices.to_numpy(), flags(filters), flags(labels))
            for name, own in zip(part.dictionary.to_pylist(), table):
                held[name] = held[name] + own if name in held else own
            if len(held) > HELD_PARTS:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    spark_schema = "part string, chosen int, " + ", ".join(f"`{n}` bigint" for n in names)
    found = rows.select("part", *filters, *labels).mapInArrow(index, spark_schema)
    return found.groupBy("part", "chosen").agg(*[F.sum(f"`{n}`").alias(n) for n in names])


def interactions(counted: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """All orders of all filters by part: kept, removed, redundant, unique_fails, <label>_lost and shapley, from the counts of sets."""
    n, whole = len(filters), (1 << len(filters)) - 1
    names = ["alive", *labels]
    lists = counted.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("chosen", *names))).alias("sets"))  # 2**n a part
    lists = lists.select("part", *[F.col(f"sets.{c}").alias(c) for c in names])
    orders = ["".join(p) for p in permutations(filters)]
    steps = [(o, k, filters.index(o[k]), sum(1 << filters.index(f) for f in o[:k])) for o in orders for k in range(n)]
    lit = lambda k: F.lit([s[k] for s in steps])
    at = lambda c, k: F.get(F.col(c), k)
    share = []
    for f in range(n):
        before = [s for s in range(whole + 1) if not s >> f & 1]
        share.append(sum((at("alive", F.lit(s)) - at("alive", F.lit(s | 1 << f))) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in before))
    rows = lists.withColumn("shares", F.array(*share)).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("k"))
    rows = rows.withColumns({"filter_order": F.get(lit(0), F.col("k")), "step": (F.get(lit(1), F.col("k")) + 1).cast("int"), "f": F.get(lit(2), F.col("k")), "before": F.get(lit(3), F.col("k"))})
    rows = rows.withColumn("bit", F.expr("shiftleft(1, f)")).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    return rows.select(
        "part", "filter_order", "step", at("alive", F.col("after")).alias("kept"), lost("alive").alias("removed"),
        (at("alive", F.lit(0)) - at("alive", F.col("bit")) - lost("alive")).alias("redundant"),
        (at("alive", F.lit(whole) - F.col("bit")) - at("alive", F.lit(whole))).alias("unique_fails"),
        *[lost(c).alias(f"{c}_lost") for c in labels], F.get("shares", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The five filters over docs; labels: id, good, toxic (booleans)."""
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marks = failures(F.col("text"))
    read = whole.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), *[c.alias(f) for f, c in marks.items()])
    rows = repeated(scratch.write(read, "read"), "hash", "id").select("id", "part", *LETTERS)  # texts are read once
    known = labels.where("id is not null").groupBy("id").agg(*[F.max(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("good", "toxic")])
    rows = rows.join(known, "id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    return interactions(counts(rows, list(LETTERS), ["good", "toxic"]), LETTERS, ["good", "toxic"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit(docs, labels)


#: DuckDB SQL of query(): every order walked over counts of rows by the filters that they fail.
ORACLE = r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by t) first from d),
l as (select doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic from labels where doc_id is not null group by 1),
f as (select part, (len(w) < 50)::int a, (100 * len(list_distinct(w)) < 65 * len(w))::int b, (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::int c,
 regexp_matches(t, '[#$%&*|]')::int d, coalesce(doc_id > first, false)::int e, coalesce(good, false) good, coalesce(toxic, false) toxic from w left join l using (doc_id)),
g as (select part, a, b, c, d, e, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select p.x || q.x || r.x || s.x || t.x filter_order from x p, x q, x r, x s, x t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k as (select filter_order, i::int step, filter_order[i] own, filter_order[1:i - 1] earlier from o, range(1, 6) r(i)),
v as (select g.*, array_to_string([case when a = 1 then 'A' else '' end, case when b = 1 then 'B' else '' end, case when c = 1 then 'C' else '' end, case when d = 1 then 'D' else '' end, case when e = 1 then 'E' else '' end], '') fails from g),
s as (select part, filter_order, step, own, sum(n) filter (not hit and not now) kept, sum(n) filter (not hit and now) removed, sum(n) filter (hit and now) redundant, sum(n) filter (fails = own) unique_fails,
 sum(good) filter (not hit and now) good_lost, sum(toxic) filter (not hit and now) toxic_lost
 from (select *, contains(fails, own) now, earlier <> '' and regexp_matches(fails, '[' || case when earlier = '' then 'Z' else earlier end || ']') hit from v, k) group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant, coalesce(unique_fails, 0)::bigint unique_fails,
 coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, own))::bigint shapley from s
"""
