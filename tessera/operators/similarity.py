"""Exact similarity of token sets: frequencies, Jaccard, IDF cosine, neighbours, explanations, TF-IDF.

Pairs come from an inverted index: sets that share a token meet on it.  Sets are deduplicated effects, so
their number grows with the vocabulary of effects and not with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def idf(sets: DataFrame, item: str, tokens: str, smooth: bool = False) -> DataFrame:
    """(token, df, idf): ln(N/df), or smooth ln((1+N)/(1+df))+1."""
    n = F.lit(sets.count())
    df = sets.select(item, F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    value = F.log((1 + n) / (1 + F.col("df"))) + 1 if smooth else F.log(n / F.col("df"))
    return df.withColumn("idf", value)


def postings(sets: DataFrame, item: str, tokens: str) -> DataFrame:
    return sets.select(F.col(item).alias("item"), F.explode(F.array_distinct(tokens)).alias("token"))


def jaccard_pairs(sets: DataFrame, item: str, tokens: str) -> DataFrame:
    """(a, b, jaccard) of all pairs a <> b that share a token."""
    sized = sets.select(F.col(item).alias("item"), F.size(F.array_distinct(tokens)).alias("n"))
    p = postings(sets, item, tokens)
    both = p.select(F.col("item").alias("a"), "token").join(p.select(F.col("item").alias("b"), "token"), "token").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    both = both.join(sized.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def weighted(sets: DataFrame, item: str, tokens: str, smooth: bool = False) -> DataFrame:
    """(item, token, w) with binary presence times idf, each item's of length 1."""
    w = postings(sets, item, tokens).join(idf(sets, item, tokens, smooth), "token")
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("item")))
    return w.withColumn("norm", norm).where("norm > 0").select("item", "token", (F.col("idf") / F.col("norm")).alias("w"))


def cosine_pairs(vectors: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) from (item, token, w) tables by the tokens they share."""
    other = vectors if other is None else other
    a = vectors.select(F.col("item").alias("a"), "token", F.col("w").alias("wa"))
    b = other.select(F.col("item").alias("b"), "token", F.col("w").alias("wb"))
    return a.join(b, "token").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def neighbours(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """k best of each a; scores equal to 9 digits tie and go by b."""
    order = [F.round(score, 9).desc(), F.col("b")]
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("place") <= k)


def explain(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tokens two items share and each one's part of the cosine."""
    a = vectors.select(F.col("item").alias("a"), "token", F.col("w").alias("wa"))
    b = vectors.select(F.col("item").alias("b"), "token", F.col("w").alias("wb"))
    shared = pairs.select("a", "b").join(a, "a").join(b, ["b", "token"]).withColumn("part", F.col("wa") * F.col("wb"))
    return shared.withColumn("share", F.col("part") / F.sum("part").over(Window.partitionBy("a", "b"))).select("a", "b", "token", "share")


def name_mask(tokens: Column, owners: Column, name_tokens: Column) -> Column:
    """A text's tokens without its owner's name, if it has one owner only."""
    return F.when(F.size(owners) == 1, F.filter(tokens, lambda t: ~F.array_contains(name_tokens, t))).otherwise(tokens)


def tfidf(docs: DataFrame, item: str, tokens: str, min_df: int = 1) -> DataFrame:
    """(item, token, w): (1 + ln tf) times smooth idf, of length 1."""
    n = F.lit(docs.count())
    tf = docs.select(F.col(item).alias("item"), F.explode(tokens).alias("token")).groupBy("item", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    w = tf.join(df, "token").withColumn("v", (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    return w.withColumn("w", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("item")))).select("item", "token", "w")


#: Tokens whose frequencies go to the executors, documents from which these tokens are chosen, items of a task.
HEAD, SAMPLE, ITEMS = 200_000, 20_000, 4_000
#: If at most one item in so many has a token asked, only tokens of these items are counted.
FEW = 8


def by_item(docs: DataFrame, item: str, n: int) -> DataFrame:
    """docs dealt by item, about ITEMS in a task: what is counted per item and token from here on needs no further shuffle."""
    return docs.repartition(n // ITEMS + 16, F.col(item))


def head_counts(docs: DataFrame, item: str, tokens: str | Column, n: int, asked: DataFrame, head: int = HEAD) -> DataFrame:
    """(token, df, q) with the exact frequencies of the tokens asked (token, q) and of about head frequent ones.

    A sample of about SAMPLE items chooses the frequent ones, which decides only how tokens travel; all items are counted."""
    twice = docs.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = docs if twice.isEmpty() else by_item(docs, item, n)
    each = (lambda x: x.select(F.explode(F.array_distinct(tokens)).alias("token"))) if rows is docs else (lambda x: x.select(F.col(item).alias("item"), F.explode(tokens).alias("token")).distinct().select("token"))
    some = rows.where(F.pmod(F.xxhash64(item), F.lit(max(1, n // SAMPLE))) == 0)
    frequent = each(some).groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").orderBy(F.desc("k"), "token").limit(head).select("token")
    chosen = stored(frequent.unionByName(asked.select("token")).distinct())
    df = each(rows).join(F.broadcast(chosen), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return stored(df.join(F.broadcast(asked), "token", "left"))


def search_sums(docs: DataFrame, item: str, tokens: str | Column, n: int, head: DataFrame) -> DataFrame:
    """(item, squares, dot): sums of the squares of an item's TF-IDF weights and of their products with q, for items with a token that has a q.

    docs are dealt by item once.  Frequent tokens meet head (token, df, q) where they stand; all others, most of them in one item
    only, travel as 96 bits of hash to be counted, and their squares are summed per item before they are sent back."""
    tf = by_item(docs, item, n).select(F.col(item).alias("item"), F.explode(tokens).alias("token")).groupBy("item", "token").agg(F.count(F.lit(1)).alias("tf"))
    weight = (1 + F.log("tf")) * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)
    rare = F.col("df").isNull()
    key = F.when(rare, F.xxhash64("token")).otherwise(F.xxhash64("item")).alias("key")
    met = tf.join(F.broadcast(head), "token", "left").withColumn("v", weight)
    part = met.select("item", key, F.when(rare, F.hash("token")).alias("check"), F.when(rare, F.col("tf")).alias("tf"), (F.col("v") * F.col("v")).alias("vv"), (F.col("v") * F.col("q")).alias("vq"))
    part = part.groupBy("item", "key", "check").agg(F.sum("tf").alias("tf"), F.sum("vv").alias("vv"), F.sum("vq").alias("vq"))
    counted = part.withColumn("df", F.when(F.col("check").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("key", "check"))))
    square = F.coalesce("vv", weight * weight)
    return counted.groupBy("item").agg(F.sum(square).alias("squares"), F.sum("vq").alias("dot")).where("dot is not null")


#: Bits of the map of asked hashes, 16 MB at most; tokens that it lets pass by chance travel, but count for nothing.
MAP_BITS = 1 << 27


def _map(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits at the places of hashes, one map a task, joined two by two until one is left for the driver."""
    slots = np.uint64(bits - 1)

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for part in parts:
            at = part.column(0).to_numpy().view(np.uint64) & slots
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["own"])

    def both(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for part in parts:
            for x in part.column(0):
                own |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["own"])

    return np.frombuffer(hashes.coalesce(8).mapInArrow(mark, "own binary").coalesce(1).mapInArrow(both, "own binary").first()[0], np.uint8)


def counts_of(docs: DataFrame, tokens: str | Column, hashes: DataFrame, size: int) -> DataFrame:
    """(hash, df): of how many rows of docs the tokens with these hashes are; only what the map of hashes lets pass travels, counted per batch."""
    bits = min(MAP_BITS, max(1 << 16, 1 << (16 * size).bit_length()))
    slots, held = np.uint64(bits - 1), docs.sparkSession.sparkContext.broadcast(_map(hashes, bits))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for part in parts:
            lists = part.column(0)
            value = lists.flatten().to_numpy(zero_copy_only=False)
            at = value.view(np.uint64) & slots
            live = np.flatnonzero((asked[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))[live]
            value = value[live]
            order = np.lexsort((row, value))
            row, value = row[order], value[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            found, n = np.unique(value[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["hash", "n"])

    own = tokens if isinstance(tokens, Column) else F.col(tokens)
    sent = docs.select(F.transform(own, lambda t: F.xxhash64(t)).alias("t")).mapInArrow(run, "hash long, n long")
    return sent.groupBy("hash").agg(F.sum("n").alias("df"))


def few_sums(docs: DataFrame, item: str, tokens: str | Column, n: int, asked: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """search_sums() and the query's (token, df, q), where at most one item in FEW, but not none, has a token asked; else, or if an item has several rows, None.

    Only tokens of items found are counted, over all items; tokens are known by 64 bits of hash."""
    own = tokens if isinstance(tokens, Column) else F.col(tokens)
    words = F.array(*[F.lit(r[0]) for r in asked.select("token").collect()])
    if not docs.groupBy(item).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    tf = docs.select(F.col(item).alias("item"), own.alias("t")).where(F.arrays_overlap("t", words))
    tf = stored(tf.select("item", F.explode("t").alias("token")).groupBy("item", "token").agg(F.count(F.lit(1)).alias("tf")).withColumn("hash", F.xxhash64("token")))
    found = tf.select("item").distinct().count()
    if not found or found * FEW > n:
        return None
    hashes = stored(tf.select("hash").distinct())
    df = stored(counts_of(docs, own, hashes, hashes.count()).join(hashes, "hash"))
    known = stored(asked.withColumn("hash", F.xxhash64("token")).join(df, "hash").select("token", "df", "q", "hash"))
    idf = F.log((1.0 + n) / (1 + F.col("df"))) + 1
    asked_q = F.broadcast(known.select("hash", (F.col("q") * idf).alias("q")))
    v = tf.join(df, "hash").withColumn("v", (1 + F.log("tf")) * idf).join(asked_q, "hash", "left")
    sums = v.groupBy("item").agg(F.sum(F.col("v") * F.col("v")).alias("squares"), F.sum(F.col("v") * F.col("q")).alias("dot")).where("dot is not null")
    return sums, known.drop("hash")


def tfidf_search(docs: DataFrame, item: str, tokens: str | Column, query: dict[str, int], head: int = HEAD) -> DataFrame:
    """(item, score): cosine of TF-IDF weights with a query (token -> count) for items that share a token with it.

    tokens: a column of docs or an expression over it; tokens of the query that no item has count for nothing."""
    n = docs.count()
    asked = docs.sparkSession.createDataFrame(list(query.items()), "token string, n int").select("token", (1 + F.log("n")).alias("q"))
    idf = F.log((1.0 + n) / (1 + F.col("df"))) + 1
    few = few_sums(docs, item, tokens, n, asked)
    known = (few[1] if few else head_counts(docs, item, tokens, n, asked, head)).withColumn("q", F.col("q") * idf)
    found = few[0] if few else search_sums(docs, item, tokens, n, known)
    length = known.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("ql"))
    return found.join(F.broadcast(length)).select("item", (F.col("dot") / (F.sqrt("squares") * F.col("ql"))).alias("score"))


def weighted_search(docs: DataFrame, item: str, tokens: str | Column, query: DataFrame, head: int = HEAD) -> DataFrame:
    """(item, s): sum over the query's tokens (token, q) of their TF-IDF weights in an item of length 1."""
    n = docs.count()
    found = search_sums(docs, item, tokens, n, head_counts(docs, item, tokens, n, query, head))
    return found.select("item", (F.col("dot") / F.sqrt("squares")).alias("s"))


def bag_search(docs: DataFrame, item: str, tokens: str | Column, query: list[str], dim: int = 512, seed: int = 0) -> DataFrame:
    """(item, s): cosine of the cells to which an item's words are hashed with those of a query, for items that share a cell."""
    cell = F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(dim)).alias("cell")
    asked = docs.sparkSession.createDataFrame([(w,) for w in query], "word string").groupBy(cell).agg(F.count(F.lit(1)).cast("double").alias("q"))
    words = by_item(docs, item, docs.count()).select(F.col(item).alias("item"), F.explode(tokens).alias("word"))
    counts = words.groupBy("item", cell).agg(F.count(F.lit(1)).cast("double").alias("c"))
    found = counts.join(F.broadcast(asked), "cell", "left").groupBy("item").agg(F.sum(F.col("c") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("l")).where("dot is not null")
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("ql"))
    return found.join(F.broadcast(length)).select("item", (F.col("dot") / (F.col("l") * F.col("ql"))).alias("s"))  # one row


def hashed_bag(docs: DataFrame, item: str, tokens: str, dim: int = 512, seed: int = 0) -> DataFrame:
    """(item, token, w) over dim cells to which words are hashed, of length 1."""
    cell = F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(dim))
    counts = docs.select(F.col(item).alias("item"), F.explode(tokens).alias("word")).groupBy("item", cell.alias("token")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return counts.withColumn("w", F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("item")))).select("item", "token", "w")


def centroids(vectors: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group's members (group, item), of length 1."""
    size = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    mean = vectors.join(members, "item").groupBy(group, "token").agg(F.sum("w").alias("s")).join(size, group).withColumn("m", F.col("s") / F.col("n"))
    return mean.withColumn("w", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))).select(group, "token", "w")


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""
    add = lambda x, y: x + y
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
