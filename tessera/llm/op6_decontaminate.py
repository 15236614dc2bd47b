"""Benchmark decontamination by winnowing (Schleimer, Wilkerson, Aiken, SIGMOD 2003).

Items and documents are fingerprinted alike: of every WINDOW consecutive hashes of GRAM words the least
is kept, so that any shared run of GRAM + WINDOW - 1 words has a fingerprint on both sides.  Fingerprints of
documents and items are joined, and a hit is extended to the windows of that many words whose fingerprint
it is: these are joined by 128 bits of hash.  An item shorter than a window is one window
of its own length and its own fingerprint, looked up at every word.

Documents send only fingerprints that pass a bitmap of those of the items, built by grouped sums and of a size that follows
the items up to 2**MOST_BITS bits; beyond that it lets more pass, which the joins sort out.  So any number of items fits:
they are never held in one place, and a document's text is read where it lies.  Hits of a text go back to its rows by
128 bits of hash of the text; that table is broadcast if it is small by its written size, else joined.

Defined cases: a null or wordless document has no words, no spans and no items; a null or wordless item
never occurs; items with one id count as one item; an item without id counts under the id ''; repeated
documents are judged each; columns of the results' names in the input are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, inner, keep_names, quoted
from .words import ALNUM, LOWER, batches, mix, prefix, release, rolling, span, text_buffer, tokenize, within

GRAM = 8
LEAST_BITS, MOST_BITS, SMALL_BYTES = 16, 27, 32 << 20
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def _windows(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the n words from each start."""
    a = mix(span(prefix(hashes), starts, starts + n))
    return a.view(np.int64), mix(span(prefix(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))), starts, starts + n)).view(np.int64)


def _least(grams: np.ndarray, window: int) -> np.ndarray:
    """Least of every window consecutive grams."""
    n = len(grams) - window + 1
    if n <= 0:
        return grams[:0]
    out = grams[:n].copy()
    for i in range(1, window):
        np.minimum(out, grams[i : i + n], out=out)
    return out


def winnow(grams: np.ndarray, first: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the least of every window consecutive grams of one text, ties included."""
    least = _least(grams, window)
    n = len(least)
    inside = within(first, gram + window - 1, n)
    chosen = np.zeros(len(grams), bool)
    for i in range(window if n else 0):
        chosen[i : i + n] |= inside & (grams[i : i + n] == least)
    return np.flatnonzero(chosen)


def _print(values: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of windows of n words: its hash, told apart by n."""
    return mix(values ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)


def _fingerprints(tokens, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of each window of n words in one text; full windows have the least of their grams."""
    own = _least(rolling(tokens.hash, GRAM), words - GRAM + 1) if n == words else rolling(tokens.hash, n)
    at = np.flatnonzero(within(tokens.first, n, len(own)))
    return at, _print(own[at], n)


def item_windows(items: DataFrame, words: int) -> DataFrame:
    """(item, n, print, a, b) of items (item, text): every window with its fingerprint and its hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "n", "print", "a", "b"]
        for part in parts:
            for x, y in batches(part.column(1)):
                tokens = tokenize(*text_buffer(part.column(1).slice(x, y - x)), ALNUM, LOWER)
                sizes, ids = np.minimum(np.diff(tokens.first), words), part.column(0).slice(x, y - x)
                for n in np.unique(sizes[sizes > 0]).tolist():
                    at, prints = _fingerprints(tokens, n, words)
                    doc = np.searchsorted(tokens.first, at, "right") - 1
                    own = sizes[doc] == n
                    at, prints, doc = at[own], prints[own], doc[own]
                    a, b = _windows(tokens.hash, at, n)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(np.full(len(at), n, np.int32)), pa.array(prints), pa.array(a), pa.array(b)], names)
            release()

    return items.select("item", "text").mapInArrow(run, "item string, n int, print long, a long, b long")


def _bitmap(prints: DataFrame) -> tuple[np.ndarray, int]:
    """Words of 64 bits that say which first bits of a fingerprint occur, and the number of these bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (prints.count() * 16).bit_length()))
    place = F.shiftrightunsigned("print", 64 - bits)
    words = prints.select(F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()  # 2**(MOST_BITS - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def candidates(texts: DataFrame, lengths: list[int], words: int, bitmap: tuple[np.ndarray, int]) -> DataFrame:
    """(x, y, n, print, a, b, starts) of texts (x, y, text): windows that pass the bitmap, with the words at which they start."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)
    kinds = [("x", pa.int64()), ("y", pa.int64()), ("n", pa.int32()), ("print", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("starts", pa.list_(pa.int32()))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = sent.value
        for part in parts:
            for lo, hi in batches(part.column(2)):
                tokens = tokenize(*text_buffer(part.column(2).slice(lo, hi - lo)), ALNUM, LOWER)
                for n in lengths:
                    at, prints = _fingerprints(tokens, n, words)
                    place = prints.view(np.uint64) >> np.uint64(64 - bits)
                    live = (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    at, prints = at[live], prints[live]
                    if not len(at):
                        continue
                    a, b = _windows(tokens.hash, at, n)
                    doc = np.searchsorted(tokens.first, at, "right") - 1
                    order = np.lexsort((at, b, a, doc))
                    at, prints, a, b, doc = (v[order] for v in (at, prints, a, b, doc))
                    new = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
                    starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array((at - tokens.first[doc]).astype(np.int32)))
                    rows = pa.array(doc[new] + lo)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.full(len(new), n, np.int32)), pa.array(prints[new]), pa.array(a[new]), pa.array(b[new]), starts], schema=pa.schema(kinds))
            release()

    return texts.select("x", "y", "text").mapInArrow(run, "x long, y long, n int, print long, a long, b long, starts array<int>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 13) -> DataFrame:
    """docs with n_words, hit_spans (word positions, end exclusive) and item_ids (sorted) for windows of so many words."""
    if words < GRAM:
        raise ValueError(f"windows need {GRAM} words or more")
    scratch, names = Scratch(docs.sparkSession), [x.name for x in RESULT]
    kept = keep_names(docs, names)
    own = F.col(f"`{text}`")
    keys = {"x": F.xxhash64(own), "y": F.xxhash64(F.lit(words), own)}
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    windows = scratch.write(item_windows(items, words).distinct(), "items")
    prints = windows.select("n", "print").distinct()
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # 1 to words
    sent = scratch.write(candidates(docs.where(own.isNotNull()).select(keys["x"].alias("x"), keys["y"].alias("y"), own.alias("text")), lengths, words, _bitmap(prints)), "candidates")
    joined = sent.join(prints, ["n", "print"], "left_semi").join(windows.select("item", "n", "a", "b"), ["n", "a", "b"])
    hits = scratch.write(joined.select("x", "y", "n", "starts", "item").distinct(), "hits")
    ids = hits.groupBy("x", "y").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    places = hits.select("x", "y", "n", F.explode("starts").alias("start")).groupBy("x", "y", "start").agg((F.col("start") + F.max("n")).alias("end"))
    by_start = Window.partitionBy("x", "y").orderBy("start")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = places.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("x", "y", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))
    found = scratch.write(spans.join(ids, ["x", "y"]), "found")
    if scratch.size("found") <= SMALL_BYTES:
        found = F.broadcast(found)
    scratch.drop("items", "candidates", "hits")
    x, y = inner("x", kept), inner("y", kept)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], keys["x"].alias(x), keys["y"].alias(y))
    out = rows.join(found.withColumnsRenamed({"x": x, "y": y}), [x, y], "left")
    empty = {n.name: F.expr(f"cast(array() as {n.dataType.simpleString()})") for n in RESULT[1:]}
    count = F.coalesce(F.regexp_count(own, F.lit(_WORD)), F.lit(0)).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in kept], count.alias("n_words"), *[F.coalesce(n, v).alias(n) for n, v in empty.items()])


def _hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))


def contaminated() -> F.Column:
    """The rule: some word is hit, and a twentieth of all words or more."""
    return (_hit() > 0) & (20 * _hit() >= F.col("n_words"))


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    columns = quoted(docs.columns)
    return find_contamination(docs, benchmark).where(~contaminated()).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        _hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


#: DuckDB SQL of query().
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') g from (select item_id, w, least(len(w), 13) n, unnest(range(1, len(w) - least(len(w), 13) + 2)) p from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, lens where len(w) >= n)),
h as (select dw.doc_id, dw.p, dw.n, bw.item_id from dw join bw using (n, g)),
hw as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from (select distinct doc_id, p, n from h)) group by 1),
hi as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) s from (select distinct doc_id, cast(item_id as varchar) i from h) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""
