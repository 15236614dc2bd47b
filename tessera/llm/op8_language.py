"""Language ID by Bayesian fusion of text, declared language, address suffix and host.

Text: log-likelihood of the letter trigrams (bytes folded to 6 bits) under one table per language, plus "und",
the uniform table, for texts that are no language.  Tables are fitted on a bounded sample of labelled rows:
SAMPLE to 2 SAMPLE distinct texts of least hash among those whose declared language is one of LANGUAGES.  A text counts in a
table as TEXT_WEIGHT trigrams at most, so that no long text with a wrong label rules it.  One task counts the trigrams of
these texts, batch by batch, and the driver gets its table of counts.  That is the only bound; the rest is counted over all rows.

Evidence: each row is first given its text's language; grouped sums of these give the likelihood of every
declared value and of every address suffix under each language, and the priors of hosts, smoothed to
their registered domain's and these to the overall shares.  The posterior of a row is the normalised product.
Text is read once for the likelihoods, which are kept beside the row's columns in a written table.  Hosts with a
HOT_SHARE of the rows or more meet their priors by broadcast, so that no task of the join gets one host's rows.

A row is kept if its best language is accepted and its posterior reaches MIN_POSTERIOR.

Defined cases: a null text, or one without letters, has no text evidence and is "und", rejected; a null
declared language, suffix or host is a value of its own; a declared value outside LANGUAGES counts as
"other"; without any labelled row the tables are uniform and everything rests on what is declared; repeated
rows are judged each; an input column named like a result is replaced, others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, inner, keep_names, quoted
from .words import batches, text_buffer

LANGUAGES, UND = ("en", "de", "fr", "es"), "und"
SAMPLE, TEXT_WEIGHT, MIN_POSTERIOR, STRENGTH, SHARE_UND = 1000, 1000.0, 0.5, 20.0, 0.001
HOT_SHARE = 1 / 1024
_UNIT, _CODES, _KINDS = 1 << 20, 64, (*LANGUAGES, UND)


def _folding() -> np.ndarray:
    """Bytes to 6 bits: 0 for all but letters, letters without case, and the bytes of other scripts."""
    table = np.zeros(256, np.uint32)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[128:] = 27 + np.arange(128) % 37
    return table


_FOLD = _folding()


def trigrams(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams with two letters or more, and the text of each."""
    x = _FOLD[buffer]
    if len(x) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = (x[:-2] * _CODES + x[1:-1]) * _CODES + x[2:]
    ok = (x[:-2] > 0).astype(np.int8) + (x[1:-1] > 0) + (x[2:] > 0) >= 2
    edges = offsets[1:-1]
    for back in (1, 2):
        at = edges - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return codes[at], np.searchsorted(offsets, at, "right") - 1


def weigh(table: np.ndarray, texts: pa.Array, languages: pa.Array) -> None:
    """Add the weighted trigrams of some texts to a table by trigram and language, in units of 1 / _UNIT, so that sums are exact."""
    which = np.array([LANGUAGES.index(x) for x in languages.to_pylist()], np.int64)
    for a, b in batches(texts):
        codes, doc = trigrams(*text_buffer(texts.slice(a, b - a)))
        weight = np.minimum(1.0, TEXT_WEIGHT / np.maximum(1, np.bincount(doc, minlength=b - a)))
        np.add.at(table, (codes, which[a:b][doc]), np.round(weight * _UNIT).astype(np.int64)[doc])


def fit(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of trigrams, one column per language and a uniform one for UND."""
    table = np.full((_CODES**3, len(_KINDS)), 0.05)
    np.add.at(table, (cells // len(LANGUAGES), cells % len(LANGUAGES)), counts / _UNIT)
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def likelihoods(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of trigrams and log-likelihoods of each text."""
    numbers, sums = np.zeros(len(column), np.int64), np.zeros((len(column), len(_KINDS)))
    for a, b in batches(column, 1 << 20):
        codes, doc = trigrams(*text_buffer(column.slice(a, b - a)))
        numbers[a:b] = np.bincount(doc, minlength=b - a)
        own = np.flatnonzero(numbers[a:b]) + a
        if len(own):
            starts = np.concatenate(([0], np.cumsum(numbers[own])[:-1]))
            sums[own] = np.add.reduceat(table[codes].astype(np.float64), starts, axis=0)
    return numbers, sums


def _fitted(rows: DataFrame) -> np.ndarray:
    """Tables of a sample of rows (text, declared), drawn by the least hash of text and language."""
    own = rows.where(F.col("text").isNotNull() & F.col("declared").isin(*LANGUAGES)).withColumn("key", F.xxhash64("text", "declared"))
    total = own.count()
    if total > 2 * SAMPLE:
        own = own.where(F.col("key") < -(1 << 63) + int((1 << 64) * (2 * SAMPLE / total)))
    least = own.select("key").distinct().orderBy("key").limit(2 * SAMPLE)
    drawn = own.join(F.broadcast(least), "key", "left_semi").dropDuplicates(["key"])  # 2 SAMPLE numbers at most

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((_CODES**3, len(LANGUAGES)), np.int64)
        for part in parts:
            weigh(table, part.column(0), part.column(1))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table.ravel()[cells])], ["cell", "n"])

    counts = drawn.select("text", "declared").coalesce(1).mapInArrow(run, "cell long, n long").toPandas()  # one task reads 2 SAMPLE texts, one at a time, and sends _CODES**3 cells a language at most
    return fit(counts["cell"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


def declared_language(value: Column) -> Column:
    """The main part of a language tag: one of LANGUAGES, other, or none."""
    low = F.lower(F.regexp_extract(value, r"^\s*([A-Za-z]+)", 1))
    return F.when(low.isin(*LANGUAGES), low).when(value.isNull() | (low == ""), F.lit("none")).otherwise(F.lit("other"))


def identify(rows: DataFrame, text: str = "text", declared: str | None = None, host: str | None = None, accepted: tuple[str, ...] = LANGUAGES, keep: list[str] | None = None) -> DataFrame:
    """rows with language, posterior, text_language and kept; declared and host name columns, if there are such; keep: the columns to return, all by default."""
    scratch, results = Scratch(rows.sparkSession), ["language", "posterior", "text_language", "kept"]
    own = keep_names(rows, results) if keep is None else keep
    name = lambda c: F.col(f"`{c}`").cast("string")
    where = F.coalesce(name(host), F.lit("")) if host else F.lit("")
    parts = F.split(where, r"\.")
    d, h, r, s, n, ll, body = (inner(x, own) for x in ("d", "h", "r", "s", "n", "ll", "text"))
    extra = {
        d: declared_language(name(declared)) if declared else F.lit("none"),
        h: where,
        r: F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(where),
        s: F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("")),
    }
    given_text = F.col(f"`{text}`")
    table = _fitted(rows.select(given_text.alias("text"), extra[d].alias("declared")))
    sent = rows.sparkSession.sparkContext.broadcast(table)
    held = rows.select(*[F.col(f"`{c}`") for c in own], *[v.alias(k) for k, v in extra.items()], given_text.alias(body))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            numbers, sums = likelihoods(part.column(part.num_columns - 1), sent.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(numbers) + 1) * len(_KINDS), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(numbers), lists], [*part.schema.names[:-1], n, ll])

    schema = T.StructType([*held.schema.fields[:-1], T.StructField(n, T.LongType()), T.StructField(ll, T.ArrayType(T.DoubleType()))])
    measured = scratch.write(held.mapInArrow(run, schema), "measured")
    names = F.array(*[F.lit(k) for k in _KINDS])
    top = lambda xs: F.element_at(names, F.array_position(xs, F.array_max(xs)).cast("int"))
    best = F.when(F.col(n) == 0, F.lit(UND)).otherwise(top(F.col(ll)))
    spread = measured.select(F.col(h).alias("h"), F.col(r).alias("r"), F.col(s).alias("s"), F.col(d).alias("d"), best.alias("best"))
    spread = scratch.write(spread.groupBy("h", "r", "s", "d", "best").agg(F.count(F.lit(1)).alias("c")), "counts")
    of_kind = lambda k: F.sum(F.when(F.col("best") == k, F.col("c")).otherwise(0)).cast("double")

    def shares(by: list[str], source: DataFrame) -> DataFrame:
        """by and shares: the kinds of each group, smoothed to its prior."""
        grouped = source.groupBy(*by).agg(F.array(*[of_kind(k) for k in _KINDS]).alias("counts"), F.first("prior").alias("prior"))
        total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) + STRENGTH
        return grouped.select(*by, F.zip_with("counts", "prior", lambda c, p: (c + STRENGTH * p) / total).alias("shares"))

    def given(by: str) -> DataFrame:
        counts = spread.groupBy(by).agg(F.array(*[of_kind(k) for k in _KINDS]).alias("counts"), F.sum("c").alias("n"))
        whole = counts.agg(*[F.sum(F.col("counts")[k]).alias(f"t{k}") for k in range(len(_KINDS))], F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        totals = F.array(*[F.lit(float(whole[f"t{k}"] or 0)) for k in range(len(_KINDS))])
        overall = (F.col("n") + 1.0) / float((whole["n"] or 0) + (whole["v"] or 0) + 1)
        return counts.select(by, F.zip_with("counts", totals, lambda c, t: F.log((c + STRENGTH * overall) / (t + STRENGTH))).alias(f"given_{by}"))

    whole = spread.agg(*[of_kind(k).alias(k) for k in _KINDS], F.sum("c").alias("n")).first()
    total = sum(whole[k] or 0.0 for k in _KINDS) + STRENGTH
    base = [((whole[k] or 0.0) + STRENGTH * (SHARE_UND if k == UND else (1 - SHARE_UND) / len(LANGUAGES))) / total for k in _KINDS]
    domains = shares(["r"], spread.withColumn("prior", F.array(*[F.lit(float(x)) for x in base])))
    hosts = shares(["h", "s"], spread.join(domains.withColumnRenamed("shares", "prior"), "r"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    seen = spread.groupBy("h").agg(F.sum("c").alias("rows"))
    facts = hosts.join(given("s"), "s").join(seen, "h").select("h", "rows", add(F.col("given_s"), F.transform("shares", lambda p: F.log(p))).alias("host_fact"))
    facts = scratch.write(facts, "facts")
    least = max(1.0, (whole["n"] or 0) * HOT_SHARE)
    hot = facts.where(F.col("rows") >= least).select(F.col("h").alias("hot_h"), F.col("host_fact").alias("hot_fact"))  # 1 / HOT_SHARE rows at most
    cold = facts.where(F.col("rows") < least).select("h", "host_fact")
    values = given("d")  # as few as declared_language() has
    mark = {x: inner(x, own) for x in ("hot_h", "hot_fact", "h2", "host_fact", "given_d", "d2")}
    out = measured.join(F.broadcast(hot.withColumnsRenamed(mark)), F.col(h) == F.col(mark["hot_h"]), "left")
    out = out.join(F.broadcast(values.withColumnsRenamed({"d": mark["d2"], "given_d": mark["given_d"]})), F.col(d) == F.col(mark["d2"]), "left")
    key = F.when(F.col(mark["hot_h"]).isNull(), F.col(h)).otherwise(F.concat(F.lit("\0"), F.xxhash64(F.col(ll), F.col(n)).cast("string")))
    out = out.withColumn(mark["hot_h"], key).join(cold.withColumnsRenamed({"h": mark["h2"], "host_fact": mark["host_fact"]}), F.col(mark["hot_h"]) == F.col(mark["h2"]), "left")
    fused = add(add(F.col(ll), F.col(mark["given_d"])), F.coalesce(mark["hot_fact"], mark["host_fact"]))
    final = inner("f", own)
    out = out.withColumn(final, fused)
    peak = F.array_max(final)
    mass = F.aggregate(final, F.lit(0.0), lambda a, x: a + F.exp(x - peak))
    language = F.when(F.col(n) == 0, F.lit(UND)).otherwise(top(F.col(final)))
    kept = language.isin(*accepted) & (1 / mass >= MIN_POSTERIOR)
    return out.select(*[F.col(f"`{c}`") for c in own], language.alias("language"), (1 / mass).alias("posterior"), best.alias("text_language"), kept.alias("kept"))


def stage(docs: DataFrame) -> DataFrame:
    """Documents in an accepted language, with their own columns."""
    return identify(docs, declared="lang", host="source").where("kept").select(*quoted(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text", "lang", "source"), declared="lang", host="source", keep=["doc_id"])
    return out.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw pages: text without tags, the language of the html tag, suffix and host of the address."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    rows = pages.select("page_id", text.alias("text"), F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1).alias("declared"), F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host"))
    out = identify(rows, declared="declared", host="host", keep=["page_id"])
    return out.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")
