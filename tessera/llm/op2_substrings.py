"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted across documents in Spark.

Map: a slice of documents hashes every window.  A window that stands in several documents of the slice is
kept for the one of least id; for the others it is known to repeat.  What is left is packed by part of the
hash space: windows in a row with one anchor (the least hash of the GRAM-word grams in the window, so
equal windows have equal anchors) travel as a run with one header, 9 bytes a window.
Reduce: a part finds the anchors of several documents, among their windows those of several documents, and
returns each repeat to its document.  However many documents hold a window, a slice sends one of them; windows
whose anchor a sample shows to be frequent are dealt by their own hash, so that the surroundings of a
passage of very many documents spread over all parts, and, where there are more than FAN slices, in two levels: first
among some of the slices, then what is left of each.
Last: positions meet their texts, and windows merge into maximal removal intervals.

Parts are a few MB and grow in number with the text.  Windows are told apart by 64-bit hashes, those of one
anchor only, so two different windows would need two equal hashes of 64 bits.

Defined cases: a null text has no words and an empty kept text; documents of fewer words lose nothing; a null id
comes after all others; of rows with one id none is smaller, so they don't cost each other words; an
input column named like a result is replaced, others are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import among, hot_anchors, shared, sliding_min, smallest, take_runs
from .scratch import Scratch, inner, keep_names
from .words import SPACED, batches, mix, rolling, text_buffer, tokenize, within

WINDOW, GRAM, SLICE, PART_BYTES, FAN = 50, 25, 4 << 20, 12 << 20, 1024
_FOUND = "id long, text_key long, starts binary"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("kept_text", T.StringType()),
]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _hash_slice(column: pa.Array, ids: np.ndarray, keys: np.ndarray, window: int, parts: int, hot: np.ndarray, fan: int):
    """Packed runs by part, and the repeats known from the slice alone by row."""
    tokens = tokenize(*text_buffer(column), SPACED)
    gram = min(GRAM, window)
    windows = rolling(tokens.hash, window)
    anchors = sliding_min(rolling(tokens.hash, gram), window - gram + 1)
    at = np.flatnonzero(within(tokens.first, window, len(windows)))
    doc = np.searchsorted(tokens.first, at, "right") - 1
    own = ids[doc]
    repeat = smallest(windows[at], own) < own
    local = _by_row(doc[repeat], at[repeat] - tokens.first[doc[repeat]], len(column))
    at, doc = at[~repeat], doc[~repeat]
    if not len(at):
        return {}, local
    frequent = among(anchors[at], hot)
    anchor = np.where(frequent, windows[at], anchors[at])
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(doc) != 0) | (anchor[1:] != anchor[:-1]))))
    counts = np.diff(np.append(new, len(at)))
    part = (anchor[new] % np.uint64(parts)).astype(np.int64)
    if fan > 1:
        salt = mix(np.full(1, int(keys[0]) % fan + 1, np.uint64))
        part = np.where(frequent[new], parts + (mix(anchor[new] ^ salt) % np.uint64(parts)).astype(np.int64), part)
    values = windows[at[take_runs(new, counts)]]
    return _by_part(part, anchor[new], ids[doc[new]], keys[doc[new]], at[new] - tokens.first[doc[new]], counts, values), local


def _by_part(part: np.ndarray, anchor: np.ndarray, ids: np.ndarray, keys: np.ndarray, start: np.ndarray, counts: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    """Runs packed by part; values: the window hashes of all runs, one after the other."""
    order, ends = np.argsort(part, kind="stable"), np.cumsum(counts)
    part, packed = part[order], {}
    cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = order[a:b]
        packed[int(part[a])] = _pack(np.array([b - a], np.int64), anchor[own], ids[own], keys[own], start[own].astype(np.int32), counts[own].astype(np.int32), values[take_runs(ends[own] - counts[own], counts[own])])
    return packed


def _by_row(rows: np.ndarray, positions: np.ndarray, n: int) -> dict[int, bytes]:
    order = np.lexsort((positions, rows))
    rows, positions = rows[order], positions[order].astype(np.int32)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    return {i: positions[cuts[i] : cuts[i + 1]].tobytes() for i in np.unique(rows).tolist()}


def _unpack(blobs: list[bytes]):
    """anchor, id, key, start and count of all runs, and all window hashes."""
    out = [[] for _ in range(6)]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for k, kind in enumerate((np.uint64, np.int64, np.int64, np.int32, np.int32)):
            out[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        out[5].append(np.frombuffer(blob, np.uint64, -1, at))
    return [np.concatenate(x) for x in out]


def _repeats(blobs: list[bytes]):
    """id, key and start of every window that a document of smaller id has too; hash, id, key and start of the others."""
    anchor, ids, keys, start, count, values = _unpack(blobs)
    first = np.cumsum(count.astype(np.int64)) - count
    live = np.flatnonzero(shared(anchor, ids))
    pick = take_runs(first[live], count[live].astype(np.int64))
    run = np.repeat(live, count[live])
    own = ids[run]
    repeat = smallest(values[pick], own) < own
    gone = np.zeros(len(values), bool)
    gone[pick[repeat]] = True
    rest, of = np.flatnonzero(~gone), np.repeat(np.arange(len(ids)), count)
    at = lambda p: (ids[of[p]], keys[of[p]], start[of[p]] + (p - first[of[p]]))
    return at(pick[repeat]), (values[rest], *at(rest))


def _answers(ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    pairs, row = np.unique(np.stack([ids, keys], axis=1), axis=0, return_inverse=True) if len(ids) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    found = _by_row(row.ravel(), at, len(pairs))
    own = sorted(found)
    return pairs[own, 0], pairs[own, 1], [found[i] for i in own]


def _reduce(table: pa.Table) -> pa.Table:
    blobs = [x for x in table["blob"].to_pylist() if x is not None]
    if not blobs:
        return table.select(["id", "text_key", "starts"])
    ids, keys, starts = _answers(*_repeats(blobs)[0])
    return pa.table({"id": pa.array(ids), "text_key": pa.array(keys), "starts": pa.array(starts, pa.binary())})


def _settle(parts: int):
    """First level of the frequent windows: repeats among some slices, and the windows that are left for the second."""

    def settle(table: pa.Table) -> pa.Table:
        gone, (values, ids, keys, start) = _repeats(table["blob"].to_pylist())
        found_ids, found_keys, starts = _answers(*gone)
        packed = _by_part((values % np.uint64(parts)).astype(np.int64), values, ids, keys, start, np.ones(len(values), np.int64), values)
        none, more = [None] * len(packed), [None] * len(starts)
        part = np.concatenate([np.array(list(packed), np.int64), -1 - found_keys % parts])
        return pa.table(
            {
                "part": pa.array(part, pa.int32()),
                "blob": pa.array([*packed.values(), *more], pa.binary()),
                "id": pa.array([*none, *found_ids.tolist()], pa.int64()),
                "text_key": pa.array([*none, *found_keys.tolist()], pa.int64()),
                "starts": pa.array([*none, *starts], pa.binary()),
            }
        )

    return settle


def _runs(window: int):
    def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokens = tokenize(*text_buffer(column), SPACED)
        gram = min(GRAM, window)
        anchors = sliding_min(rolling(tokens.hash, gram), window - gram + 1)
        at = np.flatnonzero(within(tokens.first, window, len(anchors)))
        return anchors[at], np.searchsorted(tokens.first, at, "right") - 1

    return runs


def find_repeats(keyed: DataFrame, window: int, parts: int, fan: int, scratch: Scratch) -> DataFrame:
    """(id, text_key, starts) for documents (id, text_key, text): word positions at which repeated windows start."""

    sent_hot = keyed.sparkSession.sparkContext.broadcast(hot_anchors(keyed, _runs(window)))

    def run(batch_list: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "blob", "id", "text_key", "starts"]
        for batch in batch_list:
            ids, keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for a, b in batches(texts, SLICE):
                packed, local = _hash_slice(texts.slice(a, b - a), ids[a:b], keys[a:b], window, parts, sent_hot.value, fan)
                if packed:
                    none = [None] * len(packed)
                    yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], names)
                if local:
                    rows = np.array(list(local))
                    part = -1 - (keys[a:b][rows] % parts)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([None] * len(rows), pa.binary()), pa.array(ids[a:b][rows]), pa.array(keys[a:b][rows]), pa.array(list(local.values()), pa.binary())], names)

    kind = f"part int, blob binary, {_FOUND}"
    sent = keyed.select("id", "text_key", "text").mapInArrow(run, kind)
    if fan > 1:
        sent = scratch.write(sent, "windows")
        sent = sent.where(F.col("part") < parts).unionByName(sent.where(F.col("part") >= parts).groupBy("part").applyInArrow(_settle(parts), kind))
    return sent.groupBy("part").applyInArrow(_reduce, _FOUND)


def _cover(starts: list[bytes] | None, window: int) -> list[tuple[int, int]]:
    if not starts:
        return []
    at = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in starts]).astype(np.int64))
    new = np.flatnonzero(np.concatenate(([True], np.diff(at) > window)))
    return list(zip(at[new].tolist(), (np.append(at[new[1:] - 1], at[-1]) + window).tolist()))


def document_keys(doc_id: str, text: str) -> tuple[Column, Column]:
    """The id as a number, the greatest for null, and the hash of the text: rows alike in both get the same answer."""
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.col(f"`{text}`"))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0


def part_count(total: int, per_byte: float) -> int:
    """Parts of about PART_BYTES when each byte of text sends so many."""
    return max(16, int(total * per_byte / PART_BYTES) + 1)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, removed_spans (word positions, maximal, end exclusive) and kept_text (words joined by a space)."""
    names = [x.name for x in RESULT]
    scratch = Scratch(docs.sparkSession)
    own = keep_names(docs, names)
    number, key = document_keys(doc_id, text)
    total = text_bytes(docs, text)
    keyed = docs.select(number.alias("id"), key.alias("text_key"), F.col(f"`{text}`").alias("text"))
    found = find_repeats(keyed, window, part_count(total, 1.6), max(1, int(total / (SLICE * FAN))), scratch)
    i, k, body, at = (inner(x, own) for x in ("id", "key", "text", "starts"))
    found = scratch.write(found.groupBy("id", "text_key").agg(F.collect_list("starts").alias(at)).withColumnsRenamed({"id": i, "text_key": k}), "repeats")
    scratch.drop("windows")
    scratch.free()
    held = docs.select(*[F.col(f"`{c}`") for c in own], number.alias(i), key.alias(k), F.col(f"`{text}`").alias(body))
    joined = held.join(found, [i, k], "left").select(*[F.col(f"`{c}`") for c in own], body, at)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, spans, kept = [], [], []
            for value, starts in zip(part.column(part.num_columns - 2), part.column(part.num_columns - 1)):
                words = (value.as_py() or "").encode().split()
                cover = _cover(starts.as_py(), window)
                counts.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in cover])
                edges = [0, *[x for pair in cover for x in pair], len(words)]
                kept.append(b" ".join(w for s, e in zip(edges[::2], edges[1::2]) for w in words[s:e]).decode())
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], [*own, *names])

    return joined.mapInArrow(run, T.StructType([*joined.schema.fields[: len(own)], *RESULT]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL of query().
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, p, array_to_string(w[p:p + 49], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 48)) p from d where len(w) >= 50)),
m as (select g, min(doc_id) m from g group by 1 having count(*) > 1),
r as (select distinct doc_id, unnest(range(p, p + 50)) q from g join m using (g) where doc_id > m),
k as (select doc_id, w[q] x, q from (select doc_id, w, unnest(range(1, len(w) + 1)) q from d) anti join r using (doc_id, q)),
s as (select doc_id, string_agg(x, ' ' order by q) t, count(*) n from k group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join s using (doc_id)
"""
