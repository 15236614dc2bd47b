"""Suffix-array dedup of byte strings, by external induced sorting of shards.

Two documents share a string of WINDOW bytes only if they share its anchor, the least hash of the GRAM-byte
grams in it.  Documents of one text are one class: those of greater id than its least lose the whole text, as every
window starts in that one too, and only the least takes part in what follows.  Anchors of all windows are dealt by hash
to parts and counted there; a part answers each class with those that stand in other classes too.  The windows with such anchors, a superset of all
shared ones, are cut out as pieces (windows in a row with one anchor) and dealt by anchor to shards.  A shard
writes each distinct piece once and sorts the suffixes of the whole by external induced sorting (induced.py), which
gives them in order with the common prefix of neighbours: suffixes with WINDOW bytes in common form a group, in which
every document but that of least id loses the string.  Anchors only select; equality is that of bytes, in the sort as well as
where windows of one slice or whole pieces are found equal by hash, which is confirmed byte by byte.

Within a slice of documents, what repeats in the slice itself is settled at once, so that a string of very many
documents reaches its shard once per slice.  Anchors that a sample shows to be frequent are known to be shared and not
counted; windows with them are dealt by their least and their greatest gram together, so that the surroundings of such a
string spread over all shards, some windows in a row still make one piece, and, where there are more than FAN slices, in two levels: first among some of the slices, then what is left of each.

The leftmost-S suffixes are sorted by merging instead of by recursion into a reduced text, as only WINDOW bytes of
order matter; see the README.

Defined cases: a null text is empty; a shorter text loses nothing; a null id comes after all others; of rows with
one id none is smaller; the kept bytes need not be valid UTF-8 and so are binary; an input column named
like a result is replaced, others are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import among, hot_anchors, shared, sliding_min, take_runs
from .induced import space, suffix_order
from .op2_substrings import document_keys, part_count, text_bytes
from .scratch import Scratch, inner, keep_names
from .words import BYTE_VALUES, batches, mix, prefix, rolling, span, text_buffer, within

WINDOW, GRAM, SLICE, FAN, MEMORY = 50, 20, 2 << 20, 1024, 64 << 20
#: Bytes of pieces in a shard, and of a piece: some (WINDOW - GRAM + 2) / 2 windows in a row have one anchor.
SHARD_BYTES, PIECE = 5 << 20, WINDOW - 1 + (WINDOW - GRAM + 2) // 2
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("kept_bytes", T.BinaryType()),
]


class Slice:
    """All windows of some texts: anchor of each place, and runs of windows in a row with one anchor."""

    def __init__(self, column: pa.Array):
        self.buffer, self.offsets = text_buffer(column)
        self.values = BYTE_VALUES[self.buffer]
        self.grams = rolling(self.values, GRAM)
        self.anchor = sliding_min(self.grams, WINDOW - GRAM + 1)
        ok = within(self.offsets, WINDOW, len(self.anchor))
        new = ok.copy()
        if len(ok):
            new[1:] &= ~(ok[:-1] & (self.anchor[1:] == self.anchor[:-1]))
        self.first = np.flatnonzero(new)
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1
        # a window beside another is never of another text, as those that cross texts lie between
        ends = np.append(self.first[1:], len(ok))
        last = np.maximum(self.offsets[self.doc + 1] - WINDOW + 1, self.first)
        self.count = np.minimum(ends, last) - self.first

    def spread(self, at: np.ndarray) -> np.ndarray:
        """Route of the windows of frequent anchors at some places."""
        most = ~sliding_min(~self.grams, WINDOW - GRAM + 1)[at] if len(at) else self.anchor[at]
        return mix(self.anchor[at] ^ mix(most))


def spread(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for places of a text."""
    out, n = [np.zeros(0, np.uint64)], WINDOW - GRAM + 1
    for x in range(0, len(at), 1 << 14):
        own = at[x : x + (1 << 14)]
        grams = rolling(BYTE_VALUES[text[take_runs(own, np.full(len(own), WINDOW))]], GRAM)
        grams = grams[take_runs(np.arange(len(own)) * WINDOW, np.full(len(own), n))].reshape(-1, n)
        out.append(mix(grams.min(axis=1) ^ mix(grams.max(axis=1))))
    return np.concatenate(out)


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    own = Slice(column)
    return own.anchor[own.first], own.doc


def _codes(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 bits of the hash: enough to select, as a false match only adds a candidate."""
    return ((anchor % np.uint64(parts)) << np.uint64(32)) | (anchor >> np.uint64(32))


def _group_bytes(rows: np.ndarray, values: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    cuts = np.concatenate(([0], np.flatnonzero(rows[1:] != rows[:-1]) + 1, [len(rows)])) if len(rows) else [0]
    return {int(rows[a]): values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])}


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])).tolist() if len(part) else [0]
    return list(zip(at[:-1], at[1:]))


def shared_anchors(keyed: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """(doc, found) of texts (doc, text), where one text is one doc: codes of its anchors that others have too, as hot ones do."""
    sent_hot = keyed.sparkSession.sparkContext.broadcast(hot)

    def send(batch_list: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_list:
            docs, texts = batch.column(0).to_numpy(), batch.column(1)
            for a, b in batches(texts, SLICE):
                own = Slice(texts.slice(a, b - a))
                anchor = own.anchor[own.first]
                code, doc, frequent = _codes(anchor, parts), docs[a:b][own.doc], among(anchor, sent_hot.value)
                order = np.lexsort((doc, code))
                code, doc, frequent = code[order], doc[order], frequent[order]
                once = np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))) if len(code) else np.zeros(0, bool)
                code, doc, frequent = code[once], doc[once], frequent[once]
                known = shared(code, doc) | frequent
                lone = ~known
                if len(code):
                    lone[np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))] = True
                lone &= ~frequent
                part = (code >> np.uint64(32)).astype(np.int32)
                rows = [{"part": int(part[lone][x]), "blob": _pair((code[lone][x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc[lone][x:y])} for x, y in _cuts(part[lone])]
                if known.any():
                    rows.append({"part": -1 - int(docs[a] % parts), "known": _pair(code[known], doc[known])})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("known", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        """Codes and documents of shared anchors, packed by bucket of documents."""
        code, doc = _pairs(table["known"], np.uint64)
        low, own = _pairs(table["blob"], np.uint32)
        many = shared(low, own)
        code = np.concatenate([code, low[many].astype(np.uint64) | np.uint64(max(0, table["part"][0].as_py()) << 32)])
        doc = np.concatenate([doc, own[many]])
        order = np.lexsort((doc, code))  # copies in several slices have sent the same
        code, doc = code[order], doc[order]
        once = np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))) if len(code) else np.zeros(0, bool)
        return _by_bucket(code[once], doc[once], parts)

    sent = keyed.select("doc", "text").mapInArrow(send, "part int, blob binary, known binary")
    return _by_document(sent.groupBy("part").applyInArrow(count, "bucket int, pairs binary"))


def _by_bucket(values: np.ndarray, doc: np.ndarray, buckets: int) -> pa.Table:
    """Values and their documents, packed by bucket of documents: a part has one answer per bucket, not per document."""
    bucket = (doc.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, values, doc = bucket[order], values[order], doc[order]
    cuts = _cuts(bucket)
    return pa.table({"bucket": pa.array([int(bucket[x]) for x, _ in cuts], pa.int32()), "pairs": pa.array([_pair(values[x:y], doc[x:y]) for x, y in cuts], pa.binary())})


def _by_document(packed: DataFrame) -> DataFrame:
    """(doc, found) from (bucket, pairs)."""

    def answer(table: pa.Table) -> pa.Table:
        found = _group_bytes(*reversed(_pairs(table["pairs"], np.uint64)))
        return pa.table({"doc": pa.array(list(found), pa.int64()), "found": pa.array(list(found.values()), pa.binary())})

    return packed.groupBy("bucket").applyInArrow(answer, "doc long, found binary")


def _pair(values: np.ndarray, docs: np.ndarray) -> bytes:
    return values.tobytes() + docs.tobytes()


def _pairs(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and documents of a column of pairs."""
    size, values, docs = np.dtype(kind).itemsize, [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for x in column.to_pylist():
        if x is not None:
            n = len(x) // (size + 8)
            values.append(np.frombuffer(x, kind, n))
            docs.append(np.frombuffer(x, np.int64, n, n * size))
    return np.concatenate(values), np.concatenate(docs)


def same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the WINDOW bytes from each place of a are those from that of b."""
    eight = np.ndarray((max(0, len(buffer) - 7),), np.uint64, np.ascontiguousarray(buffer), strides=(1,))
    out = np.ones(len(a), bool)
    for x in range(0, len(a), 1 << 16):
        p, q = a[x : x + (1 << 16)], b[x : x + (1 << 16)]
        for at in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
            out[x : x + (1 << 16)] &= eight[p + at] == eight[q + at]
    return out


def _known(buffer: np.ndarray, at: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows a document of smaller id has too, among these windows: by hash, confirmed on the bytes."""
    order = np.lexsort((ids, hashes))
    key = hashes[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(new, len(key))))
    out = ids[first] < ids
    which = np.flatnonzero(out)
    out[which] = same_bytes(buffer, at[which], at[first[which]])
    return out


def _pieces(own: Slice, ids: np.ndarray, docs: np.ndarray, found: list, parts: int, shards: int, hot: np.ndarray, fan: int):
    """Packed pieces by shard, and (row, first, end) of the repeats known from the slice alone."""
    code = _codes(own.anchor[own.first], parts)
    wanted = [np.frombuffer(x, np.uint64) for x in found]
    row = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]).astype(np.uint64)
    table = np.sort(mix(np.concatenate(wanted) ^ mix(row))) if wanted else np.zeros(0, np.uint64)
    live = among(mix(code ^ mix(own.doc.astype(np.uint64))), table)
    first, count = own.first[live], own.count[live]
    at = take_runs(first, count)
    if not len(at):
        return {}, np.zeros((3, 0), np.int64)
    doc = np.repeat(own.doc[live], count)
    sums = prefix(own.values)
    hashes = mix(span(sums, at, at + WINDOW))
    repeat = _known(own.buffer, at, hashes, ids[doc])
    known = _intervals(doc[repeat], at[repeat] - own.offsets[doc[repeat]])
    at, doc = at[~repeat], doc[~repeat]
    key = own.anchor[at]
    frequent = among(key, hot)
    key[frequent] = own.spread(at[frequent])
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(doc) != 0) | (key[1:] != key[:-1])))) if len(at) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(at)))
    part = (mix(key[new]) % np.uint64(shards)).astype(np.int32)
    if fan > 1:
        salt = np.uint64(int(docs[0]) % fan + 1)
        part = np.where(frequent[new], shards + (mix(key[new] ^ mix(np.full(1, salt))) % np.uint64(shards)).astype(np.int32), part)
    text = own.buffer[take_runs(at[new], counts + WINDOW - 1)]
    return _pack(part, ids[doc[new]], docs[doc[new]], at[new] - own.offsets[doc[new]], counts, text), known


def _pack(part: np.ndarray, ids: np.ndarray, docs: np.ndarray, start: np.ndarray, counts: np.ndarray, text: np.ndarray) -> dict[int, bytes]:
    """Pieces by part: number, ids, documents, places, numbers of windows, and the bytes one after the other."""
    ends = np.cumsum(counts + WINDOW - 1)
    order = np.argsort(part, kind="stable")
    part, packed = part[order], {}
    for x, y in _cuts(part):
        own = order[x:y]
        size = counts[own] + WINDOW - 1
        arrays = (np.array([y - x], np.int64), ids[own], docs[own], start[own].astype(np.int32), counts[own].astype(np.int32), text[take_runs(ends[own] - size, size)])
        packed[int(part[x])] = _squeeze(b"".join(v.tobytes() for v in arrays))
    return packed


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    own: list[list[np.ndarray]] = [[] for _ in range(5)]
    for blob in map(_unsqueeze, blobs):
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for k, kind in enumerate((np.int64, np.int64, np.int32, np.int32)):
            own[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        own[4].append(np.frombuffer(blob, np.uint8, -1, at))
    return [np.concatenate(x) for x in own]


def _squeeze(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _unsqueeze(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _intervals(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in a row (row, first, end), of sorted rows and places."""
    if not len(at):
        return np.zeros((3, 0), np.int64)
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(rows) != 0))))
    last = np.append(new[1:], len(at)) - 1
    return np.stack([rows[new], at[new], at[last] + 1])


def _encode(found: np.ndarray) -> np.ndarray:
    """First and end of each interval in 64 bits."""
    return np.ascontiguousarray(found[1:].T.astype(np.int32)).view(np.uint64).ravel()


def _distinct(text: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First piece of each kind, and each piece's kind: pieces of one hash whose bytes are the same."""
    hashes = mix(span(prefix(BYTE_VALUES[text]), end - length, end) ^ length.astype(np.uint64))
    _, pick, kind = np.unique(hashes, return_index=True, return_inverse=True)
    alike = length[pick[kind]] == length
    other = text[take_runs(np.where(alike, end[pick[kind]] - length, end - length), length)]
    alike &= np.logical_and.reduceat(other == text, end - length)
    odd = np.flatnonzero(~alike)
    kind[odd] = len(pick) + np.arange(len(odd))
    return np.append(pick, odd), kind


def sort_shard(ids: np.ndarray, start: np.ndarray, count: np.ndarray, text: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Piece and place of every window that a piece of smaller id has too; text: the pieces one after the other."""
    count = count.astype(np.int64)
    length = count + WINDOW - 1
    end = np.cumsum(length)
    pick, kind = _distinct(text, end, length)
    least = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    own_length, own_count = length[pick], count[pick]
    first = np.cumsum(own_length + 1) - own_length - 1
    total = int((own_length + 1).sum())
    joined = space(total, np.uint8, memory)
    for x in range(0, len(pick), 1 << 14):
        y = min(len(pick), x + (1 << 14))
        joined[take_runs(first[x:y], own_length[x:y])] = text[take_runs(end[pick[x:y]] - own_length[x:y], own_length[x:y])] + 1
    by_place = space(total, np.int64, memory, np.iinfo(np.int64).max)
    held, smallest_id, carry = [], 0, WINDOW  # the group that is still open

    def close() -> None:
        for at in held:
            by_place[at] = smallest_id

    for at, lcp in suffix_order(joined, WINDOW, memory):
        piece = np.searchsorted(first, at, "right") - 1
        which = np.flatnonzero(at - first[piece] < own_count[piece])
        if not len(which):
            carry = min(carry, int(lcp.min()))
            continue
        to = int(which[-1]) + 1
        common = np.minimum.reduceat(lcp[:to], np.concatenate(([0], which[:-1] + 1)))
        common[0] = min(int(common[0]), carry)
        carry = int(lcp[to:].min()) if to < len(lcp) else WINDOW
        at, own = at[which], least[piece[which]]
        cuts = np.flatnonzero(common < WINDOW)
        head = int(cuts[0]) if len(cuts) else len(at)
        if head and held:
            held.append(at[:head])
            smallest_id = min(smallest_id, int(own[:head].min()))
        elif head:
            held, smallest_id = [at[:head]], int(own[:head].min())
        if len(cuts):
            close()
            groups = np.minimum.reduceat(own, cuts)
            last = int(cuts[-1])
            by_place[at[head:last]] = np.repeat(groups[:-1], np.diff(cuts))
            held, smallest_id = [at[last:]], int(groups[-1])
    close()
    pieces, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    steps = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()), 1 << 20), "left")
    edges = np.unique(np.concatenate((steps, [0, len(ids)])))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        piece = np.repeat(np.arange(x, y), count[x:y])
        place = take_runs(np.zeros(y - x, np.int64), count[x:y])
        repeat = by_place[first[kind[piece]] + place] < ids[piece]
        pieces.append(piece[repeat])
        places.append(start[piece[repeat]] + place[repeat])
    return np.concatenate(pieces), np.concatenate(places)


_DEALT = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("known", pa.binary())])


def find_repeats(candidates: DataFrame, parts: int, shards: int, hot: np.ndarray, fan: int, scratch: Scratch) -> DataFrame:
    """(doc, found) for documents (id, doc, text, found): intervals of places at which repeated windows start."""
    sent = candidates.sparkSession.sparkContext.broadcast(hot)

    def send(batch_list: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_list:
            ids, docs, texts, found = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_pylist()
            for a, b in batches(texts, SLICE):
                packed, known = _pieces(Slice(texts.slice(a, b - a)), ids[a:b], docs[a:b], found[a:b], parts, shards, sent.value, fan)
                rows = [{"part": p, "blob": x} for p, x in packed.items()]
                if known.size:
                    rows.append({"part": -1 - int(docs[a] % shards), "known": _pair(_encode(known), docs[a:b][known[0]])})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _DEALT)

    def settle(table: pa.Table) -> pa.Table:
        """First level of the frequent windows: repeats among some slices, and the pieces that are left for the second."""
        ids, docs, start, count, text = _unpack(table["blob"].to_pylist())
        piece, place = sort_shard(ids, start, count, text)
        spans = _intervals(docs[piece], place)
        rows = [{"part": -1 - int(docs[0] % shards), "known": _pair(_encode(spans), spans[0])}] if spans.size else []
        left = np.bincount(piece, minlength=len(ids)) < count
        size = count.astype(np.int64) + WINDOW - 1
        begin = np.cumsum(size) - size
        key = spread(text, begin[left])
        packed = _pack((mix(key) % np.uint64(shards)).astype(np.int32), ids[left], docs[left], start[left], count[left], text[take_runs(begin[left], size[left])])
        return pa.Table.from_pylist(rows + [{"part": p, "blob": x} for p, x in packed.items()], _DEALT)

    def sort(table: pa.Table) -> pa.Table:
        found, doc = _pairs(table["known"], np.uint64)
        blobs = [x for x in table["blob"].to_pylist() if x is not None]
        if blobs:
            ids, docs, start, count, text = _unpack(blobs)
            piece, place = sort_shard(ids, start, count, text)
            spans = _intervals(docs[piece], place)
            found, doc = np.concatenate([found, _encode(spans)]), np.concatenate([doc, spans[0]])
        return _by_bucket(found, doc, parts)

    kind = "part int, blob binary, known binary"
    dealt = candidates.select("id", "doc", "text", "found").mapInArrow(send, kind)
    if fan > 1:
        dealt = scratch.write(dealt, "pieces")
        dealt = dealt.where(F.col("part") < shards).unionByName(dealt.where(F.col("part") >= shards).groupBy("part").applyInArrow(settle, kind))
    return _by_document(dealt.groupBy("part").applyInArrow(sort, "bucket int, pairs binary"))


def text_classes(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(text_key, id): the least id of each text; (doc): the documents (id, text_key, text) of greater id.  Texts are told by 128 bits."""
    check = F.xxhash64(F.sha2(F.col("text").cast("binary"), 256))
    ids = scratch.write(keyed.select("id", "text_key", check.alias("check")), "ids")
    classes = scratch.write(ids.groupBy("text_key", "check").agg(F.min("id").alias("least"), F.max("id").alias("most")), "classes")
    several = classes.where("least < most").select("text_key", "check", "least")
    copies = ids.join(several, ["text_key", "check"]).where("id > least").select(F.xxhash64("id", "text_key").alias("doc")).distinct()
    return classes.select("text_key", F.col("least").alias("id")).distinct(), copies


def _cover(found: bytes | None, size: int) -> list[tuple[int, int]]:
    if found is None:
        return []
    if not found:  # a copy of a smaller document
        return [(0, size)] if size >= WINDOW else []
    x = np.frombuffer(found, np.int32).reshape(-1, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    start, end = x[:, 0], np.maximum.accumulate(x[:, 1] + WINDOW - 1)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(x)) - 1].tolist()))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, removed_spans (byte positions, maximal, end exclusive) and kept_bytes."""
    names = [x.name for x in RESULT]
    scratch = Scratch(docs.sparkSession)
    own = keep_names(docs, names)
    number, key = document_keys(doc_id, text)
    doc = F.xxhash64(number, key)
    keyed = docs.select(number.alias("id"), key.alias("text_key"), F.col(f"`{text}`").alias("text"))
    hot = hot_anchors(keyed, _runs)
    total = text_bytes(docs, text)
    parts = part_count(total, 1.0)
    least, copies = text_classes(keyed, scratch)
    selected = shared_anchors(keyed.select(F.col("text_key").alias("doc"), "text"), parts, hot).withColumnRenamed("doc", "text_key")
    selected = scratch.write(selected.join(least, "text_key"), "anchors")
    runs = (selected.agg(F.sum(F.length("found"))).first()[0] or 0) // 8
    candidates = keyed.join(selected, ["text_key", "id"]).select("id", F.xxhash64("id", "text_key").alias("doc"), "text", "found")
    found = find_repeats(candidates, parts, max(16, int(runs * PIECE / SHARD_BYTES) + 1), hot, max(1, int(total / (SLICE * FAN))), scratch)
    found = found.unionByName(copies.withColumn("found", F.expr("X''")))
    mark, body, answer = (inner(x, own) for x in ("doc", "text", "found"))
    found = scratch.write(found.select(F.col("doc").alias(mark), F.col("found").alias(answer)), "repeats")
    scratch.drop("ids", "classes", "anchors", "pieces")
    scratch.free()
    held = docs.select(*[F.col(f"`{c}`") for c in own], doc.alias(mark), F.col(f"`{text}`").alias(body))
    joined = held.join(found, mark, "left").select(*[F.col(f"`{c}`") for c in own], body, answer)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts, spans, kept = [], [], []
            for value, at in zip(part.column(part.num_columns - 2), part.column(part.num_columns - 1)):
                data = (value.as_py() or "").encode()
                cover = _cover(at.as_py(), len(data))
                counts.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in cover])
                edges = [0, *[x for pair in cover for x in pair], len(data)]
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2])) if cover else data)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], [*own, *names])

    return joined.mapInArrow(run, T.StructType([*joined.schema.fields[: len(own)], *RESULT]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


#: DuckDB SQL of query(), over pairs of hexadecimal digits.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
g as (select doc_id, p, substr(h, 2 * p - 1, 100) g from (select doc_id, h, unnest(range(1, length(h) // 2 - 48)) p from d where length(h) >= 100)),
m as (select g, min(doc_id) m from g group by 1 having count(*) > 1),
r as (select distinct doc_id, unnest(range(p, p + 50)) q from g join m using (g) where doc_id > m),
n as (select doc_id, count(*) n, count(*) filter (not adjacent) spans from (select doc_id, coalesce(lag(q) over (partition by doc_id order by q) = q - 1, false) adjacent from r) group by 1),
k as (select doc_id, string_agg(substr(h, 2 * q - 1, 2), '' order by q) t from (select doc_id, h, unnest(range(1, length(h) // 2 + 1)) q from d) anti join r using (doc_id, q) group by 1)
select d.doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed, cast(coalesce(spans, 0) as bigint) n_spans, sha256(unhex(coalesce(t, ''))) kept_sha256
from d left join n using (doc_id) left join k using (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The definition itself, for tests."""
    least: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - WINDOW + 1):
            w = b[p : p + WINDOW]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - WINDOW + 1):
            if least[b[p : p + WINDOW]] < i:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
