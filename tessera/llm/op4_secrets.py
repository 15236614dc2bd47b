"""Secret scans: fixed patterns and a linear-chain conditional random field over tokens.

Tokens (runs of non-space bytes) are tagged secret begin, inside or outside from their shape, length and
digits, the words beside them and the file they stand in; Viterbi gives the best tagging.  Features and
scores of all tokens are computed as arrays.  Where a token's lead for "outside" exceeds twice the range of
the transition weights, every best path is outside there, so decoding runs only over what lies between
such tokens; the result is that of decoding each whole text.

The field is trained here, once per process, on TRAIN_LINES lines made by rule with a fixed seed: ordinary
words in several spellings, numbers, addresses and mails, and secrets of several forms.  No row of the corpus
is used, so results don't depend on the input's size.  The patterns' spans stay; the field adds spans
that overlap none of them (kind "field").

Defined cases: a null or empty text has no spans; repeated rows are judged each; an input column named like
the result is replaced, others are kept; positions are code points, end exclusive; the work on a token or a text
is in proportion to its length, however long it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, inner, keep_names, quoted
from .words import SPACED, Words, batches, release, text_buffer, tokenize

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "field"]
TRAIN_LINES, TRAIN_TOKENS, TRAIN_STEPS, MIN_SECRET = 1600, 22, 90, 8
#: Bytes of text whose tokens are scored at once; their arrays take some sixty times as much.
SLICE = 256 << 10
RESULT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

#: Words whose neighbourhood is evidence, in lower case.
TRIGGERS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"bearer", b"credential", b"private key"]
_ASSIGNED = [b"passw", b"secret", b"token", b"api"]


def _byte_classes() -> np.ndarray:
    table = np.full(256, 4, np.uint8)
    table[48:58], table[65:91], table[97:123], table[128:] = 0, 1, 2, 3
    return table


_CLASS, _HEXRUN = _byte_classes(), np.zeros(256, bool)
_HEXRUN[48:58] = _HEXRUN[97:103] = True
_LENGTHS = np.array([4, 8, 12, 16, 20, 28, 36, 44])


def _positions(low: bytes, keys: list[bytes], offsets: np.ndarray) -> np.ndarray:
    """Where the keys begin; what begins in one text and ends in the next is none."""
    found = []
    for key in keys:
        out, at = [], low.find(key)
        while at >= 0:
            out.append(at)
            at = low.find(key, at + 1)
        own = np.array(out, np.int64)
        found.append(own[offsets[np.searchsorted(offsets, own, "right")] >= own + len(key)])
    return np.sort(np.concatenate(found))


def features(tokens: Words, low: bytes) -> tuple[np.ndarray, list[int]]:
    """One row of small whole numbers per token, and the number of values of each."""
    kinds, n = _CLASS[tokens.buffer], len(tokens.start)
    size = tokens.end - tokens.start
    counts = []
    for k in (0, 1, 2, 3):
        sums = np.zeros(len(kinds) + 1, np.int32)
        np.cumsum(kinds == k, out=sums[1:], dtype=np.int32)
        counts.append(sums[tokens.end] - sums[tokens.start])
    digit, upper, lower, other = counts
    symbol = size - digit - upper - lower - other
    shape = (digit > 0) + 2 * (upper > 1) + 4 * (lower > 0) + 8 * (other > 0) + 16 * (symbol > 2)
    length = np.searchsorted(_LENGTHS, size, "right")
    share = np.where(digit == 0, 0, np.where(4 * digit < size, 1, np.where(4 * digit < 3 * size, 2, 3)))
    mark = np.zeros(n, np.int64)
    hits = np.searchsorted(tokens.start, _positions(low, TRIGGERS, tokens.offsets), "right") - 1
    mark[hits[hits >= 0]] = 1
    tail = tokens.buffer[tokens.end - 1] if n else np.zeros(0, np.uint8)
    assign = ((tail == 61) | (tail == 58)).astype(np.int64)
    inner = np.zeros(len(kinds) + 1, np.int32)
    np.cumsum(tokens.buffer == 61, out=inner[1:], dtype=np.int32)
    equals = np.minimum(inner[tokens.end] - inner[tokens.start] - (tail == 61), 1) if n else assign
    edge = np.zeros(n, bool)
    edge[tokens.first[:-1][np.diff(tokens.first) > 0]] = True

    def back(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[by:] = x[:-by] if by < n else out[by:]
        stop = np.flatnonzero(edge)
        for i in range(by):
            at = stop + i
            out[at[at < n]] = 0
        return out

    near = mark + 2 * back(mark, 1) + 4 * back(mark, 2) + 8 * back(assign, 1) + 16 * equals
    dense = (digit > 0) & (size >= 8)
    left = back(dense.astype(np.int64), 1)
    right = np.zeros(n, np.int64)
    if n > 1:
        right[:-1] = np.where(edge[1:], 0, dense[1:])
    doc = tokens.doc()
    marked = np.bincount(doc, mark, len(tokens.first) - 1)
    file = np.minimum(marked, 2).astype(np.int64)[doc] if n else np.zeros(0, np.int64)
    columns = [shape, length, share, near, left + 2 * right + 4 * dense, file * 2 + dense]
    return np.stack([x.astype(np.uint8) for x in columns], axis=1), [32, 9, 4, 32, 8, 6]


def _lines(rng: np.random.Generator, count: int) -> tuple[list[str], np.ndarray]:
    """Made-up lines of TRAIN_TOKENS tokens and their tags: 0 outside, 1 begin, 2 inside."""
    syllables = "the on er re an in ti es en sch un ge la que de ou ción as él über ça wor lo mi ta".split()
    letters, digits, mixed = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 6))))
        kind = rng.random()
        return w.capitalize() if kind < 0.2 else w.upper() + pick(["", "!!"]) if kind < 0.27 else w + pick(["###", "***", "%%%", "$$$", "&&&"]) if kind < 0.34 else w + pick([".", ",", "", "", "", ":"])

    def plain() -> list[str]:
        kind = rng.random()
        if kind < 0.80:
            return [word()]
        n = lambda a, b: draw(digits, int(rng.integers(a, b)))
        number = pick([n(1, 5), n(15, 20), f"{n(3, 4)}-{n(4, 5)}", ".".join(n(1, 4) for _ in range(4)), f"{word().strip('.,:')}.{n(2, 3)}@mail{n(1, 2)}.example.com", f"https://{word().strip('.,:!')}.example.com/{n(1, 5)}", f"{n(4, 5)}-{n(2, 3)}-{n(2, 3)}", "|", "-", f"v{n(1, 2)}.{n(1, 2)}.{n(1, 3)}", f"({n(2, 4)})", f"+{n(1, 3)}", "".join(pick(syllables) for _ in range(9)), f"{word().strip('.,:')}={n(1, 4)}"])
        return [number + pick(["", "", "", "!!", "###", "***", "."])]

    def trap() -> list[str]:
        return pick([["the", "token", "was"], ["secret", word()], ["password", "reset"], ["a", "bearer", "of"], ["token", "=", "none"], ["password:", word()], ["private", "key", word()], ["credential", word()]])

    def value() -> str:
        return pick([draw(digits + "abcdef", int(rng.integers(24, 65))), draw(digits + "ABCDEF", int(rng.integers(24, 65))), draw(mixed, int(rng.integers(16, 50))), "ghp_" + draw(mixed, 36), "sk-" + draw(mixed, 40), "eyJ" + draw(mixed, 20) + "." + draw(mixed, 24) + "." + draw(mixed, 24), "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)])

    def secret() -> tuple[list[str], list[int]]:
        name, quote, end = pick(["token", "password", "passwd", "secret", "api_key", "apikey", "TOKEN", "Secret", "credential"]), pick(["", '"', '"', "'"]), pick(["", "", "", "###", "!!", ",", ";"])
        kind = rng.random()
        short = draw(mixed, int(rng.integers(8, 16))) + draw(digits, 2)
        if kind < 0.4:
            return [name, "=", quote + pick([value(), short]) + quote + end], [0, 0, 1]
        if kind < 0.55:
            return [name + ":", quote + pick([value(), short]) + quote + end], [0, 1]
        if kind < 0.7:
            return [f"{name}={quote}{pick([value(), short])}{quote}{end}"], [1]
        if kind < 0.78:
            return ["Authorization:", "Bearer", value()], [0, 0, 1]
        if kind < 0.86:
            return [name, "=", *[draw(mixed, 5) + "-" + draw(digits, 4) + "-" + draw(mixed, 5) for _ in range(2)]], [0, 0, 1, 2]
        return [quote + value() + quote + end], [1]

    texts, tags = [], np.zeros((count, TRAIN_TOKENS), np.int64)
    for row in range(count):
        line: list[str] = []
        while len(line) < TRAIN_TOKENS:
            kind = rng.random()
            own, tag = secret() if kind < 0.05 else (trap(), []) if kind < 0.1 else (plain(), [])
            if len(line) + len(own) <= TRAIN_TOKENS:
                tags[row, len(line) : len(line) + len(tag)] = tag
                line += own
        texts.append(" ".join(line))
    return texts, tags


class Field:
    """Weights: one table per feature and the transitions between outside, begin and inside."""

    def __init__(self, tables: list[np.ndarray], moves: np.ndarray):
        self.tables, self.moves = tables, moves

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for k, table in enumerate(self.tables):
            out += table[rows[:, k]]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi tags of all tokens; see above for what is skipped."""
        tags = np.zeros(len(scores), np.int64)
        swing = 2 * (self.moves.max() - self.moves.min())
        free = np.flatnonzero(scores[:, 0] - np.maximum(scores[:, 1], scores[:, 2]) <= swing)
        if not len(free):
            return tags
        doc = np.searchsorted(first, free, "right")
        cut = np.flatnonzero((np.diff(free) > 1) | (np.diff(doc) > 0)) + 1
        bounds = np.concatenate(([0], cut, [len(free)]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at, to = int(free[a]), int(free[b - 1]) + 1
            if b - a == 1 and scores[at, 0] >= max(scores[at, 1], scores[at, 2]) + swing:
                continue
            d = int(doc[a])
            tags[at:to] = self._best(scores[at:to], at > first[d - 1], to < first[d])
        return tags

    def _best(self, scores: np.ndarray, before: bool, after: bool) -> list[int]:
        moves = self.moves.tolist()
        best = [s + (moves[0][k] if before else 0.0) for k, s in enumerate(scores[0].tolist())]
        trail = []
        for row in scores[1:].tolist():
            come = [max((best[j] + moves[j][k], -j) for j in range(3)) for k in range(3)]
            trail.append([-j for _, j in come])
            best = [c[0] + row[k] for k, c in enumerate(come)]
        if after:
            best = [b + moves[k][0] for k, b in enumerate(best)]
        at = max(range(3), key=lambda k: (best[k], -k))
        out = [at]
        for back in reversed(trail):
            at = back[at]
            out.append(at)
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@lru_cache(maxsize=1)
def trained(seed: int = 7) -> Field:
    """Maximum likelihood with a small L2 penalty, by Adam over the whole set."""
    texts, tags = _lines(np.random.default_rng(seed), TRAIN_LINES)
    column = pa.array(texts, pa.string())
    tokens = tokenize(*text_buffer(column), SPACED, hashes=False)
    rows, sizes = features(tokens, tokens.buffer.tobytes().lower())
    n, length = tags.shape
    params = [np.zeros((s, 3)) for s in sizes] + [np.zeros((3, 3))]
    gold = [np.zeros_like(p) for p in params]
    flat = tags.ravel()
    for k in range(len(sizes)):
        np.add.at(gold[k], (rows[:, k], flat), 1)
    np.add.at(gold[-1], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, TRAIN_STEPS + 1):
        field = Field(params[:-1], params[-1])
        score = field.scores(rows).reshape(n, length, 3)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            ahead[:, t] = _logsum(ahead[:, t - 1][:, :, None] + field.moves[None], 1) + score[:, t]
        for t in range(length - 2, -1, -1):
            behind[:, t] = _logsum(field.moves[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1], 1)
        own = np.exp(ahead + behind - total[:, None, None]).reshape(-1, 3)
        pair = np.exp(ahead[:, :-1, :, None] + field.moves[None, None] + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        for k, p in enumerate(params):
            if k < len(sizes):
                seen = np.stack([np.bincount(rows[:, k], own[:, s], len(p)) for s in range(3)], axis=1)
            else:
                seen = pair
            grad = (seen - gold[k]) / n + 0.002 * p
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            p -= 0.25 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(params[:-1], params[-1])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns; matches that are too short are dropped after matching."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]


_BLANK = "".join(filter(str.isspace, map(chr, range(0x3001))))
_LEAD, _TRAIL = _BLANK + "\"'([{<", _BLANK + "\"')]}>!#%$&*.,;:|"
_NAMED = re.compile(r"""^["']?[A-Za-z_-]{3,40}["']?[:=]["']?""")


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without quotes, brackets, marks and the name before its value; a part is never cut to nothing but at its end."""
    part = text[start:end].rstrip(_TRAIL)
    end = start + len(part)
    lead = lambda x: len(x) - len(x.lstrip(_LEAD))
    named = lambda x: m.end() if (m := _NAMED.match(x)) else 0
    for rule in (lead, named, lead):
        if (cut := rule(part)) < len(part):
            start += cut
            part = part[cut:]
    return start, end


def _scan(column: pa.Array, field: Field) -> list[list[dict]]:
    out: list[list[dict]] = []
    for a, b in batches(column, SLICE):
        part = column.slice(a, b - a)
        buffer, offsets = text_buffer(part)
        tokens = tokenize(buffer, offsets, SPACED, hashes=False)
        low = buffer.tobytes().lower()
        rows, _ = features(tokens, low)
        tags = field.decode(field.scores(rows), tokens.first)
        of = lambda at: np.searchsorted(offsets, at, "right") - 1
        raw = buffer.tobytes()
        marked = {*of(_positions(low, _ASSIGNED, offsets)).tolist(), *of(_positions(raw, [b"AKIA"], offsets)).tolist()}
        runs = np.insert(_HEXRUN[buffer], offsets, False)  # no run goes on into the next text
        change = np.flatnonzero(runs[1:] != runs[:-1]) + 1
        long = change[::2][change[1::2] - change[::2] >= 32]
        marked |= {*(np.searchsorted(offsets + np.arange(len(offsets)), long, "right") - 1).tolist()}
        begins = np.flatnonzero(tags > 0)
        found: dict[int, list[tuple[int, int]]] = {}
        doc, last = np.searchsorted(tokens.first, begins, "right") - 1, -2
        for t, d in zip(begins.tolist(), doc.tolist()):
            s, e = int(tokens.start[t] - offsets[d]), int(tokens.end[t] - offsets[d])
            if tags[t] == 2 and t == last + 1 and t > tokens.first[d]:
                found[d][-1] = found[d][-1][0], e
            else:
                found.setdefault(d, []).append((s, e))
            last = t
        results: list[list[dict]] = [[] for _ in range(b - a)]
        for d in sorted(marked | found.keys()):
            text = part[d].as_py()
            if text is None:
                continue
            spans = base_spans(text) if d in marked else []
            if d in found:
                # code points before each byte, and how far the base spans reach that begin before a place
                places = np.concatenate(([0], np.cumsum((buffer[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)))
                begin = sorted(x for _, x, _ in spans)
                reach = list(accumulate((y for _, _, y in sorted(spans, key=lambda x: x[1])), max))
                for s, e in found[d]:
                    start, end = _trim(text, int(places[s]), int(places[e]))
                    before = bisect_left(begin, end)
                    if end - start >= MIN_SECRET and (not before or reach[before - 1] <= start):
                        spans.append(("field", start, end))
            spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            results[d] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        out += results
    return out


def scan(docs: DataFrame, text: str = "text", result: str = "secrets") -> DataFrame:
    """docs with an array of spans (kind, start, end) by start, then kind as in KINDS."""
    bound_batches(docs.sparkSession)
    kept = keep_names(docs, [result])
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            spans = _scan(part.column(part.schema.get_field_index(text)), sent.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, _ARROW)], [*part.schema.names, result])
            del part, spans
            release()

    return source.mapInArrow(run, T.StructType([*source.schema, T.StructField(result, RESULT)]))


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every span of the text replaced; overlapping spans become one mark."""
    own, whole = inner("secrets", docs.columns), F.col(f"`{text}`")
    found = scan(docs, text, own)
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substr(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(F.col(f"`{own}`"), start, step, lambda acc: F.concat(acc["out"], F.substr(whole, acc["at"] + 1)))
    return found.withColumn(text, F.when(F.size(F.col(f"`{own}`")) > 0, done).otherwise(whole)).drop(own)


def stage(docs: DataFrame) -> DataFrame:
    """All documents, secrets replaced in the text and n_chars counted anew where there were any."""
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").contains("[secret]"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*quoted(docs.columns)) if "n_chars" in docs.columns else out.select(*quoted(docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "field")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
