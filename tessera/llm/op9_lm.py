"""LM scoring by the likelihood of the lattice of subwords, beside an add-one unigram base.

The lattice of a word holds every segmentation into pieces of an installed vocabulary; a forward recursion in
log space sums them all, so a text's score is the log10 of its marginal probability, a word at a time and an
end piece.  The vocabulary is a BPE one and so scores pieces by rank; the weight of rank r is taken as
1 / (r + SHIFT), normalised over the pieces.  Single bytes are pieces too, so every text has a probability.
Pieces of every length take part, and the lengths tried are those of the vocabulary.  The recursion runs over
the distinct words of a batch at once, place by place; a word of more than LONG bytes (an address, a text without
spaces) goes alone, its pieces found as arrays SLAB places at a time, in steps in proportion to its length.  A worker
remembers the values of up to REMEMBERED words, which changes time and nothing else.

A learned score adds the words of the training texts as whole pieces, and the end, each with its share of the training
tokens; the generic pieces keep the share of tokens that occur once, which is the chance of a new word (Good and Turing).

Base: counts of all words of all documents, and of the training ones (all whose crc32 of the id modulo 7 is not 2), are
summed per batch, then in Spark.  Words above a level of the whole count that at most HEAD words reach go to the executors
with their training counts; all other words meet theirs in a join, summed per document and word before, where no key is
frequent, be it in training texts or in held-out ones.

Defined cases: a null or empty text has no words and is the end token alone; a null id is training; ids may
repeat, each row is scored and trained on; an empty table gives no rows; a word may be as long as a text; words are
64-bit hashes, of which two of 10**9 meet with a chance of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .words import BYTE_VALUES, LOWER, SPACED, Words, batches, prefix, span, text_buffer, tokenize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT, HEAD, FOLDS, HELD_OUT, _BITS = 10.0, 100_000, 7, 2, 20
LONG, SLAB, REMEMBERED = 96, 1 << 16, 1 << 19
_SPACE = "▁".encode()
_BATCH = 4 << 20


class Pieces:
    """Log-probabilities of pieces by the hash of their bytes."""

    def __init__(self, pieces: list[tuple[bytes, float]], byte_scores: np.ndarray, end: float):
        buffer = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        sizes = np.array([len(p) for p, _ in pieces])
        self.lengths = np.unique(sizes).tolist()
        ends = np.cumsum(sizes)
        keys = span(prefix(BYTE_VALUES[buffer]), ends - sizes, ends)
        order = np.argsort(keys)
        self.keys, self.scores, self.bytes, self.end = keys[order], np.array([s for _, s in pieces])[order], byte_scores, end
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _BITS)] = True
        self.known, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def marginals(self, tokens: Words, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        """words() of distinct words, given by hash and a place where each stands."""
        where = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        have = self.known[where] == keys if len(self.known) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys))
        out[have] = self.values[where[have]]
        new = np.flatnonzero(~have)
        size = tokens.end[first[new]] - tokens.start[first[new]]
        short, long = new[size <= LONG], new[size > LONG]
        out[short] = self.words(tokens, first[short])
        for i in long.tolist():
            word = LOWER[tokens.buffer[tokens.start[first[i]] : tokens.end[first[i]]]]
            out[i] = self.long_word(np.concatenate([np.frombuffer(_SPACE, np.uint8), word]))
        if len(new):
            both, values = (keys, out) if len(self.known) + len(new) > REMEMBERED else (np.concatenate([self.known, keys[new]]), np.concatenate([self.values, out[new]]))
            order = np.argsort(both, kind="stable")
            self.known, self.values = both[order], values[order]
        return out

    def long_word(self, data: np.ndarray) -> float:
        """Natural log of the marginal probability of the bytes, in plain numbers that are scaled up as they get small."""
        reach, single = self.lengths[-1], np.exp(self.bytes).tolist()
        weights, ahead, log = np.exp(self.scores), [0.0] * (reach - 1) + [1.0], 0.0  # ahead: sums at the last reach places
        for a in range(0, len(data), SLAB):
            b, low = min(len(data), a + SLAB), max(0, a - reach)
            sums = prefix(BYTE_VALUES[data[low:b]])
            ends, sizes, own = [], [], []
            for k in self.lengths:
                end = np.arange(max(a + 1, k), b + 1)
                key = span(sums, end - k - low, end - low)
                hit = np.flatnonzero(self.maybe[key >> np.uint64(64 - _BITS)])
                where = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
                same = self.keys[where] == key[hit]
                ends.append(end[hit[same]])
                sizes.append(np.full(int(same.sum()), k))
                own.append(weights[where[same]])
            end = np.concatenate(ends)
            order = np.argsort(end, kind="stable")
            cuts = np.searchsorted(end[order], np.arange(a + 1, b + 2)).tolist()
            sizes, own = np.concatenate(sizes)[order].tolist(), np.concatenate(own)[order].tolist()
            for d, byte in enumerate(data[a:b].tolist()):
                value = ahead[-1] * single[byte]
                for i in range(cuts[d], cuts[d + 1]):
                    value += ahead[-sizes[i]] * own[i]
                ahead.append(value)
                if value < 1e-30:
                    log += float(np.log(value))
                    ahead = [x / value for x in ahead[-reach:]]
            ahead = ahead[-reach:]
        return float(np.log(ahead[-1])) + log

    def words(self, tokens: Words, which: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each of the given words, a word mark before it."""
        start, size = tokens.start[which], tokens.end[which] - tokens.start[which]
        mark = np.frombuffer(_SPACE, np.uint8)
        length = size + len(mark)
        first = np.cumsum(length) - length
        buffer = np.empty(int(length.sum()), np.uint8)
        for i, m in enumerate(mark):
            buffer[first + i] = m
        at = np.arange(len(buffer)) - np.repeat(first, length)
        own = at >= len(mark)
        buffer[own] = LOWER[tokens.buffer[np.repeat(start - len(mark), length)[own] + at[own]]]
        sums = prefix(BYTE_VALUES[buffer])
        alpha = np.full(len(buffer) + len(which), -np.inf)
        slot = first + np.arange(len(which))
        alpha[slot] = 0.0
        order = np.argsort(-length, kind="stable")
        sorted_length = length[order]
        for d in range(1, int(length.max(initial=0)) + 1):
            live = order[: np.searchsorted(-sorted_length, -d, "right")]
            here, end = slot[live] + d, first[live] + d
            best = alpha[here - 1] + self.bytes[buffer[end - 1]]
            for k in self.lengths:
                if k > d:
                    break
                key = span(sums, end - k, end)
                hit = np.flatnonzero(self.maybe[key >> np.uint64(64 - _BITS)])
                where = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
                same = self.keys[where] == key[hit]
                hit, where = hit[same], where[same]
                best[hit] = np.logaddexp(best[hit], alpha[here[hit] - k] + self.scores[where])
            alpha[here] = best
        return alpha[slot + length]


@lru_cache(maxsize=2)
def pieces(path: str = VOCABULARY) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    weights = 1.0 / (np.arange(n) + 1 + SHIFT)
    logs = np.log(weights / weights.sum())
    found, single = [], np.full(256, logs[-1])
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            single[int(name[3:5], 16)] = logs[i]
        elif not model.is_control(i) and not model.is_unknown(i) and name:
            found.append((name.encode(), float(logs[i])))
    return Pieces(found, single, float(logs[model.eos_id()]))


def _counts(column: pa.Array, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts, their counts in all, and in those that are kept."""
    found = [[np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0)]]
    for a, b in batches(column, _BATCH):
        tokens = tokenize(*text_buffer(column.slice(a, b - a)), SPACED, LOWER)
        k, at = np.unique(tokens.hash, return_inverse=True)
        own = np.repeat(keep[a:b], np.diff(tokens.first))
        for x, y in zip(found, (k, np.bincount(at, minlength=len(k)), np.bincount(at, own, len(k)))):
            x.append(y)
    keys, total, kept = (np.concatenate(x) for x in found)
    if len(found[0]) == 2:
        return keys, total, kept
    k, at = np.unique(keys, return_inverse=True)
    return k, np.bincount(at, total, len(k)), np.bincount(at, kept, len(k))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, seen) of rows (text, held_out): the count in texts that are not held out, and in all."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            k, seen, c = _counts(part.column(0), ~np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(seen.astype(np.int64))], ["word", "c", "seen"])

    sent = rows.select("text", "held_out").mapInArrow(run, "word long, c long, seen long")
    return sent.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Words seen at the least level that HEAD words at most reach, with their training counts, and the level."""
    octave = F.floor(F.log2("seen") * 8).cast("int")
    levels = counts.groupBy(octave.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("most")).orderBy(F.desc("k")).collect()
    total, level = 0, None
    for i, row in enumerate(levels):
        total += row["n"]
        if total > HEAD:
            break
        level = (levels[i + 1]["most"] if i + 1 < len(levels) else 0) + 1
    if level is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 1 << 62
    found = counts.where(F.col("seen") >= level).select("word", "c").toPandas()  # HEAD rows at most
    words = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], found["c"].to_numpy(np.int64)[order], level


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, learned: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned: with the words of training texts as pieces."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    held = F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(f"`{text}`").alias("text"), held.alias("held_out"), F.col(f"`{doc_id}`").alias("doc_id"))
    counts = scratch.write(word_counts(rows), "counts")
    ends = rows.where("not held_out").count()
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    tokens, distinct = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    generic = (total["once"] + 1) / (tokens + 2) if learned else 1.0
    own_share = (1 - generic) / max(1, tokens)
    head_words, head_counts, level = _head(counts)
    sent = spark.sparkContext.broadcast((pieces(vocabulary), head_words, head_counts))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, words, numbers = sent.value
        logs = np.log10(numbers + 1.0)
        with np.errstate(divide="ignore"):
            shares = np.log(own_share * numbers)
            end = np.logaddexp(np.log(generic) + lattice.end, np.log(own_share * ends)) / np.log(10)
        for part in parts:
            out = [[] for _ in range(5)]
            for a, b in batches(part.column(0), _BATCH):
                own = tokenize(*text_buffer(part.column(0).slice(a, b - a)), SPACED, LOWER)
                keys, first, back = np.unique(own.hash, return_index=True, return_inverse=True)
                marginal = np.log(generic) + lattice.marginals(own, keys, first)
                where = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
                head = words[where] == keys if len(words) else np.zeros(len(keys), bool)
                value = np.where(head, logs[where], 0.0) if len(words) else np.zeros(len(keys))
                known = head & (numbers[where] > 0) if len(words) else head
                whole = (np.logaddexp(marginal, np.where(head, shares[where], -np.inf)) if len(words) else marginal)[back] / np.log(10)
                doc, n = own.doc(), b - a
                rest = np.flatnonzero(~head[back])
                pairs = np.stack([doc[rest], back[rest]])
                pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
                new = np.flatnonzero(np.concatenate(([True], (np.diff(pairs, axis=1) != 0).any(axis=0)))) if len(rest) else rest
                entry = pa.StructArray.from_arrays([pa.array(keys[pairs[1, new]].view(np.int64)), pa.array(np.diff(np.append(new, len(rest))).astype(np.int64)), pa.array(marginal[pairs[1, new]] / np.log(10))], ["word", "k", "m"])
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(pairs[0, new], minlength=n)))).astype(np.int32)), entry)
                for k, x in enumerate((pa.array(np.diff(own.first)), pa.array(np.bincount(doc, known[back], n).astype(np.int64)), pa.array(np.bincount(doc, value[back], n)), pa.array(np.bincount(doc, whole, n) + end), tail)):
                    out[k].append(x)
            if len(part):
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *[pa.concat_arrays(x) for x in out]], ["held_out", "doc_id", "n_words", "head_known", "head_log", "score", "tail"])

    schema = T.StructType([rows.schema["held_out"], rows.schema["doc_id"], *T._parse_datatype_string("n_words long, head_known long, head_log double, score double, tail array<struct<word:long,k:long,m:double>>")])
    scored = scratch.write(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    scratch.free()
    rare = counts.where((F.col("seen") < F.lit(level)) & (F.col("c") > 0)).select("word", "c")
    tails = scored.select("row", F.inline("tail")).join(rare, "word")
    gain = F.when(F.col("c") * F.lit(own_share) > 0, F.log10(F.pow(F.lit(10.0), "m") + F.col("c") * F.lit(own_share)) - F.col("m")).otherwise(0.0)
    tails = tails.groupBy("row").agg(F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("tail_log"), F.sum(F.col("k") * gain).alias("tail_gain"))
    n = F.col("n_words") + 1
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(ends > 0)
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + float(np.log10(ends + 1.0)) - n * float(np.log10(tokens + distinct + 1.0))
    out = scored.drop("tail").join(tails, "row", "left")
    return out.select("doc_id", "held_out", n.alias("n_tokens"), known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), log.alias("base_score"), (F.col("score") + F.coalesce("tail_gain", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), learned=True)
