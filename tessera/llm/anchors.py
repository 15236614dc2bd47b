"""Anchors: the least hash of the short grams in a window, the same wherever the window stands."""

from __future__ import annotations

import numpy as np


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    done = 1
    while 2 * done <= w:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[w - done : w - done + n])


def take_runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all runs, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def smallest(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id among the rows of its key."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), ids.dtype)
    if len(keys):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], new), np.diff(np.append(new, len(keys))))
    return out


def shared(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which rows have a key that occurs with two ids or more."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, sorted_ids = keys[order], ids[order]
    out = np.zeros(len(keys), bool)
    if len(keys):
        new = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
        many = np.minimum.reduceat(sorted_ids, new) != np.maximum.reduceat(sorted_ids, new)
        out[order] = np.repeat(many, np.diff(np.append(new, len(keys))))
    return out


def hot_anchors(keyed, runs, sample: int = 40_000, documents: int = 5_000, least: int = 20, most: int = 1 << 20) -> np.ndarray:
    """Anchors of many documents, found on a sample and used for routing alone: windows with one of them are dealt by
    their own hash, so that what stands around a passage of very many documents doesn't meet in one part.

    keyed: documents (id, text_key, text); runs(texts) gives the anchor of each run and its text's number.  About
    sample documents are drawn (one of 2,000 if that is more); frequent is what stands, by the sample, in so
    many documents, and in least of the sample; of these the most frequent, as many as most.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    total = keyed.count()
    step = max(1, total // max(sample, total // 2000))
    least = max(least, documents // step)
    drawn = keyed.where(F.pmod(F.xxhash64("id", "text_key"), F.lit(step)) == 0).select("text")

    def count(parts):
        from .words import batches

        for part in parts:
            for a, b in batches(part.column(0)):
                anchor, doc = runs(part.column(0).slice(a, b - a))
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                once = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) if len(anchor) else np.zeros(0, bool)
                keys, counts = np.unique(anchor[once], return_counts=True)
                many = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], ["anchor", "n"])

    found = drawn.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(most).select("anchor").toPandas()
    return np.sort(found["anchor"].to_numpy(np.int64).view(np.uint64))


def among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys
