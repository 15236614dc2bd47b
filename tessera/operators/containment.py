"""Names found in texts: all occurrences of many names and their variants, by one automaton a task.

A name answers to itself, to what stands before its comma, and to both in any case.  Names are cut into chunks by their length so that an automaton has at most AUTOMATON bytes of
patterns; each chunk is sent to the tasks and the texts are read once a chunk, so any number of names is matched in bounded memory.  The texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUTOMATON = 8 << 20


def name_variants(names: DataFrame, name: str) -> DataFrame:
    """(name, variant): lower-case forms by which a name is known."""
    n = F.col(name)
    forms = F.array(F.lower(n), F.lower(F.trim(F.substring_index(n, ",", 1))))
    return names.where(n.isNotNull()).select(n.alias("name"), F.explode(F.array_distinct(forms)).alias("variant")).where("trim(variant) <> ''").distinct()


def occurrences(texts: DataFrame, item: str, text: str, patterns: list[str]) -> DataFrame:
    """(item, variant, place, as_is): places, from 1, at which a pattern stands in a text whatever its case, between word ends."""
    import ahocorasick

    kind = texts.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for p in patterns:
            machine.add_word(p, p)
        machine.make_automaton()
        word = lambda s, i: 0 <= i < len(s) and (s[i].isalnum() or s[i] == "_")
        for batch in batches:
            items, found = [], ([], [])
            for k, raw in enumerate(batch.column(1).to_pylist()):
                low = (raw or "").lower()
                if len(low) != len(raw or ""):  # a letter that grows in lower case stands for itself
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in raw)
                for end, p in machine.iter(low):
                    start = end + 1 - len(p)
                    if not (word(low, start - 1) and word(low, start)) and not (word(low, end) and word(low, end + 1)):
                        items.append(k)
                        found[0].append(p)
                        found[1].append(start + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(items, pa.int64())), pa.array(found[0], pa.string()), pa.array(found[1], pa.int32())], ["item", "variant", "place"])

    return texts.select(F.col(item), F.col(text)).mapInArrow(run, f"item {kind}, variant string, place int")


def contained(texts: DataFrame, item: str, text: str, names: DataFrame, name: str, most: int = AUTOMATON) -> DataFrame:
    """(item, name, variant, place) of every name in every text."""
    known = name_variants(names, name)
    patterns = known.select("variant").distinct()
    size = patterns.agg(F.sum(F.octet_length("variant")).alias("n")).first()["n"] or 0
    chunks = max(1, -(-size // most))
    out = None
    for k in range(chunks):
        own = [r["variant"] for r in patterns.where(F.pmod(F.xxhash64("variant"), F.lit(chunks)) == k).collect()]  # about most bytes
        part = occurrences(texts, item, text, own) if own else None
        out = part if out is None else out.unionByName(part) if part is not None else out
    if out is None:
        out = occurrences(texts.where("false"), item, text, ["none"])
    return out.join(known, "variant").select("item", "name", "variant", "place")
