"""License scans by a positional rare-token index, built-in functions only.

Templates (licence texts) are indexed by their RARE words of highest IDF over the corpus: word -> (template, position).  A file's words
that the index holds are looked up with their places; each meeting of a file's place p with a template's place q votes for the relative position
p - q.  Lanes of 2 * SLACK relative positions, each half over the next, stand for small edits: where the rare words of a lane carry at least
LEAST of the template's weight (IDF, each word once), the template's mandatory key phrases are looked for in the words
around their places in that lane, and the label counts if all are there.  Phrases that must stand whole are templates whose lane has
one relative position and whose key phrase is all of it: the places of their rarest word are intersected with all other words
by relative position, so every place is found.

Texts never move: the only shuffle is of counts of the template words (some hundred rows), which the driver holds to choose the rare ones.  Work in a file
is linear in its words and, where licence words stand, n log n in their number.  The text is read twice, once for the counts.

Defined cases: a null text has no words; a text without licence words has no labels and the score 0; rows of one id, or without one, are files each; other
columns stay, an input column named like a result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import inner, keep_names

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, SLACK, LEAST = 8, 8, 0.6
#: (label, phrase) that count wherever they stand whole.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: (label, text, mandatory key phrases): opening or characteristic words of the licences.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2", "except in compliance with the license"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "either version 3"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "either version 2"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["unencumbered software released into the public domain"]),
]


def split(text: str) -> list[str]:
    """Words of a template, as words() of a text."""
    return re.findall(WORD, text.translate({i: i + 32 for i in range(65, 91)}))


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, float]:
    """IDF over all rows of docs of the words of a vocabulary, which the driver holds anyway."""
    held = docs.select(F.array_intersect(words(F.col(f"`{text}`")), F.lit(sorted(vocabulary))).alias("w"))
    total = F.lit("")  # no word is empty: its row counts the files
    counted = held.select(F.explode(F.concat("w", F.array(total))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    df = {r["w"]: r["n"] for r in counted.collect()}  # at most a row per word of the vocabulary
    n = df.get("", 0)
    return {w: log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}


def rare_words(tokens: list[str], idf: dict[str, float], most: int = RARE) -> list[str]:
    """A template's words of highest IDF, ties by word."""
    return sorted(set(tokens), key=lambda w: (-round(idf[w], 9), w))[:most]


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _whole(label: str, tokens: list[str], idf: dict[str, float], text: Column, at: Column) -> Column:
    """Starts of a phrase: places of its rarest word at which all others stand in their relative positions."""
    rarest = rare_words(tokens, idf, 1)[0]
    q = tokens.index(rarest)
    stands = lambda x: reduce(lambda a, b: a & b, [F.get(text, x["p"] + (j - q)) == w for j, w in enumerate(tokens)])
    hits = F.filter(at, lambda x: (x["w"] == rarest) & F.coalesce(stands(x), F.lit(False)))
    return F.transform(hits, lambda x: F.struct(F.lit(label).alias("label"), (x["p"] - q).alias("start"), F.lit(len(tokens)).alias("length")))


def _votes(at: Column, word: str, k: int, q: int) -> Column:
    """Both lanes of the relative position of each place of a word, for one of its places in the template."""
    lane = lambda x, back: F.struct((F.floor((x["p"] - q) / SLACK) - back).cast("int").alias("lane"), F.lit(k).alias("k"))
    return F.flatten(F.transform(F.filter(at, lambda x: x["w"] == word), lambda x: F.array(lane(x, 0), lane(x, 1))))


def _found(label: str, lanes: Column) -> Column:
    kind = "array<struct<score:double,lane:int>>"
    named = lambda x: F.struct(F.lit(label).alias("label"), F.greatest(x["lane"] * SLACK, F.lit(0)).alias("start"), x["score"].alias("score"))
    return F.transform(F.coalesce(lanes, F.expr(f"cast(array() as {kind})")), named)


def _lanes(tokens: list[str], idf: dict[str, float], at: Column, least: float) -> tuple[Column, Column]:
    """Whether a file holds enough of a template's rare words at all; its lanes that pass, as (score, lane)."""
    rare = rare_words(tokens, idf)
    weights = [idf[w] for w in rare]
    whole = sum(weights)
    held = F.array_distinct(F.transform(F.filter(at, lambda x: x["w"].isin(rare)), lambda x: x["w"]))
    share = _total([F.when(F.array_contains(held, w), F.lit(v)).otherwise(F.lit(0.0)) for w, v in zip(rare, weights)]) / whole
    postings = [(k, q) for k, w in enumerate(rare) for q, t in enumerate(tokens) if t == w]
    votes = [_votes(at, rare[k], k, q) for k, q in postings]
    ordered = F.array_sort(F.array_distinct(F.concat(*votes)))
    weight = lambda k: F.get(F.lit(weights), k)
    lane_kind = "array<struct<score:double,lane:int>>"
    closed = lambda acc: F.when(acc["w"] / whole >= least, F.concat(acc["done"], F.array(F.struct((acc["w"] / whole).alias("score"), acc["lane"].alias("lane"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        same = acc["lane"] == x["lane"]
        total = F.when(same, acc["w"]).otherwise(F.lit(0.0)) + weight(x["k"])
        return F.struct(x["lane"].alias("lane"), total.alias("w"), F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"))

    start = F.struct(F.lit(-(1 << 31)).cast("int").alias("lane"), F.lit(0.0).alias("w"), F.expr(f"cast(array() as {lane_kind})").alias("done"))
    return F.coalesce(share >= least, F.lit(False)), F.aggregate(ordered, start, step, closed)


def _verified(tokens: list[str], keys: list[list[str]], text: Column, lanes: Column) -> Column:
    """The lanes in which each key phrase stands within SLACK words of its place."""
    def stands(lane: Column, key: list[str]) -> Column:
        k = next(q for q in range(len(tokens)) if tokens[q : q + len(key)] == key)
        a = lane * SLACK + (k - SLACK)
        room = F.lit(4 * SLACK + len(key)) + F.least(a, F.lit(0))
        window = F.slice(text, F.greatest(a, F.lit(0)) + 1, F.greatest(room, F.lit(0)))
        return F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" ")).contains(f" {' '.join(key)} ")

    return F.filter(lanes, lambda x: reduce(lambda a, b: a & b, [stands(x["lane"], key) for key in keys]))


def scan(docs: DataFrame, text: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str, list[str]]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """docs with n_words, places (label, start, length of whole phrases), found (label, start, score of templates), base_labels, labels (arrays), score."""
    kept = keep_names(docs, ["n_words", "places", "found", "base_labels", "labels", "score"])
    whole = [(label, split(p)) for label, p in phrases]
    texts = [(label, split(t), [split(k) for k in keys]) for label, t, keys in templates]
    idf = rarity(docs, text, sorted({w for _, t in whole for w in t} | {w for _, t, _ in texts for w in t}))
    index = sorted({rare_words(t, idf, 1)[0] for _, t in whole} | {w for _, t, _ in texts for w in rare_words(t, idf)})
    w, a, lanes = inner("words", docs.columns), inner("at", docs.columns), [inner(f"lanes{k}", docs.columns) for k in range(len(texts))]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], words(F.col(f"`{text}`")).alias(w))
    looked = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(index), F.struct(x.alias("w"), i.alias("p")))))
    out = out.withColumn(a, looked)
    kind = "array<struct<label:string,start:int,length:int>>"
    starts = F.concat(*[_whole(label, t, idf, F.col(w), F.col(a)) for label, t in whole]).cast(kind) if whole else F.expr(f"cast(array() as {kind})")
    for name, (_, t, keys) in zip(lanes, texts):
        near, passing = _lanes(t, idf, F.col(a), least)
        out = out.withColumn(name, F.when(near, _verified(t, keys, F.col(w), passing)))
    kind = "array<struct<label:string,start:int,score:double>>"
    label_lanes = [_found(label, F.col(f"`{name}`")) for name, (label, _, _) in zip(lanes, texts)]
    out = out.select(*[F.col(f"`{c}`") for c in kept], F.size(w).cast("long").alias("n_words"), starts.alias("places"), (F.concat(*label_lanes) if texts else F.expr(f"cast(array() as {kind})")).alias("found"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(base, F.transform("found", lambda x: x["label"])))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))))  # shares of a sum may pass 1 by rounding
    return out.withColumns({"base_labels": base, "labels": labels, "score": score})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    starts = F.transform("places", lambda x: x["start"].cast("long"))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


_TEXTS = [split(t) for _, t, _ in TEMPLATES]
_KEYS = [(t, k, split(key)) for t, (_, _, keys) in enumerate(TEMPLATES) for k, key in enumerate(keys)]
_KEY_AT = [(t, k, next(q for q in range(len(_TEXTS[t])) if _TEXTS[t][q : q + len(key)] == key), len(key)) for t, k, key in _KEYS]
#: DuckDB SQL of query(): words, postings and phrases as rows, joined.
ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
tok as (select doc_id, unnest(ws) w, unnest(range(len(ws))) p from d),
tpl(t, q, w) as (values {_values([(t, q, w) for t, ws in enumerate(_TEXTS) for q, w in enumerate(ws)])}),
lab(t, label, n_keys) as (values {_values([(t, x[0], len(x[2])) for t, x in enumerate(TEMPLATES)])}),
keys(t, k, kat, size, j, w) as (values {_values([(t, k, at, n, j, w) for (t, k, at, n), (_, _, key) in zip(_KEY_AT, _KEYS) for j, w in enumerate(key)])}),
ph(f, label, size, j, w) as (values {_values([(f, label, len(split(x)), j, w) for f, (label, x) in enumerate(PHRASES) for j, w in enumerate(split(x))])}),
bp as (select doc_id, f, any_value(label) label, p - j s from tok join ph using (w) group by doc_id, f, p - j having count(*) = any_value(size)),
b as (select doc_id, count(*) n_base, min(s) first_word, max(s) last_word, array_to_string(list_sort(list(distinct label)), ',') base_labels, list(distinct label) bl from bp group by 1),
df as (select w, count(distinct doc_id) n from tok where w in (select w from tpl union select w from ph) group by 1),
idf as (select w, ln((1 + (select count(*) from d))::double / (1 + coalesce(n, 0))) + 1 v from (select distinct w from tpl) left join df using (w)),
rare as (select t, w, v, sum(v) over (partition by t) total from (select t, w, v, row_number() over (partition by t order by round(v, 9) desc, w) r from (select distinct t, w from tpl) join idf using (w)) where r <= {RARE}),
votes as (select distinct doc_id, t, floor((p - q) / {SLACK}.0)::int - back lane, w, v, total from tok join rare using (w) join tpl using (t, w), (values (0), (1)) x(back)),
lanes as (select doc_id, t, lane, sum(v) / any_value(total) score from votes group by 1, 2, 3 having sum(v) / any_value(total) >= {LEAST}),
occ as (select doc_id, t, k, any_value(kat) kat, p - j s from tok join keys using (w) group by doc_id, t, k, p - j having count(*) = any_value(size)),
ok as (select l.doc_id, l.t, l.lane, any_value(l.score) score from lanes l join lab using (t) join occ o on o.doc_id = l.doc_id and o.t = l.t and o.s >= l.lane * {SLACK} + o.kat - {SLACK} and o.s <= l.lane * {SLACK} + o.kat + {3 * SLACK}
 group by 1, 2, 3 having count(distinct k) = any_value(n_keys)),
m as (select doc_id, list(distinct label) ml, max(score) score from ok join lab using (t) group by 1)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') labels, case when n_base > 0 then 1.0::double else round(coalesce(score, 0.0)::double, 6) end score
from d left join b using (doc_id) left join m using (doc_id)
"""
