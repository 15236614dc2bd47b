"""N-gram Jaccard join: PartEnum signatures, then exact verification, then components.

Documents with one sequence of words are one class from the start (a 64-bit hash of it by place, the node of the graph;
where a second hash shows that one node stands for two sequences, these get nodes of both hashes).
Each slice of documents signs its classes (partenum.py).  Signatures are dealt by hash to parts; what two classes
of one slice share is settled there, so a signature of very many documents reaches its part once a slice.

Candidates are verified in rounds, because the pairs of a large group of near copies are too many to list:
first each member of a signature against the least one; classes that this links are joined.  Then, at most STARS - 1 times
and as long as the pairs across components in signatures of more than WIDE members are more than ACROSS for each member of any
signature, in these those outside their largest component against one of it drawn by hash; other signatures wait for the last
step with the components of the first, as all their pairs are at most WIDE / 2 for each member.  Last, in signatures that have several components still, all pairs across these.  The one that the others were compared
with leaves its signature, as none of its pairs is open, and so do signatures in one component; a round reads only
what is open.  Such pairs are
compared first by parity sketches: bit j says whether the set has an odd number of features that hash to j, so
the number of differing bits never exceeds the number of differing features, and no linked pair
is lost.  Only pairs that pass are listed, and are verified on the sets themselves.  Signatures with more than
CHUNK members are worked through in pairs of chunks.  A set that many others are verified against is sent once for each
MEMBERS of them.

Defined cases: a null or wordless text has an empty set and links with nothing; fewer words than a shingle are one
shingle; the component's name is the least id, rows of one id are in the component of each of
their texts and, without an id, in one named by the others; an empty table gives no rows.  In stage(), of rows with
one id the one of least hash over all columns stays, and rows without an id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import among, shared
from .components import components
from .partenum import Threshold, shingle_sets, signatures
from .scratch import Scratch, inner, quoted
from .words import LOWER, SPACED, batches, mix, release, sequences, text_buffer, tokenize

SLICE, PART_BYTES, CHUNK, MEMBERS, STARS, ACROSS, WIDE = 2 << 20, 8 << 20, 1024, 256, 4, 4, 64
#: Rows of ids or nodes that go to all executors, some 64 MB there; more are joined.
SENT = 1 << 20
#: Of n sequences about n * n / 2**65 pairs share a 64-bit hash, 3 of 10**10 and 270,000 of 3 * 10**12; more than this are not looked for.
MOST_SPLIT = 1 << 20


def _sets(column: pa.Array, n: int, split: np.ndarray):
    """Sets, first index of each, node and second hash of each text; split: sorted nodes that stand for several sequences."""
    words = tokenize(*text_buffer(column), SPACED, LOWER)
    sets, first, node = shingle_sets(words, n)
    check = sequences(words.hash, words.first, 1)
    return sets, first, np.where(among(node, split), mix(node ^ check), node), check


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set: about two to four a feature, a power of two."""
    return max(64, min(1 << 16, 2 << max(0, int(size - 1)).bit_length()))


def sketch(own: np.ndarray) -> bytes:
    bits = sketch_bits(len(own))
    odd = np.bincount((own >> np.uint64(44)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits: places count modulo a power of two, so halves are added."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def may_link(a: bytes, b: bytes, na: int, nb: int, at: Threshold) -> bool:
    """False only if the sets differ in more features than linked sets of these sizes can."""
    if min(na, nb) * at.den < max(na, nb) * at.num:
        return False
    size = min(len(a), len(b))
    x, y = (_fold(np.frombuffer(v, np.uint8), size) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum()) * (at.den + at.num) <= (na + nb) * (at.den - at.num)


def describe(docs: DataFrame, n: int, split: np.ndarray) -> DataFrame:
    """(id, text_key, n_shingles, node, second hash, sketch) of documents (id, text_key, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(2), SLICE):
                sets, first, node, check = _sets(part.column(2).slice(a, b - a), n, split)
                bits = [sketch(sets[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), pa.array(np.diff(first)), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(bits, pa.binary())], ["id", "text_key", "n_shingles", "node", "check", "sketch"])
            release()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text_key", "text").mapInArrow(run, f"id {kind}, text_key long, n_shingles long, node long, check long, sketch binary")


def shared_signatures(docs: DataFrame, n: int, at: Threshold, parts: int, split: np.ndarray) -> DataFrame:
    """(sig, node) for every signature of two nodes or more."""

    def send(batch_list: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("known", pa.binary())])
        for batch in batch_list:
            for a, b in batches(batch.column(0), SLICE):
                sets, first, node, _ = _sets(batch.column(0).slice(a, b - a), n, split)
                _, once = np.unique(node, return_index=True)
                once = once[np.diff(first)[once] > 0]
                if not len(once):
                    continue
                own = np.concatenate([sets[first[i] : first[i + 1]] for i in once.tolist()])
                sigs, at_sig = signatures(own, np.concatenate(([0], np.cumsum(np.diff(first)[once]))), at)
                nodes = np.repeat(node[once].view(np.int64), np.diff(at_sig))
                part = (sigs % np.uint64(parts)).astype(np.int32)
                low = (sigs >> np.uint64(32)).astype(np.uint32)
                code = (part.astype(np.uint64) << np.uint64(32)) | low
                order = np.argsort(code, kind="stable")
                code, nodes, low, part = code[order], nodes[order], low[order], part[order]
                same = shared(code, nodes)
                lone = ~same
                lone[np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))] = True
                lows, their, at_part = low[lone], nodes[lone], part[lone]
                edges = np.concatenate(([0], np.flatnonzero(at_part[1:] != at_part[:-1]) + 1, [len(at_part)])) if len(at_part) else [0]
                rows = [{"part": int(at_part[x]), "blob": lows[x:y].tobytes() + their[x:y].tobytes()} for x, y in zip(edges[:-1], edges[1:])]
                if same.any():
                    rows.append({"part": -1 - int(node[once[0]] % np.uint64(parts)), "known": code[same].tobytes() + nodes[same].tobytes()})
                yield pa.RecordBatch.from_pylist(rows, kinds)
            release()

    def meet(table: pa.Table) -> pa.Table:
        sig, node = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for x in table["known"].to_pylist():
            if x is not None:
                half = len(x) // 2
                sig.append(np.frombuffer(x[:half], np.uint64))
                node.append(np.frombuffer(x[half:], np.int64))
        blobs = [x for x in table["blob"].to_pylist() if x is not None]
        if blobs:
            low = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12) for x in blobs])
            own = np.concatenate([np.frombuffer(x, np.int64, len(x) // 12, len(x) // 3) for x in blobs])
            many = shared(low, own)
            sig.append(low[many].astype(np.uint64) | np.uint64(table["part"][0].as_py() << 32))
            node.append(own[many])
        release()
        return pa.table({"sig": pa.array(np.concatenate(sig).view(np.int64)), "node": pa.array(np.concatenate(node))})

    sent = docs.select("text").mapInArrow(send, "part int, blob binary, known binary")
    return sent.groupBy("part").applyInArrow(meet, "sig long, node long")


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked to go to all executors if it has SENT rows at most."""
    return F.broadcast(df) if df.count() <= SENT else df


def _pass_sketch(pairs: DataFrame, nodes: DataFrame, at: Threshold) -> DataFrame:
    """Pairs (a, b) that their sketches let pass."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * at.den >= F.greatest("na", "nb") * at.num)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b, na, nb, sa, sb = (part.column(c).to_pylist() for c in ("a", "b", "na", "nb", "sa", "sb"))
            ok = [may_link(x, y, p, q, at) for x, y, p, q in zip(sa, sb, na, nb)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(a, ok) if k], pa.int64()), pa.array([x for x, k in zip(b, ok) if k], pa.int64())], ["a", "b"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, at: Threshold, split: np.ndarray, scratch: Scratch, name: str) -> DataFrame:
    """Pairs whose sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.write(wanted.join(nodes.select("node", "id", "text_key"), "node").select(F.col("id").alias("i"), F.col("text_key").alias("k")), f"wanted{name}")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a, b in batches(part.column(0), SLICE):
                values, first, node, _ = _sets(part.column(0).slice(a, b - a), n, split)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array([values[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())], ["node", "own"])

    held = docs.join(_few(wanted), (F.col("text_key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi").select("text").mapInArrow(sets, "node long, own binary")
    held = scratch.write(held.groupBy("node").agg(F.first("own").alias("own")), f"sets{name}")
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("groups"))
    members = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"), "b")
    members = members.join(held.withColumnRenamed("node", "b"), "b").select("a", "group", "b", "own")
    centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).join(held.withColumnRenamed("node", "a"), "a").select("a", "group", F.lit(None).cast("long").alias("b"), "own")
    total = pairs.join(nodes.select(F.col("node").alias("b"), "n_shingles"), "b").agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(16, int(total) * 12 // PART_BYTES)

    def compare(table: pa.Table) -> pa.Table:
        table = table.select(["a", "group", "b", "own"]).sort_by([("a", "ascending"), ("group", "ascending")]).combine_chunks()
        a, group, b = table["a"].to_numpy(), table["group"].to_numpy(), table["b"]
        centre = np.asarray(b.is_null())
        b = b.fill_null(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(a) != 0) | (np.diff(group) != 0)) + 1, [len(a)])).tolist()
        own, out = table["own"].combine_chunks(), [np.zeros((2, 0), np.int64)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            of = x + int(np.flatnonzero(centre[x:y])[0])
            rows = np.flatnonzero(~centre[x:y]) + x
            base = np.frombuffer(own[of].as_py(), np.uint64)
            theirs = [np.frombuffer(own[i].as_py(), np.uint64) for i in rows.tolist()]
            size = np.array([len(z) for z in theirs])
            values = np.concatenate(theirs)
            same = base[np.minimum(np.searchsorted(base, values), len(base) - 1)] == values
            both = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64)
            ok = both * at.den >= at.num * (len(base) + size - both)
            out.append(np.stack([a[rows[ok]], b[rows[ok]]]))
        del table, own
        release()
        found = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    dealt = members.unionByName(centres).withColumn("bucket", F.pmod(F.xxhash64("a", "group"), F.lit(buckets)).cast("int"))
    out = scratch.write(dealt.groupBy("bucket").applyInArrow(compare, "a long, b long"), f"links{name}")
    scratch.drop(f"sets{name}", f"wanted{name}")
    return out


def _open_pairs(members: DataFrame) -> float:
    """Pairs within a signature but across components; members: sig, node, root."""
    own = members.groupBy("sig", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sizes = own.groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
    return (sizes.agg(F.sum(F.col("n") * F.col("n") - F.col("within"))).first()[0] or 0.0) / 2


def _central(members: DataFrame, turn: int) -> DataFrame:
    """(sig, p, n): of each signature in several components a member of its largest, drawn by hash, and all its members; members: sig, node, root."""
    drawn = F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)), "node"))
    own = members.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"), drawn.alias("node"))
    sizes = own.groupBy("sig").agg(F.max_by(F.struct("node", "root"), F.struct("n", "root")).alias("p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("several"))
    return sizes.where("several > 1").select("sig", "p", "n")


def _across(members: DataFrame, nodes: DataFrame, at: Threshold, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) within a signature but across components that their sketches let pass; members: sig, node, root."""
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    open_ = members.join(sizes.select("sig", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "sig")
    open_ = open_.join(nodes.select("node", "n_shingles", "sketch"), "node")
    open_ = open_.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    open_ = open_.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    total = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / CHUNK))).first()[0] or 0
    open_ = open_.withColumn("bucket", F.pmod(F.xxhash64("sig", "low", "high"), F.lit(max(16, int(total) // 16384))).cast("int"))

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("sig", "ascending"), ("low", "ascending"), ("high", "ascending")])
        keys = np.stack([table[c].to_numpy() for c in ("sig", "low", "high")], axis=1)
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)])).tolist()
        node, root, n, chunk = (table[c].to_numpy() for c in ("node", "root", "n_shingles", "chunk"))
        bits, out = table["sketch"].to_pylist(), [np.zeros((2, 0), np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            size = min(len(x) for x in bits[a:b])
            rows = np.stack([_fold(np.frombuffer(x, np.uint8), size) for x in bits[a:b]]).view(np.uint64)
            own, mine, count, part = node[a:b], root[a:b], n[a:b], chunk[a:b]
            apart = keys[a, 1] != keys[a, 2]
            for i in range(b - a - 1):
                rest = slice(i + 1, b - a)
                live = (mine[rest] != mine[i]) & (np.minimum(count[rest], count[i]) * at.den >= np.maximum(count[rest], count[i]) * at.num)
                if apart:
                    live &= part[rest] != part[i]
                j = np.flatnonzero(live) + i + 1
                if len(j):
                    differ = np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1, dtype=np.int64)
                    j = j[differ * (at.den + at.num) <= (count[j] + count[i]) * (at.den - at.num)]
                    out.append(np.stack([np.minimum(own[j], own[i]), np.maximum(own[j], own[i])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        del table, bits, out
        release()
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    columns = open_.select("bucket", "sig", "low", "high", "chunk", "node", "root", "n_shingles", "sketch")
    return columns.groupBy("bucket").applyInArrow(work, "a long, b long").distinct()


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id of links with Jaccard similarity of num / den or more."""
    at, scratch = Threshold(num, den), Scratch(docs.sparkSession)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))
    split = np.zeros(0, np.uint64)
    for _ in range(2):  # a second time only if a node stands for several sequences
        described = scratch.write(describe(keyed, shingle, split), "documents")
        some = described.where("n_shingles > 0").groupBy("node").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("r"),
            F.min("id").alias("least"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
            (F.min("check") != F.max("check")).alias("several"),
        )
        nodes = scratch.write(some.select("node", "r.id", "r.text_key", "least", "n_shingles", "sketch", "several"), "nodes")
        found = nodes.where("several").select("node").limit(MOST_SPLIT).toPandas()["node"].to_numpy(np.int64)
        if not len(found):
            break
        split = np.sort(found.view(np.uint64))
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    per_feature = 12 * 3 * 2.4 * (den - num) / (den + num)
    parts = max(16, int(total * per_feature / PART_BYTES) + 1)
    members = scratch.write(shared_signatures(keyed, shingle, at, parts, split).distinct(), "members")
    most = ACROSS * members.count()
    signed = scratch.write(nodes.join(_few(scratch.write(members.select("node").distinct(), "in")), "node", "left_semi"), "signed")
    roots = members.withColumn("root", F.col("node"))
    for turn in range(STARS):
        least = F.min(F.struct("node", "root")).alias("p")
        met = roots.join(_central(roots, turn) if turn else roots.groupBy("sig").agg(least, F.count(F.lit(1)).alias("n")), "sig")
        stars = met.where("root <> p.root").select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
        passed = scratch.write(_pass_sketch(stars, signed, at), f"star{turn}")
        if not turn:
            first = passed
        links = _verify(passed, signed, keyed, shingle, at, split, scratch, f"{turn}")
        joined = components(joined.unionByName(links) if turn else links, scratch)
        rest = met.where("n > 2 and node <> p.node").select("sig", "node", "n").join(joined.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
        left = scratch.write(rest.withColumn("root", F.coalesce("root", "node")), f"roots{turn}")
        if not turn:
            narrow = left.where(F.col("n") <= WIDE).drop("n")
        roots = left.where(F.col("n") > (0 if turn else WIDE)).drop("n")
        scratch.drop("members", *([f"roots{turn - 1}"] if turn > 1 else []))
        if _open_pairs(roots) <= most:
            break
    second = _across(narrow.unionByName(roots), signed, at, scratch).join(first, ["a", "b"], "left_anti")
    second = scratch.write(second, "second")
    scratch.drop(*(f"roots{turn}" for turn in range(STARS)))
    if second.limit(1).count():
        more = _verify(second, signed, keyed, shingle, at, split, scratch, "last")
        joined = components(joined.unionByName(more), scratch)
    named = nodes.join(joined.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = scratch.write(named.join(names, "root").select("node", "component_id"), "names")
    scratch.free()
    full = described.where("n_shingles > 0").select("id", "n_shingles", "node").join(known, "node").select("id", "n_shingles", "component_id")
    empty = described.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return full.unionByName(empty).withColumnRenamed("id", doc_id)


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that of least id; rows without an id stay."""
    kept = group(docs).where("doc_id = component_id").select("doc_id").distinct()
    mark = inner("row", docs.columns)
    plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = docs.withColumn(mark, F.xxhash64(*[F.col(c) for c in plain]))
    least = rows.select("doc_id", mark).join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(mark).alias(mark))
    one = rows.join(least, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id"])
    return one.select(*quoted(docs.columns)).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=3, num=9, den=10)


#: DuckDB SQL of query().
ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[p:p + 2], ' ') g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) p from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
r(doc_id, near) as (select doc_id, doc_id from d union select r.doc_id, e.y from r join e on e.x = r.near)
select r.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) n_shingles, min(near) component_id from r left join n using (doc_id) group by 1
"""
