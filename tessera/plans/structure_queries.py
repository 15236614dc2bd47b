"""Queries over parse trees, signatures, layers and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import hierarchy as H
from ..operators import relational as R
from ..operators import similarity as S
from ..operators import taxonomy as X
from ..operators import variant as V
from .registry import query
from .text_queries import NAMES, names

count = lambda name="n": F.count(F.lit(1)).alias(name)


def trees(read):
    """Orders as parse trees: an effect with a target, a quantity list and, for some, an inner ability or a gap."""
    inner = F.struct(F.lit("Inner").alias("type"), F.struct(F.col("o_orderpriority").alias("type")).alias("condition"))
    effect = F.struct(
        F.when(F.col("o_orderstatus") == "P", "Unimplemented").when(F.col("o_orderstatus") == "F", "GenericEffect").otherwise("Deal").alias("type"),
        F.struct(F.concat(F.lit("T"), (F.col("o_custkey") % 5).cast("string")).alias("type"), F.array(F.struct(F.lit("Fixed").alias("type")), F.struct(F.lit("Another").alias("type"))).alias("properties")).alias("target"),
        F.array(F.struct(F.lit("Fixed").alias("type"))).alias("count"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(1))).alias("static_abilities"),
    )
    tree = F.struct(effect.alias("effect"), F.when(F.col("o_orderkey") % 2 == 0, inner).alias("sub_ability"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(True)).alias("modal"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("m"))).alias("mode_abilities"))
    return read("orders").select("o_orderkey", F.to_json(tree).alias("tree"))


SCAN = """nodes as (select o_orderkey item, 'effect' axis, case o_orderstatus when 'P' then 'Unimplemented' when 'F' then 'GenericEffect' else 'Deal' end tag, o_orderstatus = 'P' or (o_orderstatus = 'F' and o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0) gap from orders
 union all select o_orderkey, 'target', 'T' || (o_custkey % 5), false from orders union all select o_orderkey, null, 'Fixed', false from orders union all select o_orderkey, null, 'Another', false from orders
 union all select o_orderkey, 'quantity', 'Fixed', false from orders union all select o_orderkey, null, 'Inner', false from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'condition', o_orderpriority, false from orders where o_orderkey % 2 = 0)"""


@query("slot_scan", f"with {SCAN} select axis, tag, count(*) n from nodes group by 1, 2")
def slot_scan(read):
    return V.slot_scan(trees(read), "o_orderkey", "tree").groupBy("axis", "tag").agg(count())


@query("gap_predicate", f"with {SCAN} select item, count(*) filter (gap) gaps from nodes group by 1")
def gap_predicate(read):
    return V.slot_scan(trees(read), "o_orderkey", "tree").groupBy("item").agg(F.count_if("gap").alias("gaps"))


@query("overlay_patch", "select o_orderkey, case when o_orderkey % 7 = 0 then '\"patched\"' else '\"' || case o_orderstatus when 'P' then 'Unimplemented' when 'F' then 'GenericEffect' else 'Deal' end || '\"' end tag from orders")
def overlay_patch(read):
    path = F.when(F.col("o_orderkey") % 7 == 0, F.lit("effect.type"))
    t = trees(read).withColumn("tree", V.patched("tree", path, F.lit('"patched"')))
    return t.select("o_orderkey", F.concat(F.lit('"'), F.get_json_object("tree", "$.effect.type"), F.lit('"')).alias("tag"))


@query("tag_name", "select event_type, count(*) n from events group by 1")
def tag_name(read):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.to_json(F.create_map("event_type", F.lit(1)))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    return read("events").select(V.tag_names(wrapped).alias("event_type")).groupBy("event_type").agg(count())


@query("scan_variant_props", "select cast(json_extract(props, '$.k') as bigint) k, count(*) n, round(sum(value), 4) v from events group by 1")
def scan_variant_props(read):
    k = F.variant_get(F.parse_json("props"), "$.k", "long").alias("k")
    return read("events").select(k, "value").groupBy("k").agg(count(), F.round(F.sum("value"), 4).alias("v"))


@query("modal_expand", "select p_partkey, cast(i - 1 as integer) as mode, string_split(p_name, ' ')[i] mode_text from part, (values (1), (2)) m(i) where p_size > 25 union all select p_partkey, null, null from part where p_size <= 25")
def modal_expand(read):
    return V.modal_expand(read("part").select("p_partkey", F.when(F.col("p_size") > 25, F.split("p_name", " ")).alias("modes")), "modes")


FIELDS = ["p_brand", "p_type", "p_name"]


def _masks() -> str:
    """All drops of fields in SQL: prefixes of each row's fields by rarity, then place."""
    return """r as (select p_partkey id, case when p_size < 25 then 'small' else 'large' end k, p_brand, p_type, p_name from part),
n1 as (select k, p_brand, count(*) c from r group by 1, 2), n2 as (select k, p_type, count(*) c from r group by 1, 2), n3 as (select k, p_name, count(*) c from r group by 1, 2),
o as (select r.*, list_transform(list_sort([(n1.c, 0, 'p_brand'), (n2.c, 1, 'p_type'), (n3.c, 2, 'p_name')]), lambda x: x[3]) drops from r join n1 using (k, p_brand) join n2 using (k, p_type) join n3 using (k, p_name)),
s as (select id, k, lvl, case when list_contains(drops[1:lvl], 'p_brand') then '' else p_brand end b, case when list_contains(drops[1:lvl], 'p_type') then '' else p_type end t, case when list_contains(drops[1:lvl], 'p_name') then '' else p_name end m, list_sort(drops[1:lvl]) d from o, (values (0), (1), (2), (3)) l(lvl)),
dm as (select distinct d from s),
c as (select d, k, case when list_contains(d, 'p_brand') then '' else p_brand end b, case when list_contains(d, 'p_type') then '' else p_type end t, case when list_contains(d, 'p_name') then '' else p_name end m, count(*) n from r, dm group by all),
f as (select id, s.k, lvl, n, concat_ws(';', case when b <> '' then 'p_brand=' || b end, case when t <> '' then 'p_type=' || t end, case when m <> '' then 'p_name=' || m end) sig from s join c using (d, k, b, t, m) where n >= 5)"""


def parts(read):
    return read("part").withColumn("k", F.when(F.col("p_size") < 25, "small").otherwise("large"))


@query("backoff_rarest", f"with {_masks()} select id as item, k as kind, arg_min(lvl, lvl)::integer as level, arg_min(n, lvl)::bigint n, arg_min(sig, lvl) signature from f group by 1, 2")
def backoff_rarest(read):
    p = parts(read)
    return X.backoff_rarest(p, p, "p_partkey", "k", FIELDS).select("item", "kind", "level", "n", "signature")


@query("min3_variant", f"with {_masks().replace('n >= 5', 'n >= 3')}, a as (select id, arg_min(sig, lvl) s3 from f group by 1), g as (select s3, count(*) n from a group by 1) select s3 as signature, n from g")
def min3_variant(read):
    p = parts(read)
    return X.backoff_rarest(p, p, "p_partkey", "k", FIELDS, least=3).groupBy("signature").agg(count())


@query("backoff_fixed_levels", "with c as (select p_partkey, count(*) over (partition by p_name, p_type, p_brand) a, count(*) over (partition by p_name, p_type) b, count(*) over (partition by p_type) c from part) select p_partkey, case when a >= 5 then 0 when b >= 5 then 1 when c >= 5 then 2 end::integer as level from c")
def backoff_fixed_levels(read):
    return X.backoff_levels(read("part"), "p_partkey", [["p_name", "p_type", "p_brand"], ["p_name", "p_type"], ["p_type"]], 5)


@query("cap_fold_other", "with c as (select p_type, p_brand, count(*) over (partition by p_type, p_brand) n from part) select p_type, case when n < 14 then 'other' else p_brand end p_brand, count(*) n from c group by 1, 2")
def cap_fold_other(read):
    return X.cap_fold(read("part").select("p_type", "p_brand"), "p_type", "p_brand", 14).groupBy("p_type", "p_brand").agg(count())


@query("tree_rollup", "select p_type, p_brand, p_name, count(distinct p_partkey) n, case when grouping(p_name) = 1 then 'total' when count(distinct p_partkey) < 5 then 'hidden' when count(distinct p_partkey) < 10 then 'rolled up' else 'shown' end state from part group by grouping sets ((p_type), (p_type, p_brand), (p_type, p_brand, p_name))")
def tree_rollup(read):
    return X.tree_rollup(read("part"), "p_type", "p_brand", "p_name", "p_partkey")


@query("sibling_rule", "with l as (select p_brand leaf, list_sort(list_distinct(list(p_type))) f from part where p_size > 40 group by 1), o as (select f, min(leaf) leaf from l group by 1 having count(*) = 1), i as (select p_name item, list_sort(list_distinct(list(p_type))) f from part where p_size > 30 group by 1) select item, leaf from i join o using (f)")
def sibling_rule(read):
    leaves = read("part").where("p_size > 40").groupBy(F.col("p_brand").alias("leaf")).agg(F.collect_set("p_type").alias("f"))
    items = read("part").where("p_size > 30").groupBy(F.col("p_name").alias("item")).agg(F.collect_set("p_type").alias("f"))
    return X.sibling_rule(leaves, items, "leaf", "item", "f")


@query("leaf_flags", "select p_brand, list_filter(['few types', 'no large', 'small'], lambda x: case x when 'few types' then count(distinct p_type) < 6 when 'no large' then max(p_size) < 50 else count(*) < 75 end) flags from part group by 1")
def leaf_flags(read):
    x = read("part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("t"), F.max("p_size").alias("m"), count())
    _, every = R.first_cause([("few types", F.col("t") < 6), ("no large", F.col("m") < 50), ("small", F.col("n") < 75)])
    return x.select("p_brand", every.alias("flags"))


@query("card_view", "select o_orderkey, case when bool_and(l_returnflag = 'A') then 'placed' when bool_or(l_returnflag = 'A') then 'part placed' when bool_or(l_returnflag = 'N') then 'waiting' else 'unplaced' end as view from lineitem join orders on o_orderkey = l_orderkey group by 1")
def card_view(read):
    x = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = lambda v: F.col("l_returnflag") == v
    view = F.when(F.bool_and(flag("A")), "placed").when(F.bool_or(flag("A")), "part placed").when(F.bool_or(flag("N")), "waiting").otherwise("unplaced")
    return x.groupBy("o_orderkey").agg(view.alias("view"))


@query("unorganized_groups", "select o_orderpriority reason, count(*) n, min(o_orderkey) evidence from orders where o_orderstatus = 'P' group by 1")
def unorganized_groups(read):
    return read("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("reason")).agg(count(), F.min("o_orderkey").alias("evidence"))


@query("tag_layer", "with m as (select distinct p_brand || p_type g, p_partkey i from part) select g, count(*) n, case when count(*) > 16 then 'wide' else 'group' end kind from m group by 1 having count(*) >= 5")
def tag_layer(read):
    m = read("part").select(F.concat("p_brand", "p_type").alias("g"), F.col("p_partkey").alias("i")).distinct()
    return m.groupBy("g").agg(count()).where("n >= 5").select("g", "n", F.when(F.col("n") > 16, "wide").otherwise("group").alias("kind"))


@query("keyword_layer", "with k as (select p_partkey, unnest(string_split(p_name, ' ')) w from part), f as (select w, count(*) c from k group by 1), s as (select p_name, count(*) n from part group by 1) select p_partkey, case when n >= 30 then part.p_name else 'other: ' || (select arg_min(w, (c, w)) from f where list_contains(string_split(part.p_name, ' '), w)) end leaf from part join s using (p_name)")
def keyword_layer(read):
    k = read("part").select("p_partkey", "p_name", F.explode(F.split("p_name", " ")).alias("w"))
    f = k.groupBy("w").agg(count("c"))
    rare = k.join(f, "w").groupBy("p_partkey").agg(F.min_by("w", F.struct("c", "w")).alias("rare"))
    n = F.count(F.lit(1)).over(Window.partitionBy("p_name"))
    return read("part").withColumn("n", n).join(rare, "p_partkey").select("p_partkey", F.when(F.col("n") >= 30, F.col("p_name")).otherwise(F.concat(F.lit("other: "), "rare")).alias("leaf"))


@query("keyword_facet", "select w as keyword, count(*) n, list_sort(list(p_partkey)) parts from (select p_partkey, unnest(string_split(p_name, ' ')) w from part) group by 1")
def keyword_facet(read):
    k = read("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("keyword"))
    return k.groupBy("keyword").agg(count(), F.array_sort(F.collect_list("p_partkey")).alias("parts"))


@query("type_groups", "select p_type, p_brand, count(*) n from part group by 1, 2 having count(*) >= 5")
def type_groups(read):
    return read("part").groupBy("p_type", "p_brand").agg(count()).where("n >= 5")


TOPICS = {"heat": "hot|red", "size": "small|large", "age": "old|new", "metal": "bolt|gear|ring"}


@query("topic_buckets", "select p_partkey, t as topic from part, (values ('heat', 'hot|red'), ('size', 'small|large'), ('age', 'old|new'), ('metal', 'bolt|gear|ring')) v(t, rx) where regexp_matches(p_name, rx)")
def topic_buckets(read):
    hits = F.array_compact(F.array(*[F.when(F.col("p_name").rlike(rx), F.lit(t)) for t, rx in TOPICS.items()]))
    return read("part").select("p_partkey", F.explode(hits).alias("topic"))


@query("branch_rules", "with s as (select l_suppkey, avg((l_returnflag = 'R')::integer::double) r, avg((l_discount >= 0.05)::integer::double) d from lineitem group by 1) select l_suppkey, case when r >= 0.36 then 'returns' when d >= 0.55 then 'discounts' else 'review' end branch from s")
def branch_rules(read):
    s = read("lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("int").cast("double")).alias("r"), F.avg((F.col("l_discount") >= 0.05).cast("int").cast("double")).alias("d"))
    first, _ = R.first_cause([("returns", F.col("r") >= 0.36), ("discounts", F.col("d") >= 0.55)])
    return s.select("l_suppkey", F.coalesce(first, F.lit("review")).alias("branch"))


CENTROIDS = """e as (select vec_id, label, unnest(embedding)::double x, unnest(range(64)) i from embeddings), c as (select label, i, avg(x) m from e group by 1, 2), cn as (select label, sqrt(sum(m * m)) l from c group by 1), en as (select vec_id, sqrt(sum(x * x)) l from e group by 1),
s as (select vec_id, c.label leaf, sum(x * m) / (any_value(cn.l) * any_value(en.l)) s from e join c using (i) join cn on cn.label = c.label join en using (vec_id) group by 1, 2)"""


def nearest(read):
    e = read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    leaves = c.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("leaf"), "m"))).alias("leaves"))  # one row per label
    scored = F.transform("leaves", lambda v: F.struct(S.dense_cosine(F.col("embedding"), v["m"]).alias("s"), v["leaf"].alias("leaf")))
    best = F.array_max(scored)
    return read("embeddings").join(F.broadcast(leaves)).select("vec_id", "label", best.alias("b")).select("vec_id", "label", F.col("b.leaf").alias("leaf"), F.round("b.s", 6).alias("s"))


@query("join_nearest_centroid", f"with {CENTROIDS} select vec_id, arg_max(leaf, (s, leaf)) leaf, round(max(s), 6) s from s group by 1")
def join_nearest_centroid(read):
    return nearest(read).select("vec_id", "leaf", "s")


@query("placement_proximity", f"with {CENTROIDS}, b as (select vec_id, round(max(s), 6) s from s group by 1) select case when s >= 0.8 then 'placed' when s >= 0.6 then 'review' else 'far' end as state, count(*) n from b group by 1")
def placement_proximity(read):
    s = F.when(F.col("s") >= 0.8, "placed").when(F.col("s") >= 0.6, "review").otherwise("far")
    return nearest(read).groupBy(s.alias("state")).agg(count())


@query("leaf_centroid", f"with {CENTROIDS} select c.label, i::integer i, round(m / l, 6) w from c join cn using (label)")
def leaf_centroid(read):
    e = read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("token", "x"))
    v = e.select(F.col("vec_id").alias("item"), "token", F.col("x").cast("double").alias("w"))
    c = S.centroids(v, read("embeddings").select(F.col("vec_id").alias("item"), "label"), "label")
    return c.select("label", F.col("token").alias("i"), F.round("w", 6).alias("w"))


@query("dense_embed", "with q as (select embedding q from embeddings where vec_id = 7) select vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) s from embeddings, q order by s desc, vec_id limit 20")
def dense_embed(read):
    q = read("embeddings").where("vec_id = 7").select(F.col("embedding").alias("q"))
    return read("embeddings").join(F.broadcast(q)).select("vec_id", F.round(S.dense_cosine(F.col("embedding"), F.col("q")), 6).alias("s")).orderBy(F.desc("s"), "vec_id").limit(20)


@query("idf_l2_space", f"with {NAMES}, sets as (select item, list_distinct(regexp_extract_all(item, '[a-z]+')) t from names), post as (select item, unnest(t) tok from sets), df as (select tok, ln((1 + (select count(*) from sets))::double / (1 + count(*))) + 1 w from post group by 1) select item, tok as token, round(w / sqrt(sum(w * w) over (partition by item)), 7) w from post join df using (tok)")
def idf_l2_space(read):
    return S.weighted(names(read), "item", "t", smooth=True).select("item", "token", F.round("w", 7).alias("w"))


@query("union_find", "with recursive e as (select distinct l_suppkey a, l_suppkey - l_suppkey % 4 b from lineitem) select a node, b root from e")
def union_find(read):
    x = read("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") - F.col("l_suppkey") % 4).alias("b")).distinct()
    return C.components(x).unionByName(x.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))).distinct()


@query("chips_narrow")
def chips_narrow(read):
    c = names(read).withColumn("g", F.element_at(F.split("item", " "), 3)).withColumn("o", -F.col("n"))
    return C.chips(c.select("g", "item", "o", "t"), "g", "item", ["o", "item"], "t", most=0.5, keep=10)


@query("leader_cluster")
def leader_cluster(read):
    c = names(read).withColumn("g", F.element_at(F.split("item", " "), 3))
    return C.leaders(c.select("g", "item", "t"), "g", "item", "t", 0.5)


@query("hdbscan_cluster")
def hdbscan_cluster(read):
    """Density clusters of the vectors of each label."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vec_id")
        x = np.stack(own["embedding"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        labels = C.density_labels(len(x), lambda i: np.clip(1 - x @ x[i], 0, None))
        return pd.DataFrame({"vec_id": own["vec_id"], "label": own["label"], "cluster": labels})

    return read("embeddings").groupBy("label").applyInPandas(run, "vec_id long, label int, cluster long")


@query("sector_geometry")
def sector_geometry(read):
    """Spanning tree of label centroids by cosine distance, edges up to 1."""
    e = read("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("label")
        x = np.stack(own["m"].to_numpy())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        names_ = own["label"].to_numpy()
        out = [(int(names_[a]), int(names_[b]), round(d, 6)) for a, b, d in C.spanning_tree(1 - x @ x.T, 1.0)]
        return pd.DataFrame(out, columns=["a", "b", "distance"])

    return c.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "a int, b int, distance double")


def label_share(e, size: int = 8192, k: int = 10):
    """(label, share) of vectors (vec_id, embedding, label): mean share of a vector's k nearest by cosine with its label.

    Exact, over all pairs: blocks of about size vectors by hash, one task for each two blocks, the tops of a vector
    merged over its tiles.  Similarities count in steps of 1e-12 and ties go to the lower id.
    """
    kind = pa.struct([("far", pa.int64()), ("id", pa.int64()), ("same", pa.bool_())])

    def run(own: pa.Table) -> pa.Table:
        own = own.take(pc.sort_indices(own["vec_id"])).combine_chunks()
        ids, label, block = own["vec_id"].to_numpy(), own["label"].to_numpy(), own["block"].to_numpy()
        x = own["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(length > 0, length, 1)
        i, j = own["i"][0].as_py(), own["j"][0].as_py()
        rows, tops = [np.zeros(0, np.int64)], [pa.array([], pa.list_(kind))]
        for one, two in {(i, j), (j, i)}:
            p, q = np.flatnonzero(block == one), np.flatnonzero(block == two)
            n, m = min(k, len(q) - (one == two)), 1 << len(q).bit_length()
            for at in p[::512] if n > 0 else []:
                part = p[(p >= at)][:512]
                key = np.rint(x[part] @ x[q].T * 1e12).astype(np.int64) * m + (m - 1 - np.arange(len(q)))
                if one == two:
                    key[np.arange(len(part)), np.searchsorted(q, part)] = np.iinfo(np.int64).min
                key.partition(len(q) - n, axis=1)
                best = key[:, len(q) - n :]
                to = q[m - 1 - best % m]
                found = pa.StructArray.from_arrays([pa.array(-(best // m).ravel()), pa.array(ids[to].ravel()), pa.array((label[part][:, None] == label[to]).ravel())], fields=list(kind))
                tops.append(pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), found))
                rows.append(part)
        at = pa.array(np.concatenate(rows))
        return pa.table({"vec_id": own["vec_id"].take(at), "label": own["label"].take(at), "near": pa.chunked_array(tops)})

    e = e.where("embedding is not null").select("vec_id", "embedding", "label")
    blocks = max(1, -(-e.count() // size))
    block, other = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = e.withColumn("block", block).withColumn("other", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")
    tops = tiles.groupBy("i", "j").applyInArrow(run, "vec_id long, label int, near array<struct<far: long, id: long, same: boolean>>")
    near = tops.groupBy("vec_id", "label").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    share = F.size(F.filter("near", lambda v: v["same"])) / F.size("near")
    return near.groupBy("label").agg(F.round(F.avg(share), 6).alias("share"))


@query("leaf_map")
def leaf_map(read):
    """Share of each vector's ten nearest that has its label, by label."""
    return label_share(read("embeddings"))


@query("also_fits", f"with {CENTROIDS} select vec_id, leaf from (select vec_id, leaf, row_number() over (partition by vec_id order by s desc, leaf desc) p, s from s) where p = 2 and s >= 0.2")
def also_fits(read):
    e = read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    leaves = c.agg(F.collect_list(F.struct(F.col("label").alias("leaf"), "m")).alias("leaves"))
    scored = F.array_sort(F.transform("leaves", lambda v: F.struct((-S.dense_cosine(F.col("embedding"), v["m"])).alias("s"), (-v["leaf"]).alias("leaf"))))
    second = read("embeddings").join(F.broadcast(leaves)).select("vec_id", F.get(scored, F.lit(1)).alias("b"))
    return second.where("b.s <= -0.2").select("vec_id", (-F.col("b.leaf")).alias("leaf"))


@query("tentative_promote", "with r as (select l_suppkey g, count(*) filter (l_returnflag <> 'R') ok, count(*) n from lineitem group by 1) select g, case when ok >= 5 and ok / n::double >= 0.67 then 'promoted' else 'held' end state from r")
def tentative_promote(read):
    r = read("lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.count_if(F.col("l_returnflag") != "R").alias("ok"), count())
    return r.select("g", F.when((F.col("ok") >= 5) & (F.col("ok") / F.col("n") >= 0.67), "promoted").otherwise("held").alias("state"))


@query("annotation_layer", "with s as (select p_partkey, p_type, p_name, count(*) over (partition by p_type, p_name) n, p_size % 3 = 0 cond from part) select p_partkey, case when n >= 5 then p_type || ';' || p_name end leaf, case when cond then 'condition' else 'gap' end stratum from s")
def annotation_layer(read):
    n = F.count(F.lit(1)).over(Window.partitionBy("p_type", "p_name"))
    return read("part").select("p_partkey", F.when(n >= 5, F.concat_ws(";", "p_type", "p_name")).alias("leaf"), F.when(F.col("p_size") % 3 == 0, "condition").otherwise("gap").alias("stratum"))


@query("signature_layer", "select p_partkey, case when p_type = 'PROMO' and p_name like '%ring%' then 'promo ring' when p_type = 'PROMO' then 'promo' else 'family ' || lower(p_type) end leaf from part")
def signature_layer(read):
    first, _ = R.first_cause([("promo ring", (F.col("p_type") == "PROMO") & F.contains("p_name", F.lit("ring"))), ("promo", F.col("p_type") == "PROMO")])
    return read("part").select("p_partkey", F.coalesce(first, F.concat(F.lit("family "), F.lower("p_type"))).alias("leaf"))


@query("merged_pages", "with m as (select distinct p_type page, p_brand grp, p_partkey item from part) select page, count(distinct grp) groups, count(distinct item) items from m group by 1")
def merged_pages(read):
    return read("part").groupBy(F.col("p_type").alias("page")).agg(F.count_distinct("p_brand").alias("groups"), F.count_distinct("p_partkey").alias("items"))


@query("cluster_diversity", "select p_brand, count(distinct string_split(p_name, ' ')[1]) leads from part group by 1")
def cluster_diversity(read):
    return read("part").groupBy("p_brand").agg(F.count_distinct(F.element_at(F.split("p_name", " "), 1)).alias("leads"))


@query("tag_hierarchy_rollup", """with recursive d as (select doc_id, n_chars % 300 t from documents), k as (select distinct t from d), u as (select t, p from (select t, unnest([t // 2, t // 3]) p from k where t >= 4 and t % 50 <> 7) where p in (select t from k)),
r(t, a, depth) as (select t, t, 0 from k union select r.t, u.p, depth + 1 from r join u on u.t = r.a), m as (select t, a, min(depth) depth from r where a not in (select t from u) group by 1, 2)
select a as root, count(distinct m.t) tags, count(distinct doc_id) items, max(depth)::integer depth from m left join d on d.t = m.t group by 1""")
def tag_hierarchy_rollup(read):
    """Lengths as tags with two parents each, rolled up to their roots."""
    d = read("documents").select(F.col("doc_id").alias("item"), (F.col("n_chars") % 300).alias("tag"))
    t = F.col("tag")
    parents = F.when((t >= 4) & (t % 50 != 7), F.array(F.floor(t / 2), F.floor(t / 3))).otherwise(F.expr("cast(array() as array<bigint>)"))
    return H.rollup(d, H.roots(d.select("tag").distinct().withColumn("parents", parents)))


@query("layout_validation", "with e as (select vec_id, label, embedding::double[] v from embeddings), c as (select a.label, avg(list_cosine_similarity(a.v, b.v)) s from e a join e b on a.label = b.label and a.vec_id < b.vec_id group by 1) select label, round(s, 5) s from c")
def layout_validation(read):
    """Mean cosine of the pairs of a label, from sums of unit vectors and so without pairs."""
    dot = F.aggregate(F.zip_with("embedding", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    e = read("embeddings").withColumn("l", F.sqrt(dot)).select("label", "vec_id", "l", F.posexplode("embedding").alias("i", "x"))
    u = e.groupBy("label", "i").agg(F.sum(F.col("x").cast("double") / F.col("l")).alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    n = read("embeddings").groupBy("label").agg(count())
    return u.join(n, "label").select("label", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("s"))


@query("isotonic_calibration")
def isotonic_calibration(read):
    """Share of labelled quality by text length, made monotone per language."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x, y = C.isotonic(own["bin"].to_numpy(float), own["rate"].to_numpy(float))
        return pd.DataFrame({"lang": own["lang"].iloc[0], "upto": x, "rate": np.clip(y, 0.02, 0.99)})

    x = read("documents").join(read("labels"), "doc_id").groupBy("lang", F.floor(F.log2(F.col("n_chars") + 1.0)).alias("bin")).agg(F.avg("quality").alias("rate"))
    return x.groupBy("lang").applyInPandas(run, "lang string, upto double, rate double")
