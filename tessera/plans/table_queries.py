"""Queries over the star schema: filters, joins, aggregates, ranks, sets, sorts, samples, edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import containment
from ..operators import edits as E
from ..operators import relational as R
from .registry import query

count = lambda name="n": F.count(F.lit(1)).alias(name)

#: Cards from parts: five colour bits from the key, a value that is null for some, kind, rank.
CARDS = "cards as (select p_partkey id, p_name as name, p_type kind, p_brand sub, cast(p_partkey % 32 as integer) mask, case when p_size % 10 = 0 then null else p_size % 9 end::integer mv, case when p_partkey % 7 = 0 then null else p_size end::integer as rank from part)"


def cards(read):
    mv = F.when(F.col("p_size") % 10 == 0, None).otherwise(F.col("p_size") % 9).cast("int")
    rank = F.when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_size")).cast("int")
    return read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("sub"), (F.col("p_partkey") % 32).cast("int").alias("mask"), mv.alias("mv"), rank.alias("rank"))


@query("card_filter_basic", f"with {CARDS} select id from cards where name like '%ring%' and (mask & 3) <> 0 and kind in ('PROMO', 'SMALL') and mv between 1 and 6")
def card_filter_basic(read):
    return cards(read).where(F.contains("name", F.lit("ring")) & codes.colour_ok(F.col("mask"), "WU", "any") & F.col("kind").isin("PROMO", "SMALL") & F.col("mv").between(1, 6)).select("id")


@query("card_filter_tester", f"with {CARDS} select id, case when mv is null then 'none' when mv >= 6 then '6+' else mv::varchar end as bucket from cards where ((mask & 5) <> 0 or mask = 0) and kind in ('ECONOMY', 'LARGE') and sub in ('Brand#1', 'Brand#2', 'Brand#3') and (mv is null or mv in (2, 3) or mv >= 6)")
def card_filter_tester(read):
    x = cards(read).withColumn("bucket", codes.mv_bucket(F.col("mv")))
    return x.where(codes.colour_ok(F.col("mask"), "WBC", "any") & F.col("kind").isin("ECONOMY", "LARGE") & F.col("sub").isin("Brand#1", "Brand#2", "Brand#3") & F.col("bucket").isin("none", "2", "3", "6+")).select("id", "bucket")


@query("mv_bucket", f"with {CARDS} select case when mv is null then 'none' when mv >= 6 then '6+' else mv::varchar end as bucket, count(*) n from cards group by 1")
def mv_bucket(read):
    return cards(read).groupBy(codes.mv_bucket(F.col("mv")).alias("bucket")).agg(count())


@query("colour_modes", """with c as (select range::integer m from range(32)) select m as mask, (m & 3) <> 0 as any_wu, (m & 3) = 3 as all_wu, case when m = 0 then false else (m & 28) = 0 end only_wu, m = 3 as exactly_wu, (m & 3) = 0 as not_wu,
 m = 0 or bit_count(m) >= 2 as any_cm, (m & 1) = 1 and bit_count(m) >= 2 as all_wm, case when m = 0 then false else bit_count(m) >= 2 end only_m, bit_count(m) >= 2 as exactly_m, m <> 0 as not_c, m = 0 as exactly_c from c""")
def colour_modes(read):
    m = F.col("mask")
    cases = {"any_wu": ("WU", "any"), "all_wu": ("WU", "all"), "only_wu": ("WU", "only"), "exactly_wu": ("WU", "exactly"), "not_wu": ("WU", "not"), "any_cm": ("CM", "any"), "all_wm": ("WM", "all"), "only_m": ("M", "only"), "exactly_m": ("M", "exactly"), "not_c": ("C", "not"), "exactly_c": ("C", "exactly")}
    masks = read("part").sparkSession.range(32).select(F.col("id").cast("int").alias("mask"))
    return masks.select("mask", *[codes.colour_ok(m, chosen, mode).alias(name) for name, (chosen, mode) in cases.items()])


@query("facets_colour_mv", r"with c as (select p_partkey, '{' || (p_size % 4) || '}{' || (case p_size % 3 when 0 then 'W' when 1 then 'X' else '2/U' end) || '}' as cost from part) select p_partkey, (case when cost like '%W%' then 1 else 0 end + case when cost like '%U%' then 2 else 0 end)::integer mask, (regexp_extract(cost, '\{([0-9]+)\}', 1)::integer + case when cost like '%W%' then 1 when cost like '%2/U%' then 2 else 0 end)::integer mv from c")
def facets_colour_mv(read):
    shard = F.when(F.col("p_size") % 3 == 0, "W").when(F.col("p_size") % 3 == 1, "X").otherwise("2/U")
    cost = F.concat(F.lit("{"), (F.col("p_size") % 4).cast("string"), F.lit("}{"), shard, F.lit("}"))
    return read("part").select("p_partkey", cost.alias("cost")).select("p_partkey", codes.colour_mask(F.col("cost")).alias("mask"), codes.mana_value(F.col("cost")).alias("mv"))


@query("sign_class", "select l_orderkey, l_linenumber, case when l_discount > 0.05 and l_tax > 0.04 then '±' when l_discount > 0.05 then '+' when l_tax > 0.04 then '-' else '0' end as sign from lineitem")
def sign_class(read):
    change = F.concat(F.when(F.col("l_discount") > 0.05, "+2").otherwise("+0"), F.lit("/"), F.when(F.col("l_tax") > 0.04, "-1").otherwise("-0"))
    return read("lineitem").select("l_orderkey", "l_linenumber", codes.sign_class(change).alias("sign"))


@query("corr_filter_chain", "select count(*) filter (l_returnflag <> 'R') clean, count(*) filter (l_returnflag <> 'R' and l_linestatus = 'F') settled, count(*) filter (l_returnflag <> 'R' and l_linestatus = 'F' and l_discount < 0.03) plain from lineitem")
def corr_filter_chain(read):
    return R.funnel(read("lineitem"), [("clean", F.col("l_returnflag") != "R"), ("settled", F.col("l_linestatus") == "F"), ("plain", F.col("l_discount") < 0.03)])


@query("classify_quality", "select o_orderkey, case when o_totalprice is null then 'unparsed' when o_orderstatus = 'F' and o_orderpriority like '1%' then 'clean' when o_orderstatus = 'P' then 'partial' else 'vanilla' end state from orders")
def classify_quality(read):
    first, _ = R.first_cause([("unparsed", F.col("o_totalprice").isNull()), ("clean", (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")), ("partial", F.col("o_orderstatus") == "P")])
    return read("orders").select("o_orderkey", F.coalesce(first, F.lit("vanilla")).alias("state"))


@query("primary_cause", "select l_orderkey, l_linenumber, case when l_discount > 0.08 then 'discount' when l_tax > 0.06 then 'tax' when l_quantity > 45 then 'bulk' end cause, (l_discount > 0.08)::integer + (l_tax > 0.06)::integer + (l_quantity > 45)::integer as causes from lineitem")
def primary_cause(read):
    first, every = R.first_cause([("discount", F.col("l_discount") > 0.08), ("tax", F.col("l_tax") > 0.06), ("bulk", F.col("l_quantity") > 45)])
    return read("lineitem").select("l_orderkey", "l_linenumber", first.alias("cause"), F.size(every).alias("causes"))


@query("in_all_narrow", "select distinct l_orderkey from lineitem join part on p_partkey = l_partkey where p_type = 'PROMO' intersect select distinct l_orderkey from lineitem join part on p_partkey = l_partkey where p_type in ('SMALL', 'LARGE') intersect select o_orderkey from orders where o_orderstatus = 'F'")
def in_all_narrow(read):
    member = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type")
    rows = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    for chosen in (["PROMO"], ["SMALL", "LARGE"]):
        rows = rows.join(member.where(F.col("p_type").isin(chosen)).select("l_orderkey"), "l_orderkey", "left_semi")
    return rows


@query("eligibility_tentative", "select c_custkey from customer where c_name <> '' and c_acctbal > 0 and c_mktsegment not in ('BUILDING')")
def eligibility_tentative(read):
    return read("customer").where((F.col("c_name") != "") & (F.col("c_acctbal") > 0) & ~F.col("c_mktsegment").isin("BUILDING")).select("c_custkey")


@query("not_for_constructed", "select l_orderkey from lineitem group by 1 having bool_and(l_returnflag = 'R') and not bool_or(l_linestatus = 'O')")
def not_for_constructed(read):
    return read("lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b")).where("a and not b").select("l_orderkey")


@query("gap_tests", "with g as (select distinct event_type from events where value < 1), a as (select event_id, event_type, user_id from events) select event_id from a where not exists (select 1 from g where contains(g.event_type, left(a.event_type, 4)) and a.user_id % 2 = 0)")
def gap_tests(read):
    gaps = read("events").where("value < 1").select(F.substring("event_type", 1, 40).alias("g")).distinct().agg(F.collect_set("g").alias("gs"))
    items = read("events").select("event_id", "event_type", "user_id").join(F.broadcast(gaps))
    hit = F.exists("gs", lambda g: F.contains(g, F.substring("event_type", 1, 4))) & (F.col("user_id") % 2 == 0)
    return items.where(~hit).select("event_id")


@query("join_hash_equi", "select l_orderkey, l_linenumber, coalesce(p_name, s_name) as label from lineitem left join part on p_partkey = l_partkey and p_size > 10 left join supplier on s_suppkey = l_suppkey")
def join_hash_equi(read):
    part, supplier = read("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name"), read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return read("lineitem").join(part, "l_partkey", "left").join(supplier, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", "s_name").alias("label"))


@query("join_left_default", "select c_custkey, coalesce(o_totalprice, 0.0::double) best from customer left join (select o_custkey, max(o_totalprice) o_totalprice from orders group by 1) on o_custkey = c_custkey")
def join_left_default(read):
    best = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return read("customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", F.coalesce("best", F.lit(0.0)).alias("best"))


@query("join_semi", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def join_semi(read):
    return read("orders").join(read("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("join_anti_orphans", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 200000)")
def join_anti_orphans(read):
    """Customers without a large order that is filled."""
    large = read("orders").where("o_orderstatus = 'F' and o_totalprice > 200000")
    return read("customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_theta_containment", r"""with n as (select distinct array_to_string(string_split(trim(text), ' ')[1:3], ' ') || case when item_id % 2 = 0 then ', the ' || item_id else '' end as name from benchmark),
v as (select distinct name, unnest([lower(name), lower(trim(string_split(name, ',')[1]))]) variant from n), d as (select doc_id item, lower(text) t from documents where text is not null),
p as (select item, name, variant, t, string_split(t, variant) ps from d, v where contains(t, variant)), q as (select item, name, variant, t, unnest(list_transform(range(1, len(ps)), lambda i: 1 + list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(variant)))::integer place from p)
select item, name, variant, place from q where not (place > 1 and regexp_matches(t[place - 1], '[\p{L}\p{N}_]')) and not regexp_matches(t[place + length(variant)], '[\p{L}\p{N}_]')""")
def join_theta_containment(read):
    """Names (the first words of benchmark items) wherever they stand in documents."""
    name = F.concat(F.array_join(F.slice(F.split(F.trim("text"), " ", -1), 1, 3), " "), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(", the "), F.col("item_id").cast("string"))).otherwise(""))
    return containment.contained(read("documents"), "doc_id", "text", read("benchmark").select(name.alias("name")).distinct(), "name")


@query("join_collision_diff", "select p_name as name, count(distinct p_partkey) ids, min(p_partkey) kept from part group by 1 having count(distinct p_partkey) > 1")
def join_collision_diff(read):
    return R.collisions(read("part").withColumnRenamed("p_name", "name"), "name", "p_partkey")


BUILDS = "a as (select p_partkey id, p_type as before from part where p_partkey % 5 <> 0), b as (select p_partkey id, case when p_size > 40 then 'HUGE' else p_type end as after from part where p_partkey % 7 <> 0)"


def builds(read):
    part = read("part")
    return part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("leaf")), part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, "HUGE").otherwise(F.col("p_type")).alias("leaf"))


@query("join_build_compare", f"with {BUILDS} select coalesce(a.id, b.id) id, before, after, case when a.id is null then 'added' when b.id is null then 'lost' when before = after then 'same' else 'moved' end state from a full join b on a.id = b.id")
def join_build_compare(read):
    return R.compare_builds(*builds(read), ["id"], "leaf")


@query("join_reverse_index", "with s as (select l_orderkey, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_linenumber) p from lineitem) select l_partkey, count(*) n, list(l_orderkey order by l_quantity desc, l_orderkey) orders from s where p <= 3 group by 1")
def join_reverse_index(read):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_linenumber")
    s = read("lineitem").withColumn("p", F.row_number().over(w)).where("p <= 3")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_orderkey")))
    return s.groupBy("l_partkey").agg(count(), ordered.alias("o")).select("l_partkey", "n", F.transform("o", lambda x: x["l_orderkey"]).alias("orders"))


@query("agg_occurrence", "select l_returnflag, l_linestatus, count(*) n from lineitem group by grouping sets ((l_returnflag), (l_returnflag, l_linestatus), ())")
def agg_occurrence(read):
    return read("lineitem").groupingSets([["l_returnflag"], ["l_returnflag", "l_linestatus"], []], "l_returnflag", "l_linestatus").agg(count())


@query("agg_share_threshold", "with s as (select l_suppkey, count(distinct l_orderkey) size from lineitem group by 1), f as (select l_suppkey, l_returnflag, count(distinct l_orderkey) n from lineitem group by 1, 2) select l_suppkey, l_returnflag, n, size from f join s using (l_suppkey) where n >= 0.34 * size")
def agg_share_threshold(read):
    return R.share_threshold(read("lineitem"), "l_suppkey", "l_returnflag", "l_orderkey", 0.34)


@query("agg_cluster_label", "with c as (select p_type, p_brand, count(*) n from part group by 1, 2) select p_type, p_brand, n from c qualify row_number() over (partition by p_type order by n desc, p_brand) <= 3")
def agg_cluster_label(read):
    c = read("part").groupBy("p_type", "p_brand").agg(count())
    return R.top_k(c, ["p_type"], [F.desc("n"), F.col("p_brand")], 3).select("p_type", "p_brand", "n")


PERCENTS = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)
PERCENTILES = ", ".join(f"round(quantile_cont(x, {p / 100}), 4) p{p}" for p in PERCENTS)
BINS = ", ".join(f"count(*) filter (bin = {i})" for i in range(1, 21))


@query("agg_percentile_hist", f"""with e as (select min(l_extendedprice) filter (isfinite(l_extendedprice)) lo, max(l_extendedprice) filter (isfinite(l_extendedprice)) hi from lineitem),
b as (select l_returnflag, l_extendedprice x, case when isfinite(l_extendedprice) then case when hi > lo then least(20, floor((l_extendedprice - lo) / (hi - lo) * 20) + 1) else 11 end end bin from lineitem, e)
select l_returnflag, {PERCENTILES}, [{BINS}] hist20 from b group by 1""")
def agg_percentile_hist(read):
    """Eleven percentiles of the prices of a flag, and how many of them are in each of twenty bins over the range of all prices."""
    lines = read("lineitem")
    found = R.quantiles(lines, "l_returnflag", "l_extendedprice", {f"p{p}": p / 100 for p in PERCENTS}).alias("q")
    hist = R.histogram(lines, "l_returnflag", "l_extendedprice", 20, "hist20").alias("h")
    both = found.join(hist, F.col("q.l_returnflag").eqNullSafe(F.col("h.l_returnflag")))
    return both.select("q.l_returnflag", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in PERCENTS], "hist20")


@query("agg_histogram", "select cast(least(20, floor(l_discount * 200) + 1) as bigint) bin, count(*) n from lineitem group by 1")
def agg_histogram(read):
    return read("lineitem").groupBy(F.least(F.lit(20), F.floor(F.col("l_discount") * 200) + 1).cast("long").alias("bin")).agg(count())


@query("agg_reconcile", "select o_orderstatus as status, count(*) n, (select count(*) from orders) total from orders group by 1")
def agg_reconcile(read):
    by = read("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(count())
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return by.withColumn("total", whole)


@query("agg_status_furthest_face", "select l_orderkey, min(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end)::integer stage from lineitem group by 1")
def agg_status_furthest_face(read):
    stage = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return read("lineitem").groupBy("l_orderkey").agg(F.min(stage).alias("stage"))


@query("agg_majority_subtype", "with c as (select p_brand, p_type, count(*) n from part group by 1, 2) select p_brand, p_type, n / sum(n) over (partition by p_brand) >= 0.2 as major from c")
def agg_majority_subtype(read):
    c = read("part").groupBy("p_brand", "p_type").agg(count())
    return c.select("p_brand", "p_type", (F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")) >= 0.2).alias("major"))


@query("agg_domain_vote", "select p_brand, arg_max(p_type, (n, -o)) as domain from (select p_brand, p_type, count(*) n, ascii(p_type) * 1000 + ascii(p_type[2]) o from part group by 1, 2) group by 1")
def agg_domain_vote(read):
    order = F.ascii("p_type") * 1000 + F.ascii(F.substring("p_type", 2, 1))
    c = read("part").groupBy("p_brand", "p_type").agg(count()).withColumn("o", order)
    return c.groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", -F.col("o"))).alias("domain"))


@query("agg_type_shares", "with c as (select p_brand, p_type, count(*) n from part group by 1, 2), s as (select p_brand, p_type, n / sum(n) over (partition by p_brand) s from c) select p_brand, count(*) filter (s >= 0.2) >= 2 as mixed from s group by 1")
def agg_type_shares(read):
    c = read("part").groupBy("p_brand", "p_type").agg(count())
    s = c.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")))
    return s.groupBy("p_brand").agg((F.count_if(F.col("s") >= 0.2) >= 2).alias("mixed"))


FACETS = f"with {CARDS}, f as (select *, (mask & 3) <> 0 p1, kind in ('PROMO', 'SMALL') p2, coalesce(mv >= 3, false) p3 from cards)"


@query("agg_facet_counts", FACETS + " select 'colour' facet, mask::varchar as value, count(*) n from f where p2 and p3 group by 2 union all select 'kind', kind, count(*) from f where p1 and p3 group by 2 union all select 'mv', mv::varchar, count(*) from f where p1 and p2 group by 2")
def agg_facet_counts(read):
    tests = {"colour": F.col("mask").bitwiseAND(3) != 0, "kind": F.col("kind").isin("PROMO", "SMALL"), "mv": F.col("mv") >= 3}
    return R.facet_counts(cards(read), tests, {"colour": "mask", "kind": "kind", "mv": "mv"})


@query("agg_step_counts", "select l_suppkey, count(*) filter (l_discount >= 0.05 - 1e-9) s5, count(*) filter (l_discount >= 0.08 - 1e-9) s8 from lineitem group by 1")
def agg_step_counts(read):
    return read("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") >= 0.05 - 1e-9).alias("s5"), F.count_if(F.col("l_discount") >= 0.08 - 1e-9).alias("s8"))


@query("agg_wilson", "with c as (select l_suppkey, count(*) filter (l_returnflag = 'R')::double k, count(*)::double n from lineitem group by 1) select l_suppkey, round((k / n + 1.96*1.96 / (2*n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96*1.96 / (4*n*n))) / (1 + 1.96*1.96 / n), 7) low, round((k / n + 1.96*1.96 / (2*n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96*1.96 / (4*n*n))) / (1 + 1.96*1.96 / n), 7) high from c")
def agg_wilson(read):
    c = read("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), count())
    low, high = codes.wilson(F.col("k"), F.col("n"))
    return c.select("l_suppkey", F.round(low, 7).alias("low"), F.round(high, 7).alias("high"))


@query("agg_f1", "with m as (select distinct l_suppkey g, l_partkey i from lineitem), t as (select p_type t, p_partkey i from part), b as (select g, t, count(*) c from m join t using (i) group by 1, 2), gs as (select g, count(*) ng from m group by 1), ts as (select t, count(*) nt from t group by 1) select g, t, c, round(2.0::double * c / (ng + nt), 7) f1 from b join gs using (g) join ts using (t) where c >= 5")
def agg_f1(read):
    m = read("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("i")).distinct()
    t = read("part").select(F.col("p_type").alias("t"), F.col("p_partkey").alias("i"))
    b = m.join(t, "i").groupBy("g", "t").agg(count("c")).where("c >= 5")
    x = b.join(m.groupBy("g").agg(count("ng")), "g").join(t.groupBy("t").agg(count("nt")), "t")
    return x.select("g", "t", "c", F.round(2.0 * F.col("c") / (F.col("ng") + F.col("nt")), 7).alias("f1"))


@query("agg_topic_mask", "select l_suppkey, bit_or(1::bigint << (l_linenumber % 15)::bigint) as mask from lineitem group by 1")
def agg_topic_mask(read):
    return read("lineitem").groupBy("l_suppkey").agg(F.bit_or(F.expr("shiftleft(1L, cast(l_linenumber % 15 as int))")).alias("mask"))


@query("agg_log_upsert", "select event_type q, count(*) searches, count(*) filter (value < 5) zero, max(ts) as last from events group by 1")
def agg_log_upsert(read):
    return read("events").groupBy(F.col("event_type").alias("q")).agg(count("searches"), F.count_if(F.col("value") < 5).alias("zero"), F.max("ts").alias("last"))


@query("topk_per_group", "select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) place from orders qualify place <= 3")
def topk_per_group(read):
    return R.top_k(read("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("sequence_scan", "with s as (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) nxt from events) select event_type || ' ' || nxt as pair, count(*) n from s where nxt is not null group by 1")
def sequence_scan(read):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read("events").select(F.concat_ws(" ", "event_type", nxt).alias("pair"), nxt.alias("nxt")).where("nxt is not null").groupBy("pair").agg(count())


@query("sort_popularity", f"with {CARDS} select id, cast(row_number() over (order by rank asc nulls last, name, id) as integer) place from cards qualify place <= 100 order by place")
def sort_popularity(read):
    top = cards(read).orderBy(F.asc_nulls_last("rank"), "name", "id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("rank"), "name", "id"))).select("id", "place").orderBy("place")


@query("sort_mv", f"with {CARDS} select id, mv from cards order by mv asc nulls last, lower(name), id limit 50")
def sort_mv(read):
    return cards(read).orderBy(F.asc_nulls_last("mv"), F.lower("name"), "id").limit(50).select("id", "mv")


@query("sort_within_section", f"with {CARDS} select kind, id, cast(row_number() over (partition by kind order by rank asc nulls last, name, id) as integer) place from cards")
def sort_within_section(read):
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.asc_nulls_last("rank"), "name", "id"))
    return cards(read).select("kind", "id", place.alias("place"))


@query("sample_stratified")
def sample_stratified(read):
    """Five of each segment by a seeded hash."""
    return R.top_k(read("customer"), ["c_mktsegment"], [F.xxhash64("c_custkey", F.lit(7)), F.col("c_custkey")], 5).select("c_mktsegment", "c_custkey")


@query("set_union_pages", "with r as (select distinct l_partkey item, l_linenumber section from lineitem) select item, min(section) as section, list_sort(list(section))[2:] also from r group by 1")
def set_union_pages(read):
    return R.union_pages(read("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("section")), "item", "section")


@query("set_intersect", "select distinct l_partkey from lineitem where l_returnflag = 'A' intersect select p_partkey from part where p_size < 10")
def set_intersect(read):
    return read("lineitem").where("l_returnflag = 'A'").select("l_partkey").intersect(read("part").where("p_size < 10").select("p_partkey"))


@query("set_except", "select p_partkey from part except select l_partkey from lineitem where l_quantity > 48 except select p_partkey from part where p_type = 'PROMO'")
def set_except(read):
    return read("part").select("p_partkey").subtract(read("lineitem").where("l_quantity > 48").select("l_partkey")).subtract(read("part").where("p_type = 'PROMO'").select("p_partkey"))


@query("set_twins", "with m as (select distinct l_linenumber * 10 + cast(l_quantity as integer) % 10 g, l_partkey i from lineitem), s as (select g, count(*) n from m group by 1), b as (select x.g a, y.g b, count(*) c from m x join m y using (i) where x.g < y.g group by 1, 2) select a, b, round(c / (p.n + q.n - c)::double, 7) jaccard from b join s p on p.g = a join s q on q.g = b where least(p.n, q.n) * 10 >= greatest(p.n, q.n) * 2 and c / (p.n + q.n - c)::double >= 0.2")
def set_twins(read):
    """Groups (a line number and the last digit of a quantity) by the parts that they share."""
    m = read("lineitem").select((F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 10).alias("g"), F.col("l_partkey").alias("i")).distinct()
    s = m.groupBy("g").agg(count())
    b = m.select(F.col("g").alias("a"), "i").join(m.select(F.col("g").alias("b"), "i"), "i").where("a < b").groupBy("a", "b").agg(count("c"))
    b = b.join(s.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(s.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    j = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return b.where((F.least("na", "nb") * 10 >= F.greatest("na", "nb") * 2) & (j >= 0.2)).select("a", "b", F.round(j, 7).alias("jaccard"))


EDITS = """ed as (select event_id, user_id oid, cast(event_id % 30 as bigint) gid, case event_type when 'click' then 'add' when 'view' then 'remove' when 'error' then 'nofit' when 'signup' then 'clear' else 'add' end as action, ts from events),
last as (select oid, gid, action from ed qualify row_number() over (partition by oid, gid order by ts desc, event_id desc) = 1), cur as (select * from last where action <> 'clear'),
mem as (select c_custkey oid, c_nationkey::bigint gid from customer)"""


def edit_log(read):
    kinds = F.when(F.col("event_type") == "view", "remove").when(F.col("event_type") == "error", "nofit").when(F.col("event_type") == "signup", "clear").otherwise("add")
    log = read("events").select("event_id", F.col("user_id").alias("oid"), (F.col("event_id") % 30).alias("gid"), kinds.alias("action"), "ts")
    members = read("customer").select(F.col("c_custkey").alias("oid"), F.col("c_nationkey").cast("long").alias("gid"))
    return E.latest(log, ["oid", "gid"], ["ts", "event_id"]), members


@query("edit_apply", f"with {EDITS} select oid, gid, action from cur")
def edit_apply(read):
    return edit_log(read)[0].select("oid", "gid", "action")


RESOLVED = EDITS + ", res as (select c.oid, c.gid, action, case when c.oid not in (select oid from mem) or c.gid not in (select gid from mem) then 'orphan' when action = 'add' and m.oid is not null then 'redundant' when action = 'remove' and m.oid is null then 'stale' when action = 'nofit' then 'mark' else action end state from cur c left join mem m on m.oid = c.oid and m.gid = c.gid)"


@query("edit_resolve", f"with {RESOLVED} select oid, gid, action, state from res")
def edit_resolve(read):
    log, members = edit_log(read)
    return E.resolve(log.select("oid", "gid", "action"), members, members, members)


@query("edit_effective", f"with {RESOLVED} select oid, gid from mem where (oid, gid) not in (select (oid, gid) from res where state = 'remove') union select oid, gid from res where state = 'add'")
def edit_effective(read):
    log, members = edit_log(read)
    return E.effective(members, E.resolve(log.select("oid", "gid", "action"), members, members, members))


BATCH = "b as (select strftime(ts, '%Y-%m-%d ') || (hour(ts) // 6) batch, user_id oid, event_id % 4 gid, value / 100 score from events)"


@query("batch_apply", f"with {BATCH} select batch, oid, gid, case when count(*) over (partition by batch) > 100 then 'too many' when count(*) over (partition by batch, oid, gid) > 1 then 'duplicate' when oid not in (select c_custkey from customer) then 'unknown' when not coalesce(score between 0 and 1, false) then 'score' end as error from b qualify error is not null")
def batch_apply(read):
    """A quarter of a day is a batch."""
    when = F.concat(F.date_format("ts", "yyyy-MM-dd "), F.floor(F.hour("ts") / 6).cast("string"))
    batch = read("events").select(when.alias("batch"), F.col("user_id").alias("oid"), (F.col("event_id") % 4).alias("gid"), (F.col("value") / 100).alias("score"))
    return E.batch_errors(batch, read("customer").select(F.col("c_custkey").alias("oid")), by=("batch",))


@query("batch_rows", "select event_id, case when value >= 50 then 'tick' when value >= 20 then 'review' when value is null then 'none' else 'below' end state from events")
def batch_rows(read):
    state = F.when(F.col("value") >= 50, "tick").when(F.col("value") >= 20, "review").when(F.col("value").isNull(), "none").otherwise("below")
    return read("events").select("event_id", state.alias("state"))


@query("suggested_visible", f"with {RESOLVED} select event_id from events e where value >= 20 and (user_id, event_id % 30) not in (select (oid, gid) from res where state = 'mark')")
def suggested_visible(read):
    log, members = edit_log(read)
    hidden = E.resolve(log.select("oid", "gid", "action"), members, members, members).where("state = 'mark'").select(F.col("oid").alias("user_id"), "gid")
    return read("events").where("value >= 20").withColumn("gid", F.col("event_id") % 30).join(hidden, ["user_id", "gid"], "left_anti").select("event_id")


@query("overlay_replace", "select p_partkey, case when p_partkey % 10 = 0 then upper(p_name) else p_name end p_name from part")
def overlay_replace(read):
    over = read("part").where("p_partkey % 10 = 0").select("p_partkey", F.upper("p_name").alias("p_name"))
    return R.overlay_replace(read("part").select("p_partkey", "p_name"), over, "p_partkey")


@query("sink_yaml_preserving", "select n_nationkey, case when n_nationkey % 3 = 0 then 'kept ' || n_name else n_name end n_name from nation")
def sink_yaml_preserving(read):
    old = read("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("kept "), "n_name")).otherwise("").alias("n_name"))
    return R.overlay_replace(read("nation").select("n_nationkey", "n_name"), old.withColumn("n_name", F.nullif("n_name", F.lit(""))), "n_nationkey")


@query("phrase_override", "select s_suppkey, coalesce(nullif(case when s_suppkey % 4 = 0 then 'own' when s_suppkey % 4 = 1 then '' end, ''), s_name) phrase from supplier")
def phrase_override(read):
    own = read("supplier").select("s_suppkey", F.nullif(F.when(F.col("s_suppkey") % 4 == 0, "own").when(F.col("s_suppkey") % 4 == 1, ""), F.lit("")).alias("s_name"))
    return R.overlay_replace(read("supplier").select("s_suppkey", "s_name"), own, "s_suppkey").withColumnRenamed("s_name", "phrase")


@query("report_tables", "select l_returnflag, count(*) filter (l_linestatus = 'F') as \"F\", count(*) filter (l_linestatus = 'O') as \"O\" from lineitem group by 1")
def report_tables(read):
    return read("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))


@query("name_checks", "select p_name, count(*) n from part group by 1 having count(*) > 1")
def name_checks(read):
    return read("part").groupBy("p_name").agg(count()).where("n > 1")


@query("real_word_list", "select distinct w as word from (select unnest(string_split(p_name, ' ')) w from part union all select lower(c_mktsegment) from customer)")
def real_word_list(read):
    return read("part").select(F.explode(F.split("p_name", " ")).alias("word")).union(read("customer").select(F.lower("c_mktsegment"))).distinct()
