"""Queries over sources and sinks, streams, group search, names and suggestions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from ..operators import groupsearch, search, suggest
from ..operators import similarity as S
from ..sources import files
from ..streaming import log
from .registry import query
from .text_queries import NAMES, PAIRS, names

count = lambda name="n": F.count(F.lit(1)).alias(name)


@query("scan_json_lines_gz", "select p_partkey, p_name from part")
def scan_json_lines_gz(read):
    part = read("part").select("p_partkey", "p_name")
    path = files.shared_folder(part.sparkSession)
    part.write.option("compression", "gzip").json(path)
    return files.scan_json_lines(part.sparkSession, path, "p_partkey long, p_name string", "p_partkey")


@query("scan_json_object", "select lower(n_name) as key, n_nationkey, n_regionkey from nation")
def scan_json_object(read):
    nation = read("nation").select(F.lower("n_name").alias("key"), F.struct("n_nationkey", "n_regionkey").alias("v"))
    path = files.shared_folder(nation.sparkSession)
    nation.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "v")))).alias("value")).coalesce(1).write.text(path)
    return files.scan_json_object(nation.sparkSession, f"{path}/part-*", {"n_nationkey": "int", "n_regionkey": "int"})


@query("scan_json_array_tolerant", "select s_suppkey, s_name from supplier")
def scan_json_array_tolerant(read):
    supplier = read("supplier").select(F.concat(F.lit("  "), F.to_json(F.struct("s_suppkey", "s_name")), F.lit(",")).alias("value"))
    path = files.shared_folder(supplier.sparkSession)
    edge = lambda x: supplier.sparkSession.range(1).select(F.lit(x).alias("value"))
    edge("[").union(supplier).union(edge("]")).write.text(path)
    return files.scan_json_array(supplier.sparkSession, path, "s_suppkey long, s_name string")


@query("scan_yaml", "select r_regionkey, r_name from region")
def scan_yaml(read):
    region = read("region").select(F.concat(F.lit("- r_regionkey: "), F.col("r_regionkey").cast("string"), F.lit("\n  r_name: "), "r_name").alias("value"))
    path = files.shared_folder(region.sparkSession)
    region.coalesce(1).write.text(path)
    return files.scan_yaml(region.sparkSession, f"{path}/part-*", "r_regionkey int, r_name string")


@query("shard_files", "select c_custkey, c_name from customer")
def shard_files(read):
    customer = read("customer").select("c_custkey", "c_name")
    path = files.shared_folder(customer.sparkSession)
    files.write_shards(customer, path, "c_custkey", 8)
    return customer.sparkSession.read.parquet(path).select("c_custkey", "c_name")


@query("static_export", "select p_partkey from part where not starts_with(p_name, 'red') and not starts_with(p_name, 'blue')")
def static_export(read):
    manifest = read("part").sparkSession.createDataFrame([("red", True), ("blue", True), ("old", False)], "prefix string, public boolean")
    return files.unclassified(read("part").withColumnRenamed("p_name", "path"), manifest).select("p_partkey")


@query("normalize_card", "select c_custkey, coalesce(nullif(case when c_custkey % 2 = 0 then c_name else '' end, ''), c_mktsegment || chr(10) || c_name) as text from customer")
def normalize_card(read):
    faces = F.array("c_mktsegment", "c_name")
    own = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    return read("customer").select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), F.array_join(faces, "\n")).alias("text"))


@query("http_bulk_source", "select * from labels")
def http_bulk_source(read):
    """A cached bulk file stands for the download, which needs a network: read once, written whole, read again."""
    labels = read("labels")
    path = files.shared_folder(labels.sparkSession)
    labels.write.parquet(path)
    return labels.sparkSession.read.parquet(path)


@query("log_upsert", "select event_type, count(*) searches, count(*) filter (value < 5) zero from events group by 1")
def log_upsert(read):
    events = read("events")
    stream = log.log_stream(events.sparkSession, _folder(events), events.schema)
    return log.drain(log.upsert_counts(stream), "complete", files.shared_folder(events.sparkSession)).select("event_type", "searches", "zero")


@query("log_windows", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') start, event_type, count(*) n, round(sum(value), 4) v from events group by 1, 2, time_bucket(interval 1 hour, ts) having time_bucket(interval 1 hour, ts) + interval 70 minutes <= (select max(ts) from events)")
def log_windows(read):
    """Windows that the watermark has closed: those that end ten minutes or more before the last event."""
    events = read("events")
    stream = log.log_stream(events.sparkSession, _folder(events), events.schema)
    found = log.drain(log.windowed_counts(stream), "append", files.shared_folder(events.sparkSession))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


def _folder(df) -> str:
    """The folder of files a stream reads, made from a table."""
    path = files.shared_folder(df.sparkSession)
    df.write.parquet(path)
    return path


#: Words of the made-up groups, and what is asked of them.
FIRST = ["Draws", "Destroyed", "Flashback", "Token", "Sacrifice", "Red", "Counter"]
SECOND = ["creatures", "spell", "lands", "artifact", "card", "ring", "bolts", "gear", "frame", "widget", "block"]
ASKED = ["token ring", "draw", "red of", "flash", "flash ring", "destroying creature spell", "quick lands", "quick ring", "fast gear", "fast", "way card quickly", "ring flash", "family counter", "tokne rign", "draws special", "red ring zzzzz", "counter card block", "quick", "example red", "to", "sacrific", "x"]


def named_groups(read):
    """Pages as groups whose names, slugs and descriptions are made of their ids."""
    i = F.col("page_id")
    of = lambda words, k: F.get(F.lit(words), (k % len(words)).cast("int"))
    part = lambda d: F.floor(i / d)
    name = F.concat(of(FIRST, i), F.lit(" "), of(SECOND, i), F.when(i % 3 == 0, F.concat(F.lit(" of "), of(SECOND, part(7)))).otherwise(""), F.when(i % 5 == 0, " — not recorded").otherwise(""))
    return read("pages").select(
        i.alias("gid"), name.alias("name"), F.when(i % 4 == 0, F.array(F.concat(of(FIRST, part(3)), F.lit(" special")))).alias("extras"), F.when(i % 6 == 0, F.concat(F.lit("fast-"), of(SECOND, i))).alias("slug"),
        F.concat(F.lit("Family "), of(FIRST, part(11))).alias("path"), F.when(i % 8 == 0, F.concat(F.lit("Example "), of(FIRST, part(2)))).otherwise(F.concat(F.lit("Ways to "), of(SECOND, part(2)), F.lit(" quickly"))).alias("description"),
        (i % 8 == 0).alias("draft"), of(list("lktoch"), i).alias("layer"), (i % 50).alias("size"), (i % 9 == 0).alias("auto"), (part(2) % 2).alias("placed"),
    )


def phrases(read):
    """Every tenth group answers to a quick phrase; odd tens to one by hand, even ones to a drafted one."""
    i = F.col("page_id")
    word = F.get(F.lit(SECOND), (i % len(SECOND)).cast("int"))
    return read("pages").where("page_id % 10 = 1").select(F.concat(F.lit("quick "), word).alias("phrase"), i.alias("gid"), i.alias("place"), (i % 20 == 1).alias("hand"))


def found_groups(read):
    pages = read("pages")
    ask = pages.sparkSession.createDataFrame(list(enumerate(ASKED)), "qid int, text string")
    real = pages.sparkSession.createDataFrame([("zzzzz",), ("fast",), ("flash",)], "word string")
    return groupsearch.search(groupsearch.build(named_groups(read), phrases(read)), ask, real)


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _stem(w):
    return f"(case when length({w}) > 4 and regexp_matches({w}, 'ies$') then {w}[:-4] || 'y' when length({w}) > 4 and regexp_matches({w}, '(ss|x|z|ch|sh)es$') then {w}[:-3] when length({w}) > 3 and regexp_matches({w}, 's$') and not regexp_matches({w}, '(ss|us|is)$') then {w}[:-2] else {w} end)"


def _fold(x):
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_STOP = _list(groupsearch.STOP)
#: The search as joins of rows: tokens of queries, words of names by place, and what a token is to a word.
SEARCHED = rf"""
e as (select page_id gid, {_list(FIRST)}[page_id % 7 + 1] || ' ' || {_list(SECOND)}[page_id % 11 + 1] || case when page_id % 3 = 0 then ' of ' || {_list(SECOND)}[(page_id // 7) % 11 + 1] else '' end || case when page_id % 5 = 0 then ' — not recorded' else '' end as name,
 case when page_id % 4 = 0 then {_list(FIRST)}[(page_id // 3) % 7 + 1] || ' special' end extra, case when page_id % 6 = 0 then 'fast-' || {_list(SECOND)}[page_id % 11 + 1] end slug, 'Family ' || {_list(FIRST)}[(page_id // 11) % 7 + 1] path,
 case when page_id % 8 = 0 then 'Example ' || {_list(FIRST)}[(page_id // 2) % 7 + 1] else 'Ways to ' || {_list(SECOND)}[(page_id // 2) % 11 + 1] || ' quickly' end description, page_id % 8 = 0 draft, 'lktoch'[page_id % 6 + 1] layer, (page_id // 2) % 2 placed from pages),
al as (select 'quick ' || {_list(SECOND)}[page_id % 11 + 1] phrase, page_id gid, page_id place, page_id % 20 = 1 hand from pages where page_id % 10 = 1),
nm as (select gid, 'n' f, 0 v, name x from e union all select gid, 'n', 1, extra from e where extra is not null union all select gid, 's', 0, slug from e where slug is not null union all select gid, 'd', 0, description from e union all select gid, 'p', 0, path from e),
nw as (select gid, f, v, j - 1 j, {_stem('w')} w from (select gid, f, v, unnest(string_split({_fold('x')}, ' ')) w, unnest(range(1, len(string_split({_fold('x')}, ' ')) + 1)) j from nm) where f <> 'd' or not list_contains({_STOP}, {_stem('w')})),
nk as (select gid, f, v, string_agg(w, ' ' order by j) k, count(*) n from nw group by 1, 2, 3), ck as (select gid, v, string_agg({_stem('w')}, ' ' order by j) k from (select gid, v, unnest(string_split({_fold("regexp_replace(x, ' — .*$', '')")}, ' ')) w, unnest(range(9)) j from nm where f = 'n') where w is not null group by 1, 2),
gt as (select distinct unnest(string_split({_fold('x')}, ' ')) t from (select name x from e union all select slug from e union all select phrase from al)), gw as (select t, count(*) n from (select unnest(string_split({_fold('x')}, ' ')) t from (select name x from e union all select slug from e where slug is not null union all select distinct phrase from al)) where length(t) >= 3 group by 1),
gs as (select distinct {_stem('t')} s from gw),
ak as (select distinct phrase, string_split({_fold('phrase')}, ' ') ws from al), kk as (select distinct phrase, array_to_string(list_transform(string_split({_fold('phrase')}, ' '), lambda z: {_stem('z')}), ' ') k from al),
q0 as (select unnest(range({len(ASKED)})) qid, unnest({_list(ASKED)}) q), q1 as (select * from q0 where length(q) >= 2),
{{rounds}},
allr as (select *, null::varchar meant from r1 union all select r2.* exclude (q), q meant from (select r2.*, q from r2 join again using (qid)) r2 where section = 'groups' and (tier <= 4.5 or tier = 4.9) and not exists (select 1 from r1 where r1.qid = r2.qid and r1.gid = r2.gid and r1.section = 'groups'))"""


def _round(k, source):
    """One literal search of the queries (qid, q) of a table."""
    return rf"""
tk{k} as (select qid, j - 1 pos, w, {_stem('w')} s, list_contains({_STOP}, w) stop from (select qid, unnest(string_split(q, ' ')) w, unnest(range(1, len(string_split(q, ' ')) + 1)) j from {source})),
tv{k} as (select *, s in (select s from gs) own, w in ('zzzzz', 'fast', 'flash') or s in ('zzzzz', 'fast', 'flash') real, case when s in (select s from gs) then [s] when length(s) > 5 and regexp_matches(s, 'ing$') then [s, s[:-4]] when length(s) > 4 and regexp_matches(s, 'ed$') then [s, s[:-3]] else [s] end vs from tk{k}),
qa{k} as (select qid, string_agg(s, ' ' order by pos) k, count(*) n, bool_and(stop) stops, max(pos) last from tv{k} group by 1), tc{k} as (select tv.*, a.n, a.last, not tv.stop or a.stops core from tv{k} tv join qa{k} a using (qid)), qn{k} as (select qid, count(*) filter (core) n, max(length(w)) filter (core) ml from tc{k} group by 1),
mt{k} as (select distinct t.qid, t.pos, t.core, t.last, t.own or t.real whole, d.w, list_contains(t.vs, d.w) eq, list_contains(t.vs, d.w) or len(list_filter(t.vs, lambda x: length(x) >= 3 and starts_with(d.w, x))) > 0 pre,
 len(list_filter(t.vs, lambda x: starts_with(d.w, x) and (regexp_matches(d.w[length(x) + 1:], '^(s|es|ed|d|ing|er|ers|ings)?$') or (d.w[length(x) + 1] = x[-1] and regexp_matches(d.w[length(x) + 2:], '^(s|es|ed|d|ing|er|ers|ings)?$'))))) > 0 same from tc{k} t, (select distinct w from nw union select distinct unnest(string_split({_fold('phrase')}, ' ')) from al) d),
hit{k} as (select m.qid, gid, f, v, count(distinct pos) filter (core and pre) loose, count(distinct pos) filter (core and eq) exact, count(distinct pos) filter (core and case when whole then same else pre end) strict, count(distinct pos) filter (pos = j and case when pos = last then pre else eq end) ord, count(distinct pos) filter (pos = j and case when whole then same when pos = last then pre else eq end) ordw
 from nw join mt{k} m using (w) group by 1, 2, 3, 4),
fd{k} as (select h.qid, h.gid, max((f = 'n' and ord = a.n)::int) st, max((f = 'n' and ordw = a.n)::int) stw, max((f = 'n' and loose = c.n)::int) al, max((f = 'n' and strict = c.n)::int) alw, max((f = 'n' and c.n >= 3 and loose >= c.n - 1)::int) mo, max((f = 's' and loose = c.n)::int) sl, max((f = 'd' and exact = c.n and ml >= 3)::int) de, max((f = 'p' and loose = c.n)::int) pa
 from hit{k} h join qa{k} a using (qid) join qn{k} c using (qid) group by 1, 2),
eq{k} as (select qid, gid, 0.0 tier, 'name' why, '' via, 0 place from qa{k} a join (select gid, k from nk where f = 'n' union select gid, k from ck) using (k) union select qid, gid, 1.0, 'slug', '', 50 from qa{k} a join nk using (k) where f = 's'),
en{k} as (select qid, gid, case when st = 1 then case when stw = 1 then 2.0 when alw = 1 then 3.0 else 3.1 end when al = 1 then case when alw = 1 then 3.0 else 3.2 end when mo = 1 then 3.5 when sl = 1 then 4.0 when de = 1 then 5.0 when pa = 1 then 6.0 end tier,
 case when st = 1 or al = 1 then 'name' when mo = 1 then 'most' when sl = 1 then 'slug' when de = 1 then 'description' when pa = 1 then 'family' end why, '' via, 0 place from fd{k}),
ap{k} as (select m.qid, phrase from (select phrase, unnest(ws) w0 from ak) x, lateral (select {_stem('w0')} w) y join mt{k} m using (w) join qn{k} c using (qid) where core and pre group by m.qid, phrase having count(distinct pos) = any_value(c.n)),
au{k} as (select qid, gid, case when hand then 1.0 else 4.5 end tier, 'alias' why, phrase via, place from qa{k} join kk using (k) join al using (phrase) union all select ap.qid, gid, 4.0, 'alias', phrase, 0 from ap{k} ap join al using (phrase) join kk using (phrase) join qa{k} a on a.qid = ap.qid where hand and kk.k <> a.k),
b{k} as (select * from (select * from eq{k} union all select * from en{k} where tier is not null union all select * from au{k}) qualify row_number() over (partition by qid, gid order by tier, place, case when why = 'alias' and tier = 4 then 1 else 0 end, via, why) = 1),
r{k} as (select qid, gid, name, case when layer = 'h' and placed = 0 and tier >= 2 and tier < 4.9 and why <> 'family' then 4.9 else tier end::double tier, why, via, case when why = 'family' then 'family' when why = 'description' and draft and starts_with(description, 'Example') then 'example' else 'groups' end section from b{k} join e using (gid))"""


_AGAIN = """
few as (select qid from q1 where (select count(*) from r1 where r1.qid = q1.qid and section = 'groups' and (tier <= 4.5 or tier = 4.9)) < 3),
od as (select distinct w from tv1 where qid in (select qid from few) and length(w) >= 4 and not stop and not real and not regexp_matches(w, '[0-9]') and not exists (select 1 from gs where list_contains(vs, s)) and not exists (select 1 from gw where starts_with(gw.t, tv1.w))),
nr as (select w, t from (select w, t, n, damerau_levenshtein(w, t) d from od, gw where abs(length(w) - length(t)) <= case when length(w) <= 7 then 1 else 2 end and (w[1] = t[1] or (w[1] = t[2] and w[2] = t[1]))) where d <= case when length(w) <= 7 then 1 else 2 end qualify row_number() over (partition by w order by d, n desc, t) = 1),
again as (select qid, string_agg(coalesce(t, w), ' ' order by pos) q from tv1 left join nr using (w) where qid in (select qid from few) group by qid having bool_or(t is not null))"""
SEARCHED = SEARCHED.replace("{rounds}", _round(1, "q1") + "," + _AGAIN + "," + _round(2, "again"))


@query("group_search", f"with {SEARCHED} select qid::integer qid, section, gid, name, tier, why, via, meant from allr")
def group_search(read):
    """Groups met by each of the queries asked, with every tier."""
    return found_groups(read).select("qid", "section", "gid", "name", "tier", "why", "via", "meant")


@query("search_tiers", f"with {SEARCHED} select qid::integer qid, section, tier, why, count(*) n from allr group by all")
def search_tiers(read):
    return found_groups(read).groupBy("qid", "section", "tier", "why").agg(count())


@query("did_you_mean", """with q as (select unnest(['rign', 'smal', 'gaer', 'widgte', 'blot', 'zzzz']) word), v as (select term, count(*) n from (select unnest(string_split(p_name, ' ')) term from part) group by 1),
c as (select word, term, n, damerau_levenshtein(word, term)::integer d from q, v where word not in (select term from v) and abs(length(word) - length(term)) <= if(length(word) <= 7, 1, 2) and (word[1] = term[1] or (word[1] = term[2] and word[2] = term[1])))
select word, term as suggestion, d from c where d <= if(length(word) <= 7, 1, 2) qualify row_number() over (partition by word order by d, n desc, term) = 1""")
def did_you_mean(read):
    v = read("part").select(F.explode(F.split("p_name", " ")).alias("term")).groupBy("term").agg(count())
    q = v.sparkSession.createDataFrame([(w,) for w in ("rign", "smal", "gaer", "widgte", "blot", "zzzz")], "word string")
    return search.did_you_mean(q, v)


@query("find_card", "select p_partkey as id, p_name as name, case when p_name = 'ring' then 0 when starts_with(p_name, 'ring') then 1 when contains(' ' || p_name, ' ring') then 2 else 3 end::integer tier from part where contains(p_name, 'ring') order by tier, length(p_name), name, id limit 40")
def find_card(read):
    return search.find_name(read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "ring")


@query("find_card_sides", """with n as (select p_partkey id, p_name as name, [p_name || ' of ' || p_brand, p_type] faces, p_size % 5 = 0 other from part),
t as (select id, name, other, case when name in ('red ring', 'hot gear') or list_contains(list_transform(faces, lambda f: trim(regexp_replace(lower(f), '[^a-z0-9]+', ' ', 'g'))), 'hot gear') then 4 end::integer tier from n) select id, name, other, tier from t where tier is not null order by other, length(name), name, id limit 40""")
def find_card_sides(read):
    """Both sides of a double name, each under its own name; what is no card last."""
    n = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat("p_name", F.lit(" of "), "p_brand"), "p_type").alias("faces"), (F.col("p_size") % 5 == 0).alias("other"))
    return search.find_name(n, "Red Ring // hot gear")


@query("limit_search", "select p_partkey as id, p_name as name, 1::integer tier from part where starts_with(p_name, 'red ') order by length(p_name), name, id limit 7")
def limit_search(read):
    return search.find_name(read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "red", 7)


@query("face_supplement", "with f as (select n_nationkey id, unnest([n_name, 'Back ' || n_name]) face from nation) select id, min(case when lower(face) = 'nation_1' then 0 when starts_with(lower(face), 'nation_1') then 1 else 2 end)::integer as rank from f where contains(lower(face), 'nation_1') group by 1 order by rank, id limit 6")
def face_supplement(read):
    f = read("nation").select(F.col("n_nationkey").alias("id"), F.explode(F.array(F.lower("n_name"), F.lower(F.concat(F.lit("Back "), "n_name")))).alias("face"))
    rank = F.when(F.col("face") == "nation_1", 0).when(F.col("face").startswith("nation_1"), 1).otherwise(2)
    return f.where(F.contains("face", F.lit("nation_1"))).groupBy("id").agg(F.min(rank).alias("rank")).orderBy("rank", "id").limit(6)


@query("faces_fold", "select p_partkey, string_split(p_name, ' ')[1] front, string_split(p_name, ' ')[2] back from part")
def faces_fold(read):
    faces = F.split(F.replace("p_name", F.lit(" "), F.lit(" // ")), " // ")
    return read("part").select("p_partkey", faces[0].alias("front"), faces[1].alias("back"))


@query("alias_validate", "with a as (select unnest(['red ring', 'old gear', 'nothing here']) phrase), g as (select distinct p_name from part) select phrase from a where phrase not in (select p_name from g)")
def alias_validate(read):
    a = read("part").sparkSession.createDataFrame([("red ring",), ("old gear",), ("nothing here",)], "phrase string")
    return R.missing_keys(a, read("part").select(F.col("p_name").alias("phrase")), "phrase")


@query("alias_draft", "with m as (select p_brand g, p_partkey i from part), t as (select unnest(string_split(p_name, ' ')) t, p_partkey i from part), b as (select g, t, count(*) c from m join t using (i) group by 1, 2), gs as (select g, count(*) n from m group by 1), ts as (select t, count(*) n from t group by 1) select g, t, round(2.0::double * c / (gs.n + ts.n), 7) f1 from b join gs using (g) join ts using (t) where 2.0 * c / (gs.n + ts.n) >= 0.1")
def alias_draft(read):
    m = read("part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("i"))
    t = read("part").select(F.explode(F.split("p_name", " ")).alias("t"), F.col("p_partkey").alias("i"))
    b = m.join(t, "i").groupBy("g", "t").agg(count("c")).join(m.groupBy("g").agg(count("ng")), "g").join(t.groupBy("t").agg(count("nt")), "t")
    f1 = 2.0 * F.col("c") / (F.col("ng") + F.col("nt"))
    return b.where(f1 >= 0.1).select("g", "t", F.round(f1, 7).alias("f1"))


@query("card_pin", "with c as (select l_partkey item, l_suppkey grp, case l_returnflag when 'A' then 0.0::double when 'N' then 0.5 else 1.2 end cls, l_linenumber o from lineitem) select item, arg_min(grp, (cls, o, grp)) grp from c group by 1")
def card_pin(read):
    cls = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(1.2)
    return read("lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min_by("l_suppkey", F.struct(cls.alias("c"), "l_linenumber", "l_suppkey")).alias("grp"))


@query("query_match_block", "select doc_id, sum(length(l) - length(replace(l, chr(10), '')))::bigint as breaks from (select doc_id, text l from documents where regexp_matches(lower(text), '\\bthe\\b.*\\bof\\b')) group by 1")
def query_match_block(read):
    docs = read("documents").where(F.lower("text").rlike(r"\bthe\b.*\bof\b"))
    return docs.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("breaks"))


@query("sig_suggest", f"with {PAIRS} select a, b, round((2 + c) / (2 + x.k + y.k - c)::double, 7) score from c join norm x on x.item = a join norm y on y.item = b where c >= 2")
def sig_suggest(read):
    n = names(read)
    p = S.postings(n, "item", "t")
    c = p.select(F.col("item").alias("a"), "token").join(p.select(F.col("item").alias("b"), "token"), "token").where("a <> b").groupBy("a", "b").agg(count("c")).where("c >= 2")
    k = n.select("item", F.size("t").alias("k"))
    x = c.join(k.select(F.col("item").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("item").alias("b"), F.col("k").alias("kb")), "b")
    return x.select("a", "b", F.round((2 + F.col("c")) / (2 + F.col("ka") + F.col("kb") - F.col("c")), 7).alias("score"))


@query("kw_suggest", "with k as (select p_partkey, unnest(string_split(p_name, ' ')) w from part) select p_partkey, w || ' block' as block from k where w in ('ring', 'gear', 'bolt')")
def kw_suggest(read):
    blocks = read("part").sparkSession.createDataFrame([(w, f"{w} block") for w in ("ring", "gear", "bolt")], "w string, block string")
    return read("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).join(F.broadcast(blocks), "w").select("p_partkey", "block")


@query("suggestion_merge", "with a as (select l_partkey i, l_suppkey g, max(l_discount * 10) s from lineitem group by 1, 2), r as (select l_partkey i, l_suppkey g, max(l_tax * 10) s from lineitem where l_returnflag = 'R' group by 1, 2) select i, g, round(least(1.0, greatest(coalesce(a.s, 0), coalesce(r.s, 0)) + case when a.s is not null and r.s is not null then 0.1 else 0 end), 7)::double score from a full join r using (i, g)")
def suggestion_merge(read):
    key = [F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("g")]
    a = read("lineitem").groupBy(*key).agg(F.max(F.col("l_discount") * 10).alias("a"))
    r = read("lineitem").where("l_returnflag = 'R'").groupBy(*key).agg(F.max(F.col("l_tax") * 10).alias("r"))
    both = F.when(F.col("a").isNotNull() & F.col("r").isNotNull(), 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("r", F.lit(0.0))) + both)
    return a.join(r, ["i", "g"], "full").select("i", "g", F.round(score, 7).alias("score"))


WORDS = "[a-zàâçèéêëîïôöùûüñáíóúß]+"  # of the titles
TITLED = f"""pg as (select page_id, regexp_extract(url, '://([^/?#]*)', 1) gid, regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '{WORDS}') w from pages),
big as (select gid, count(distinct page_id) size from pg group by 1 having count(*) >= 5), mem as (select * from pg join big using (gid)),
ask as (select * from pg where page_id % 50 = 0),
doc as (select 0 side, page_id i, w from mem union all select 1, page_id, w from ask),
tok as (select side, i, unnest(list_concat(w, [w[x] || ' ' || w[x + 1] for x in range(1, len(w))])) t from doc), tf as (select side, i, t, count(*) c from tok group by all),
idf as (select t, ln((1 + (select count(*) from doc))::double / (1 + count(*))) + 1 v from tf group by 1 having count(*) >= 2),
wt as (select side, i, t, (1 + ln(c)) * v x from tf join idf using (t)), un as (select side, i, t, x / sqrt(sum(x * x) over (partition by side, i)) x from wt),
dot as (select a.i q, b.i line, round(sum(a.x * b.x), 9) s from un a join un b using (t) where a.side = 1 and b.side = 0 group by 1, 2),
sim as (select ask.page_id q, mem.page_id line, mem.gid, mem.size, case when ask.page_id = mem.page_id then -1.0 else coalesce(s, 0.0)::double end s from ask cross join mem left join dot on q = ask.page_id and line = mem.page_id),
mx as (select q, gid, any_value(size) size, max(s) best from sim group by 1, 2), tp as (select * from sim where s > 0 qualify row_number() over (partition by q order by s desc, line) <= 25),
ms as (select q, gid, sum(s * s) m from tp group by 1, 2), al as (select mx.q, mx.gid, best, coalesce(m, 0) / pow(size, 0.25) m from mx left join ms on ms.q = mx.q and ms.gid = mx.gid),
z as (select q, gid, (best - avg(best) over p) / (stddev_pop(best) over p + 1e-9) + (m - avg(m) over p) / (stddev_pop(m) over p + 1e-9) score from al window p as (partition by q)),
held as (select ask.page_id q, ask.gid from ask where len(w) < 6)"""


def titled(read):
    """Titles of pages as lines, hosts as groups: page_id, gid, w (words), terms (words and pairs)."""
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    x = read("pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("gid"), F.regexp_extract_all(title, F.lit(WORDS), F.lit(0)).alias("w"))
    return x.withColumn("terms", F.concat("w", text.ngrams(F.col("w"), 2)))


def profiles(read):
    """Lines of the hosts with five pages or more."""
    x = titled(read)
    big = x.groupBy("gid").agg(count()).where("n >= 5").select("gid")
    return x.join(big, "gid").select("gid", F.col("page_id").alias("owner"), F.col("page_id").alias("line"), F.lit(1.0).alias("weight"), "terms")


def asked(read):
    """Every fiftieth page as a query; the host of a short title is held already and not offered."""
    x = titled(read).where("page_id % 50 = 0")
    held = F.when(F.size("w") < 6, F.array("gid")).otherwise(F.expr("cast(array() as array<string>)"))
    return x.select(F.col("page_id").alias("q"), F.col("page_id").alias("owner"), held.alias("excluded"), "terms", F.size("w").alias("n_tokens"), F.lit("text").alias("kind"))


@query("text_suggest", f"with {TITLED} select q, gid, round(score, 5) score, (row_number() over (partition by q order by round(score, 6) desc, gid))::integer place from z where not exists (select 1 from held where held.q = z.q and held.gid = z.gid) qualify row_number() over (partition by q order by round(score, 6) desc, gid) <= 7")
def text_suggest(read):
    """Seven hosts for the title of a page, its own line left out."""
    return suggest.suggestions(profiles(read), asked(read)).withColumn("score", F.round("score", 5))


@query("text_suggest_calibrated")
def text_suggest_calibrated(read):
    """The same by page, with the share of hits that such scores had on at most SAMPLE pages whose host is known, each without its own line."""
    x = titled(read)
    sample = x.orderBy(F.xxhash64("page_id"), "page_id").limit(suggest.SAMPLE)
    known = sample.select(F.col("page_id").alias("q"), F.col("page_id").alias("owner"), F.expr("cast(array() as array<string>)").alias("excluded"), "terms", F.size("w").alias("n_tokens"), F.lit("text").alias("kind"))
    members = profiles(read)
    curves = suggest.calibration(suggest.by_owner(suggest.suggestions(members, known), known), sample.select(F.col("page_id").alias("owner"), "gid"))
    ask = asked(read)
    out = suggest.confident(suggest.by_owner(suggest.suggestions(members, ask), ask), curves)
    return out.select("owner", "gid", F.round("score", 5).alias("score"), "place", F.round("confidence", 5).alias("confidence"))


@query("join_near_dup_name", f"with {PAIRS} select a, b from sim where j >= 0.5 and a < b")
def join_near_dup_name(read):
    return S.jaccard_pairs(names(read), "item", "t").where("jaccard >= 0.5 and a < b").select("a", "b")


@query("browse_draft", "with g as (select distinct p_name from part), k as (select 'gear' w, 'machines' page union all select 'ring', 'jewels') select p_name, coalesce(page, case when p_name like 'red%' then 'colours' end, p_name) page from g left join k on string_split(p_name, ' ')[2] = w")
def browse_draft(read):
    k = read("part").sparkSession.createDataFrame([("gear", "machines"), ("ring", "jewels")], "w string, page string")
    g = read("part").select("p_name").distinct().withColumn("w", F.element_at(F.split("p_name", " "), 2))
    return g.join(F.broadcast(k), "w", "left").select("p_name", F.coalesce("page", F.when(F.col("p_name").startswith("red"), "colours"), "p_name").alias("page"))


@query("modal_entries", "select l_orderkey, list(distinct l_linenumber order by l_linenumber) lines, count(*) n from lineitem group by 1")
def modal_entries(read):
    return read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"), count())


@query("page_members", "select o_orderpriority as page, o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def page_members(read):
    rows = read("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    x = read("orders").where("o_orderstatus = 'P'").join(rows, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("o_orderpriority").alias("page"), "o_orderkey", F.explode("lines").alias("l_linenumber"))


@query("restriction_worklist", "select case when regexp_matches(p_name, 'hot|red') then 'heat' when regexp_matches(p_name, 'small') then 'size' else 'other' end family, count(*) n from part group by 1")
def restriction_worklist(read):
    first, _ = R.first_cause([("heat", F.col("p_name").rlike("hot|red")), ("size", F.col("p_name").rlike("small"))])
    return read("part").groupBy(F.coalesce(first, F.lit("other")).alias("family")).agg(count())


@query("archive_manifest", "select doc_id, sha256(coalesce(text, '')) digest from documents")
def archive_manifest(read):
    return read("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("plain_text_author", "select s_suppkey, case when s_suppkey % 5 = 0 then 'authored' else s_name end plain from supplier")
def plain_text_author(read):
    authored = read("supplier").where("s_suppkey % 5 = 0").select("s_suppkey", F.lit("authored").alias("s_name"))
    return R.overlay_replace(read("supplier").select("s_suppkey", "s_name"), authored, "s_suppkey").withColumnRenamed("s_name", "plain")


@query("hand_group_build", r"select 'rings' as grp, p_partkey from part where p_name like '%ring%' union select 'promo', p_partkey from part where p_type = 'PROMO'")
def hand_group_build(read):
    rings = read("part").where(text.fold(F.col("p_name")).contains("ring")).select(F.lit("rings").alias("grp"), "p_partkey")
    return rings.union(read("part").where("p_type = 'PROMO'").select(F.lit("promo").alias("grp"), "p_partkey")).distinct()


@query("size_condition_drops", "select case when p_size < 10 then 'short' else 'long' end shape, case when p_name like 'old%' then 'old' else 'other' end subtype, count(*) n from part group by 1, 2")
def size_condition_drops(read):
    shape, subtype = F.when(F.col("p_size") < 10, "short").otherwise("long"), F.when(F.col("p_name").startswith("old"), "old").otherwise("other")
    return read("part").groupBy(shape.alias("shape"), subtype.alias("subtype")).agg(count())
