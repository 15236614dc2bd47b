"""Queries over names, clauses, passages, samples and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions import text
from ..operators import relational as R
from ..operators import rules
from ..operators import similarity as S
from ..operators import spans as SP
from ..operators.stored import stored
from .registry import query
from .structure_queries import nearest
from .table_queries import CARDS, cards
from .text_queries import SEARCH, _scores, lines

count = lambda name="n": F.count(F.lit(1)).alias(name)


@query("hand_rule_tag", "select p_partkey from part where p_brand in ('Brand#7', 'Brand#8')")
def hand_rule_tag(read):
    tags = read("part").sparkSession.createDataFrame([("Brand#7",), ("Brand#8",)], "p_brand string")
    return read("part").join(F.broadcast(tags), "p_brand", "left_semi").select("p_partkey")


@query("sort_name", f"with {CARDS} select id from cards order by lower(name), id limit 60")
def sort_name(read):
    return cards(read).orderBy(F.lower("name"), "id").limit(60).select("id")


@query("sample_seeded")
def sample_seeded(read):
    """Forty orders by a seeded hash: the same for every run and partitioning."""
    return read("orders").orderBy(F.xxhash64("o_orderkey", F.lit(20261111)), "o_orderkey").limit(40).select("o_orderkey")


STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TERMS = f"""d as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{text.WORD.replace("'", "''")}'), lambda x: x not in ({STOP})) t from documents), n as (select count(*)::double n from d),
tf as (select doc_id, w, count(*) tf from (select doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) w from d) group by 1, 2),
df as (select w, ln((1 + n) / (1 + count(*))) + 1 idf from tf, n group by w, n), q as (select w, (1 + ln(c)) * idf q from df join (values ('licensed', 2), ('license', 1), ('mit license', 1), ('general public', 1), ('zzzz', 1)) a(w, c) using (w)),
v as (select doc_id, w, (1 + ln(tf)) * idf v, q from tf join df using (w) left join q using (w)),
s as (select doc_id, sum(v * q) / (sqrt(sum(v * v)) * (select sqrt(sum(q * q)) from q)) s from v group by 1)"""


@query("tfidf_sklearn", f"with {TERMS} select doc_id, round(s, 7) s from s where s is not null qualify rank() over (order by round(s, 7) desc) <= 25")
def tfidf_sklearn(read):
    """Words and pairs of words, stopwords left out, against words of licence lines."""
    docs = read("documents").select("doc_id", "text")
    found = S.tfidf_search(docs, "doc_id", text.terms(F.coalesce("text", F.lit(""))), {"licensed": 2, "license": 1, "mit license": 1, "general public": 1, "zzzz": 1})
    ranked = R.competition_rank(stored(found.select(F.col("item").alias("doc_id"), F.col("score").alias("s"))), "s", digits=7).where("rank <= 25")
    return ranked.select("doc_id", F.round("s", 7).alias("s"))


@query("nearest_leaf", "with e as (select vec_id, label, unnest(embedding)::double x, unnest(range(64)) i from embeddings), c as (select label, i, avg(x) m from e group by 1, 2), cn as (select label, sqrt(sum(m * m)) l from c group by 1), en as (select vec_id, sqrt(sum(x * x)) l from e group by 1), s as (select e.vec_id, e.label, c.label leaf, sum(x * m) / (any_value(cn.l) * any_value(en.l)) s from e join c using (i) join cn on cn.label = c.label join en on en.vec_id = e.vec_id group by 1, 2, 3), b as (select vec_id, label, arg_max(leaf, (s, leaf)) leaf from s group by 1, 2) select label, count(*) n, count(*) filter (leaf = label) own from b group by 1")
def nearest_leaf(read):
    return nearest(read).groupBy("label").agg(count(), F.count_if(F.col("leaf") == F.col("label")).alias("own"))


@query("highlight", "select p_partkey, '[' || replace(p_name, ' ', '] [') || ']' as shown from part where p_name = 'red ring'")
def highlight(read):
    shown = P.mark_passages(read("part").select("p_partkey", "p_name"), "p_name", "red rings", "shown")
    return shown.where("shown is not null").select("p_partkey", "shown")


@query("passages")
def passages(read):
    """Lines of documents that hold two words in order, with the shortest such stretch marked."""
    x = lines(read).select("doc_id", "line_no", "line")
    return P.mark_passages(x.where(P.may_hold("line", P.words_of("the of", x.sparkSession))), "line", "the of", "shown").where("shown is not null").select("doc_id", "line_no", "shown")


@query("spans", "select p_partkey, '{' || p_size || '}' as cost, 'When ' || p_name || ' enters' as condition, 'draw a ' || lower(p_type) || ' card.' as effect, 'Activate only once.' as restriction from part")
def spans(read):
    line = F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit("}: When "), "p_name", F.lit(" enters, draw a "), F.lower("p_type"), F.lit(" card. Activate only once."))
    x = read("part").select("p_partkey", line.alias("line"))
    return x.select("p_partkey", *[P.clause(n)("line").alias(n) for n in ("cost", "condition", "effect", "restriction")])


EFFECTS = ["Draw", "Destroy", "GainLife", "Token"]
CLAUSES = ["draw $T cards", "destroy the nearest $W", "gain $T life", "create a small $W token"]
_ONE = "replace(replace({c}, '$T', (n_chars % 7)::varchar), '$W', coalesce(source, 'thing'))"
_CLAUSE = "[" + ", ".join(f"'{c}'" for c in CLAUSES) + "]"


def effect_lines(read):
    """Documents as lines of one or two effects: with a cost, a condition or a restriction, and joined in two ways."""
    i = F.col("doc_id")
    pick = lambda words, k: F.get(F.lit(words), (k % 4).cast("int"))
    fill = lambda c: F.replace(F.replace(c, F.lit("$T"), (F.col("n_chars") % 7).cast("string")), F.lit("$W"), F.coalesce("source", F.lit("thing")))
    a, b = fill(pick(CLAUSES, i)), fill(pick(CLAUSES, F.floor(i / 4)))
    before = F.when(i % 5 == 1, "{2}, Tap it: ").when(i % 5 == 2, "When it enters, ").otherwise("")
    after = F.when(i % 7 == 3, ". Activate only once.").otherwise(".")
    body = F.when(i % 3 == 0, a).when(i % 3 == 1, F.concat(a, F.lit(", then "), b)).otherwise(F.concat(a, F.lit(". If you do, "), b))
    chain = F.when(i % 3 == 0, F.array(pick(EFFECTS, i))).otherwise(F.array(pick(EFFECTS, i), pick(EFFECTS, F.floor(i / 4))))
    bucket = F.when(i % 5 == 1, "abilities").when(i % 5 == 2, "triggers").otherwise("static_abilities")
    return read("documents").select(i.alias("item"), bucket.alias("bucket"), F.concat(before, body, after).alias("line"), chain.alias("chain"), F.coalesce("source", F.lit("thing")).alias("name"))


@query("effect_spans", f"""with x as (select doc_id item, {_ONE.format(c=_CLAUSE + "[doc_id % 4 + 1]")} a, {_ONE.format(c=_CLAUSE + "[(doc_id // 4) % 4 + 1]")} b, case doc_id % 5 when 1 then '{{2}}, Tap it: ' when 2 then 'When it enters, ' else '' end before,
case when doc_id % 7 = 3 then '. Activate only once.' else '.' end after, doc_id % 3 <> 0 and doc_id % 4 <> (doc_id // 4) % 4 parted from documents),
y as (select item, before || case item % 3 when 0 then a when 1 then a || ', then ' || b else a || '. If you do, ' || b end || after as line, length(before) "start", length(before) + length(a) + case when item % 3 = 1 then 0 else 1 end stop, length(before) + case item % 3 when 0 then length(a) when 1 then length(a) + 7 + length(b) else length(a) + 13 + length(b) end + 1 whole, parted, after, before from x)
select item, substring(line, 1, "start") as "before", substring(line, "start" + 1, case when parted then stop else whole end - "start") as own, substring(line, case when parted then stop else whole end + 1) as rest,
list_concat(list_concat(case when before like '%: ' then ['cost'] when before <> '' then ['condition'] else [] end, case when length(after) > 1 then ['restriction'] else [] end), case when parted then ['sub-effect'] else [] end) how0 from y""".replace("list_concat(list_concat(case", "array_to_string(list_concat(list_concat(case").replace("else [] end) how0", "else [] end), ',') how"))
def effect_spans(read):
    """The first effect of each line, by words learned from the lines of one effect; the three parts make up the line."""
    x = effect_lines(read)
    single = x.where("size(chain) = 1 and bucket = 'static_abilities'").select(F.col("chain")[0].alias("effect"), "line", "name")
    y = SP.narrowed(x, stored(SP.learn_anchors(single)))
    piece = lambda a, b: F.substring(F.col("line"), a + 1, b - a)
    how = F.when(F.col("how")[0] == "none", "").otherwise(F.array_join("how", ","))
    return y.select("item", piece(F.lit(0), F.col("start")).alias("before"), piece(F.col("start"), F.col("end")).alias("own"), piece(F.col("end"), F.length("line")).alias("rest"), how.alias("how"))


@query("naming", "select p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' of ' || lower(p_name) || ' by ' || lower(p_brand) || case when count(*) over (partition by p_type, p_name, p_brand) > 1 then ' (' || p_partkey || ')' else '' end as name from part")
def naming(read):
    name = P.leaf_name(F.col("p_type"), {"of": F.col("p_name"), "by": F.col("p_brand")})
    twins = F.count(F.lit(1)).over(Window.partitionBy("p_type", "p_name", "p_brand"))
    return read("part").select("p_partkey", P.disambiguated(name, twins, F.col("p_partkey").cast("string")).alias("name"))


@query("keyword_render", "select p_partkey, case p_size % 3 when 0 then 'Protection from ' || lower(p_type) when 1 then 'Ward {' || p_size || '}' else 'Flying' end as shown from part")
def keyword_render(read):
    m = F.col("p_size") % 3
    name = F.when(m == 0, "Protection").when(m == 1, "Ward").otherwise("Flying")
    payload = F.when(m == 0, F.col("p_type")).when(m == 1, F.col("p_size").cast("string"))
    return read("part").select("p_partkey", P.keyword_text(name, payload).alias("shown"))


@query("image_url", "select s_suppkey, 'normal' as size, 'front' as side, md5(s_name) as id from supplier where s_suppkey % 4 <> 0")
def image_url(read):
    ident = F.md5("s_name")
    first = F.when(F.col("s_suppkey") % 4 == 0, "-").otherwise(F.substring(ident, 1, 1))
    url = F.concat(F.lit("https://images.example.com/normal/front/"), first, F.lit("/"), F.substring(ident, 2, 1), F.lit("/"), ident, F.lit(".jpg?1"))
    part = lambda k: P.per_value(lambda v: (P.image_parts(v) or (None,) * 4)[k])
    x = read("supplier").select("s_suppkey", url.alias("url"))
    return x.select("s_suppkey", part(0)("url").alias("size"), part(1)("url").alias("side"), part(2)("url").alias("id")).where("id is not null")


@query("hashed_ids", "select p_partkey, 'a' || substr(sha1(p_name), 1, 9) leaf, 'g' || substr(sha1(p_brand), 1, 8) grp, md5(p_name) digest from part")
def hashed_ids(read):
    ident = lambda prefix, c, n: F.concat(F.lit(prefix), F.substring(F.sha1(c), 1, n))
    return read("part").select("p_partkey", ident("a", "p_name", 9).alias("leaf"), ident("g", "p_brand", 8).alias("grp"), F.md5("p_name").alias("digest"))


@query("date_text", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where strftime(o_orderdate, '%Y-%m-%d') > '1998-01-01'")
def date_text(read):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read("orders").select("o_orderkey", day.alias("day")).where("day > '1998-01-01'")


@query("parser_overlays", "with a as (select p_partkey id, p_type before from part where p_partkey % 5 <> 0), b as (select p_partkey id, case when p_size > 40 then 'HUGE' else p_type end after from part where p_partkey % 7 <> 0), c as (select case when a.id is null then 'added' when b.id is null then 'lost' when before = after then 'same' else 'moved' end state from a full join b using (id)) select state, count(*) n, state = 'same' as passes from c group by 1")
def parser_overlays(read):
    """Gate of a replacement: every row that differs is classified, and only unchanged ones pass."""
    part = read("part")
    old = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("leaf"))
    new = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, "HUGE").otherwise(F.col("p_type")).alias("leaf"))
    return R.compare_builds(old, new, ["id"], "leaf").groupBy("state").agg(count()).withColumn("passes", F.col("state") == "same")


@query("card_pin_build", "select l_partkey item, bool_or(l_returnflag = 'A') pinned, count(distinct l_suppkey) groups from lineitem group by 1")
def card_pin_build(read):
    return read("lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("pinned"), F.count_distinct("l_suppkey").alias("groups"))


@query("probe_data_loader", "select s_suppkey as gid, s_name as name, count(distinct l_partkey) members, min(p_name) first_member from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey group by 1, 2")
def probe_data_loader(read):
    x = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("gid")).agg(F.count_distinct("l_partkey").alias("members"), F.min("p_name").alias("first_member"))
    return read("supplier").select(F.col("s_suppkey").alias("gid"), F.col("s_name").alias("name")).join(x, "gid").select("gid", "name", "members", "first_member")


@query("describe_card", "select o_orderkey, case o_orderstatus when 'F' then 'placed in ' || o_orderpriority when 'P' then 'only part of it could be read' else 'not placed yet' end as said from orders")
def describe_card(read):
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("placed in "), "o_orderpriority")).when(F.col("o_orderstatus") == "P", "only part of it could be read").otherwise("not placed yet")
    return read("orders").select("o_orderkey", said.alias("said"))


@query("tester_note_check", "with f as (select l_returnflag, round(100.0::double * count(*) / (select count(*) from lineitem), 1) share from lineitem group by 1) select l_returnflag, share, share between 20 and 60 as holds from f")
def tester_note_check(read):
    whole = read("lineitem").agg(count("t"))
    f = read("lineitem").groupBy("l_returnflag").agg(count()).join(F.broadcast(whole)).select("l_returnflag", F.round(100.0 * F.col("n") / F.col("t"), 1).alias("share"))
    return f.withColumn("holds", F.col("share").between(20, 60))


@query("csv_html_pages", "select p_type, '<li>' || string_agg(distinct p_brand, '</li><li>' order by p_brand) || '</li>' as html from part group by 1")
def csv_html_pages(read):
    """The data part of pages: one list of brands per type."""
    items = F.array_join(F.array_sort(F.collect_set("p_brand")), "</li><li>")
    return read("part").groupBy("p_type").agg(F.concat(F.lit("<li>"), items, F.lit("</li>")).alias("html"))


@query("zone_records_by_source")
def zone_records_by_source(read):
    """The full rule table over whole documents, counted by source."""
    found = rules.apply_rules(read("documents"), "doc_id", "text")
    return found.join(read("documents").select(F.col("doc_id").alias("item"), "source"), "item").groupBy("source", "zone", "direction").agg(count(), F.count_if("choice").alias("choices"))


@query("effect_to_cards", "with l as (select distinct doc_id, trim(s, ' ') line from (select doc_id, unnest(string_split(text, chr(10))) s from documents) where trim(s, ' ') <> ''), c as (select line, count(*) docs from l group by 1) select docs, count(*) lines from c group by 1")
def effect_to_cards(read):
    c = lines(read).select("doc_id", "line").distinct().groupBy("line").agg(count("docs"))
    return c.groupBy("docs").agg(count("lines"))


@query("weighted_explain_top", "with names as (select p_name || ' ' || lower(p_type) as item, count(*) n from part group by 1), sets as (select item, list_distinct(regexp_extract_all(item, '[a-z]+')) t from names), post as (select item, unnest(t) tok from sets), df as (select tok, ln((select count(*) from sets) / count(*)::double) idf from post group by 1) select item, arg_max(tok, (idf, tok)) top from post join df using (tok) group by 1")
def weighted_explain_top(read):
    from .text_queries import names

    w = S.weighted(names(read), "item", "t")
    idf = S.idf(names(read), "item", "t").select("token", F.round("idf", 12).alias("idf"))
    return w.join(idf, "token").groupBy("item").agg(F.max_by("token", F.struct("idf", "token")).alias("top"))
