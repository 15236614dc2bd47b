"""Queries over texts: splitting, dedup, tokens, rules, similarity of part names, retrieval over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators import relational as R
from ..operators import phrases, rules, similarity as S
from ..operators.stored import stored
from .registry import query

LINES = """lines as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as line_no, s as line from
 (select doc_id, trim(string_split(text, chr(10))[i], ' ') s, i from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents where text is not null)) where s <> '')"""
NORM = r"trim(regexp_replace(lower(line), '\s+', ' ', 'g'), ' ')"
NAMES = "names as (select p_name || ' ' || lower(p_type) as item, count(*) as n from part group by 1)"
TOKENS = NAMES + ", sets as (select item, n, list_sort(list_distinct(regexp_extract_all(item, '[a-z]+'))) as t from names), post as (select item, unnest(t) tok from sets), df as (select tok, count(*) df, ln((select count(*) from sets) / count(*)::double) idf from post group by 1)"


def lines(read) -> DataFrame:
    docs = read("documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))


def names(read) -> DataFrame:
    """Effects of the card kind: name and type of parts, one row per text."""
    return read("part").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("item")).agg(F.count(F.lit(1)).alias("n")).withColumn("t", text.token_set(F.col("item")))


SPLIT = r"""l as (select id, i, trim(string_split(text, chr(10))[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) s from (select id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from src)),
p as (select id, i, s, list_transform(string_split(s, ','), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) parts, KW as kw from l where s <> ''),
e as (select id, i, unnest(case when regexp_matches(s, '^[•*∙]') then [{'kind': 'bullet', 'effect': trim(regexp_replace(s, '^[•*∙]\s*', ''))}]
 when regexp_matches(lower(s), '^choose (one|two|three|any number).*[-—•]$') then [{'kind': 'lead', 'effect': s}]
 when len(list_filter(parts, lambda x: not list_contains(kw, trim(regexp_replace(lower(x), '\s*\([^)]*\)\s*$', ''))))) = 0 then list_transform(parts, lambda x: {'kind': 'keyword', 'effect': x})
 else [{'kind': 'line', 'effect': s}] end) x, generate_subscripts(case when regexp_matches(s, '^[•*∙]') then [s] when len(list_filter(parts, lambda x: not list_contains(kw, trim(regexp_replace(lower(x), '\s*\([^)]*\)\s*$', ''))))) = 0 then parts else [s] end, 1) j from p)
select id, row_number() over (partition by id order by i, j) - 1 as place, x.kind as kind, x.effect as effect from e""".replace("KW", "[" + ", ".join(f"'{k}'" for k in text.KEYWORDS) + "]")


def effects(source: DataFrame, id: str, body) -> DataFrame:
    pieces = source.select(F.col(id).alias("id"), F.posexplode(text.effects(body)).alias("place", "e"))
    return pieces.select("id", F.col("place").cast("long").alias("place"), "e.kind", "e.effect")


@query("extract_effects", f"with src as (select doc_id id, text from documents), {SPLIT}")
def extract_effects(read):
    return effects(read("documents"), "doc_id", F.col("text"))


@query("split_cards", f"with src as (select p_partkey id, case p_size % 3 when 0 then 'Choose one —' || chr(10) || '• ' || p_name || chr(10) || '*' || p_brand when 1 then 'Flying, First strike (Hits first.), haste' || chr(10) || '  ' || p_name || ', flying' else 'trample' || chr(13) || chr(10) || chr(10) || p_type || '.' end as text from part), {SPLIT}")
def split_cards(read):
    """Card texts of three forms: choices, keyword lines, a keyword before another line."""
    form = F.col("p_size") % 3
    body = (
        F.when(form == 0, F.concat(F.lit("Choose one —\n• "), "p_name", F.lit("\n*"), "p_brand"))
        .when(form == 1, F.concat(F.lit("Flying, First strike (Hits first.), haste\n  "), "p_name", F.lit(", flying")))
        .otherwise(F.concat(F.lit("trample\r\n\n"), "p_type", F.lit(".")))
    )
    return effects(read("part"), "p_partkey", body)


@query("agg_dedup_glossary", f"with {LINES} select 'eff_' || substr(sha1({NORM}), 1, 10) effect_id, arg_min(line, (doc_id, line_no)) raw_text, count(*) occurrence_count, count(distinct doc_id) docs from lines group by 1")
def agg_dedup_glossary(read):
    found = R.dedup_first(lines(read), text.effect_id(F.col("line")), [F.col("doc_id"), F.col("line_no")], "line", "doc_id")
    return found.select("effect_id", "raw_text", "occurrence_count", F.size("owners").cast("long").alias("docs"))


@query("glossary_listing", f"with {LINES} select {NORM} as effect, count(*) n from lines group by 1 having count(*) > 1 order by n desc, effect")
def glossary_listing(read):
    return lines(read).groupBy(text.normalize(F.col("line")).alias("effect")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "effect")


@query("text_normalize", r"select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '-' || p_brand), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ') folded, 'eff_' || substr(sha1(lower(p_name)), 1, 10) effect_id from part")
def text_normalize(read):
    return read("part").select("p_partkey", text.fold(F.concat_ws("-", "p_name", "p_brand")).alias("folded"), text.effect_id(F.col("p_name")).alias("effect_id"))


@query("name_norm", r"select doc_id, trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(strip_accents(replace(text, 'ß', 'ss')), '[^\x00-\x7f]', '', 'g')), '//', ' '), '[^a-z0-9 ]+', '', 'g'), ' +', ' ', 'g'), ' ') as norm from documents")
def name_norm(read):
    return read("documents").select("doc_id", text.fold_marks(F.col("text")).alias("norm"))


@query("sentences", r"with s as (select doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '(\.)\s+|\n+', '\1' || chr(1), 'g'), chr(1))) s from documents) select doc_id, count(*) n from s where trim(s, ' ') <> '' group by 1")
def sentences(read):
    return read("documents").select("doc_id", F.size(text.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("n")).where("n > 0")


@query("tokenise", "with t as (select doc_id, unnest(regexp_extract_all(replace(replace(regexp_replace(lower(coalesce(text, '')), '\\([^()]*\\)', ' ', 'g'), '—', ' '), '’', ''''), '\\{[^}]{1,12}\\}|[+-]?\\d+/[+-]?\\d+|[a-z]+(?:[''-][a-z]+)*|\\d+')) w from documents) select w, count(*) n from t where w not in (" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ") group by 1")
def tokenise(read):
    words = read("documents").select(F.explode(text.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("stemming", "with w as (select distinct unnest(string_split(lower(p_name), ' ')) || e w from part, (values ('s'), ('es'), ('ies'), ('')) v(e)) select w, case when length(w) > 4 and w like '%ies' then left(w, length(w) - 3) || 'y' when length(w) > 4 and regexp_matches(w, '(ss|x|z|ch|sh)es$') then left(w, length(w) - 2) when length(w) > 3 and w like '%s' and not regexp_matches(w, '(ss|us|is)$') then left(w, length(w) - 1) else w end stem from w")
def stemming(read):
    words = read("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("x")).distinct()
    forms = words.select(F.explode(F.array(*[F.concat("x", F.lit(e)) for e in ("s", "es", "ies", "")])).alias("w")).distinct()
    return forms.select("w", text.stem(F.col("w")).alias("stem"))


@query("agg_df_idf", f"with {TOKENS} select tok as token, df, round(idf, 9) idf from df")
def agg_df_idf(read):
    return S.idf(names(read), "item", "t").select("token", "df", F.round("idf", 9).alias("idf"))


PAIRS = TOKENS + ", c as (select a.item a, b.item b, count(*) c, sum(idf * idf) d from post a join post b using (tok) join df using (tok) where a.item <> b.item group by 1, 2), norm as (select item, count(*) k, sqrt(sum(idf * idf)) l from post join df using (tok) group by 1), sim as (select a, b, c / (x.k + y.k - c)::double j, case when x.l * y.l > 0 then d / (x.l * y.l) end w from c join norm x on x.item = a join norm y on y.item = b)"


@query("sim_raw", f"with {PAIRS} select a, b, round(j, 9) jaccard from sim")
def sim_raw(read):
    return S.jaccard_pairs(names(read), "item", "t").select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("sim_weighted", f"with {PAIRS} select a, b, round(w, 7) cosine from sim")
def sim_weighted(read):
    return S.cosine_pairs(S.weighted(names(read), "item", "t")).select("a", "b", F.round("cosine", 7).alias("cosine"))


@query("sim_explain", f"with {PAIRS} select a.item a, b.item b, tok as token, round(idf * idf / sum(idf * idf) over (partition by a.item, b.item), 7) share from post a join post b using (tok) join df using (tok) where a.item <> b.item and a.item like 'red%'")
def sim_explain(read):
    v = S.weighted(names(read), "item", "t")
    pairs = S.cosine_pairs(v).where("a like 'red%'")
    return S.explain(v, pairs).select("a", "b", "token", F.round("share", 7).alias("share"))


@query("knn_exact", f"with {PAIRS} select a, b, round(j, 9) jaccard, cast(row_number() over (partition by a order by round(j, 9) desc, b) as bigint) place from sim qualify place <= 5")
def knn_exact(read):
    found = S.neighbours(S.jaccard_pairs(names(read), "item", "t"), "jaccard", 5)
    return found.select("a", "b", F.round("jaccard", 9).alias("jaccard"), F.col("place").cast("long").alias("place"))


@query("join_self_knn", f"with {PAIRS} select a, b, round(w, 7) cosine from sim qualify row_number() over (partition by a order by round(w, 9) desc, b) <= 3")
def join_self_knn(read):
    return S.neighbours(S.cosine_pairs(S.weighted(names(read), "item", "t")), "cosine", 3).select("a", "b", F.round("cosine", 7).alias("cosine"))


@query("name_mask", f"with {NAMES} select item, n, case when n = 1 then list_filter(regexp_extract_all(item, '[a-z]+'), lambda x: x <> string_split(item, ' ')[1]) else regexp_extract_all(item, '[a-z]+') end::varchar[] as kept from names")
def name_mask(read):
    owners = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: i)
    kept = S.name_mask(F.regexp_extract_all("item", F.lit("[a-z]+"), F.lit(0)), owners, F.array(F.element_at(F.split("item", " "), 1)))
    return names(read).select("item", "n", kept.alias("kept"))


@query("set_jaccard", "with s as (select o_orderkey, list_distinct(list(l_returnflag || l_linestatus)) x, list_distinct(list(l_linestatus || l_returnflag) filter (l_quantity > 10) ) y, list_distinct(list(l_returnflag || l_linestatus) filter (l_quantity > 10)) z from lineitem join orders on o_orderkey = l_orderkey group by 1) select o_orderkey, round(case when len(x) = 0 then 0 else len(list_intersect(x, coalesce(z, []))) / len(list_distinct(list_concat(x, coalesce(z, []))))::double end, 9) jaccard from s")
def set_jaccard(read):
    pair = F.concat("l_returnflag", "l_linestatus")
    sets = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.collect_set(pair).alias("x"), F.collect_set(F.when(F.col("l_quantity") > 10, pair)).alias("z"))
    return sets.select("o_orderkey", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("x", "z")), F.size(F.array_union("x", "z"))), F.lit(0.0)), 9).alias("jaccard"))


@query("zone_classify")
def zone_classify(read):
    return rules.apply_rules(read("documents").select("doc_id", "text"), "doc_id", "text")


RULES = [("warm", r"\bhot\b|\bred\b", [("hue", "source", False), ("heat", "destination", False)]), ("cold", r"\bblue\b", [("hue", "reference", False)]), ("size", r"\bsmall\b|\blarge\b", [("size", "reference", False)]), ("big", r"\blarge\b", [("size", "destination", True)])]
ZONES = """r as (select p_partkey item, z.zone, z.direction, z.choice from part, (values ('\\b(hot|red)\\b', 'hue', 'source', false), ('\\b(hot|red)\\b', 'heat', 'destination', false), ('\\bblue\\b', 'hue', 'reference', false), ('\\b(small|large)\\b', 'size', 'reference', false), ('\\blarge\\b', 'size', 'destination', true)) z(rx, zone, direction, choice) where regexp_matches(lower(p_name), z.rx)),
m as (select item, zone, direction, bool_or(choice) choice from r group by 1, 2, 3),
k as (select * from m where direction <> 'reference' or not exists (select 1 from m x where x.item = m.item and x.zone = m.zone and x.direction <> 'reference'))"""


@query("rule_records", f"with {ZONES} select item, zone, direction, choice from k")
def rule_records(read):
    return rules.apply_rules(read("part"), "p_partkey", "p_name", RULES)


@query("zone_distribution", f"with {ZONES} select zone, direction, count(*) n from k group by grouping sets ((zone), (zone, direction))")
def zone_distribution(read):
    return rules.apply_rules(read("part"), "p_partkey", "p_name", RULES).groupingSets([["zone"], ["zone", "direction"]], "zone", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("zone_flags", f"with {ZONES}, t as (select p_partkey item, 'hue' zone, 'source' direction from part where p_type = 'PROMO') select item, zone, direction from t where not exists (select 1 from k where k.item = t.item and k.zone = t.zone and k.direction = t.direction)")
def zone_flags(read):
    own = rules.apply_rules(read("part"), "p_partkey", "p_name", RULES)
    plain = rules.apply_rules(read("part").where("p_type = 'PROMO'").withColumn("plain", F.lit("red")), "p_partkey", "plain", RULES[:1]).where("zone = 'hue'")
    return plain.join(own, ["item", "zone", "direction"], "left_anti").select("item", "zone", "direction")


@query("hand_rule_text", r"select p_partkey, p_name as sentence from part where (p_name like '%ring%' or p_name like '%bolt%') and p_name not like '%old%'")
def hand_rule_text(read):
    found = rules.phrase_rule(text.sentences(F.col("p_name")), ["ring", "bolt"], ["old"])
    return read("part").select("p_partkey", found.alias("sentence")).where("sentence is not null")


@query("hand_rule_keyword", "select p_partkey, w as keyword from (select p_partkey, unnest(string_split(p_name, ' ')) w from part) where w in ('ring', 'gear')")
def hand_rule_keyword(read):
    wanted = read("part").sparkSession.createDataFrame([("ring",), ("gear",)], "keyword string")
    return read("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("keyword")).join(wanted, "keyword").select("p_partkey", "keyword")


@query("tag_filter", "with t as (select p_brand slug, count(*) size from part group by 1) select slug, size from t where slug <> 'Brand#3' and slug not like 'Brand#1%' and slug not like '%5' and size >= 20")
def tag_filter(read):
    tags = read("part").groupBy(F.col("p_brand").alias("slug")).agg(F.count(F.lit(1)).alias("size"))
    return rules.tag_filter(tags, "slug", ["Brand#3"], ["Brand#1"], ["5"], "size")


@query("hash_partition_sink", "select cast(('0x' || substr(md5(cast(c_custkey as varchar)), 1, 8))::bigint % 64 as integer) shard, count(*) n from customer group by 1")
def hash_partition_sink(read):
    return read("customer").groupBy(codes.shard(F.col("c_custkey").cast("string")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("checksum_fnv1a", "select c_mktsegment, list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(string_agg(c_name, chr(10) order by c_name), ''), lambda c: ascii(c)::hugeint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::bigint checksum from customer group by 1")
def checksum_fnv1a(read):
    joined = F.array_join(F.array_sort(F.collect_list("c_name")), "\n")
    return read("customer").groupBy("c_mktsegment").agg(joined.alias("x")).select("c_mktsegment", codes.fnv1a(F.col("x")).alias("checksum"))


@query("dictionary_encode", "select p_brand, count(*) n, cast(row_number() over (order by p_brand) - 1 as integer) code from part group by 1")
def dictionary_encode(read):
    return R.dictionary_encode(read("part"), "p_brand")


SEARCH = r"""with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') t from documents), n as (select count(*)::double n from d),
tf as (select doc_id, w, count(*) tf from (select doc_id, unnest(t) w from d) group by 1, 2), df as (select w, count(*) df from tf group by 1),
v as (select doc_id, w, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) v from tf join df using (w), n), l as (select doc_id, sqrt(sum(v * v)) l from v group by 1),
s as (select doc_id, sum(v / l * q) s from v join l using (doc_id) join (values ('the', 0.6), ('thing', 0.8)) q(w, q) using (w) group by 1)"""


def _scores(read) -> DataFrame:
    docs = read("documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    q = docs.sparkSession.createDataFrame([("the", 0.6), ("thing", 0.8)], "token string, q double")
    return S.weighted_search(docs, "doc_id", words, q).withColumnRenamed("item", "doc_id")


@query("tfidf_score", SEARCH + " select doc_id, round(s, 7) s from s")
def tfidf_score(read):
    return _scores(read).select("doc_id", F.round("s", 7).alias("s"))


@query("rank_competition", SEARCH + " select doc_id, cast(rank() over (order by round(s, 5) desc) as bigint) as rank from s")
def rank_competition(read):
    return R.competition_rank(stored(_scores(read)), "s", digits=5).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("fuse_rrf", SEARCH + ", a as (select doc_id, rank() over (order by round(s, 5) desc) r from s), b as (select doc_id, rank() over (order by n_chars desc) r from documents where doc_id in (select doc_id from s)) select doc_id, round(sum(1.0::double / (60 + r)), 9) score from (select * from a union all select * from b) group by 1")
def fuse_rrf(read):
    a = R.competition_rank(stored(_scores(read)), "s", digits=5)
    b = R.competition_rank(read("documents").join(a.select("doc_id"), "doc_id", "left_semi").withColumn("n", F.col("n_chars").cast("double")), "n")
    return R.fuse_ranks([a, b], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("mean_target_rank", SEARCH + ", a as (select doc_id, rank() over (order by round(s, 5) desc) r from s) select lang, round(avg(r), 6) mean_rank, median(r) middle, case when avg(r) - (select avg(r) from a) < -1 then 'win' when avg(r) - (select avg(r) from a) > 1 then 'loss' else 'tie' end verdict from a join documents using (doc_id) group by 1")
def mean_target_rank(read):
    a = R.competition_rank(stored(_scores(read)), "s", digits=5).join(read("documents").select("doc_id", "lang"), "doc_id")
    whole = a.agg(F.avg("rank").alias("whole"))
    by = a.groupBy("lang").agg(F.avg("rank").alias("m"), F.median("rank").alias("middle")).join(F.broadcast(whole))
    gap = F.col("m") - F.col("whole")
    return by.select("lang", F.round("m", 6).alias("mean_rank"), "middle", F.when(gap < -1, "win").when(gap > 1, "loss").otherwise("tie").alias("verdict"))


@query("agg_max_with_arg", f"with {LINES} select doc_id, max(length(line)) score, arg_max(line_no, (length(line), -line_no)) line_no from lines group by 1")
def agg_max_with_arg(read):
    best = R.max_with_arg(lines(read).withColumns({"score": F.length("line").cast("long"), "line_no": F.col("line_no").cast("long")}), "doc_id", "score", "line_no", "line_no")
    return best.select("doc_id", "score", "line_no")


@query("effect_search")
def effect_search(read):
    """Lines as effects, two rankers over them, fused, the best line per document, top 20."""
    effects = lines(read).withColumn("effect_id", text.effect_id(F.col("line")))
    unique = stored(effects.groupBy("effect_id").agg(F.min("line").alias("line")))
    q = unique.sparkSession.createDataFrame([("q", "hand thing stand band")], "effect_id string, line string")
    words = F.regexp_extract_all("line", F.lit("[a-z]+"), F.lit(0))
    asked = "hand thing stand band".split()
    by_terms = S.tfidf_search(unique.unionByName(q), "effect_id", text.tokens(F.col("line")), {w: 1 for w in asked}).where("item <> 'q'").select(F.col("item").alias("effect_id"), F.col("score").alias("s"))
    by_cells = S.bag_search(unique, "effect_id", words, asked).withColumnRenamed("item", "effect_id")
    fused = stored(R.fuse_ranks([R.competition_rank(stored(x), "s") for x in (by_terms, by_cells)], "effect_id"))
    per_doc = effects.join(fused, "effect_id").select("doc_id", "effect_id", "score", "line_no")
    best = R.max_with_arg(per_doc, "doc_id", "score", "effect_id", "line_no")
    return best.orderBy(F.desc("score"), "doc_id").limit(20)


@query("whole_card_baseline", SEARCH + " select doc_id, cast(rank() over (partition by lang order by round(s, 5) desc) as bigint) as rank from s join documents using (doc_id)")
def whole_card_baseline(read):
    scored = _scores(read).join(read("documents").select("doc_id", "lang"), "doc_id")
    return R.competition_rank(scored, "s", ["lang"], 5).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("stub_embed")
def stub_embed(read):
    bag = S.hashed_bag(names(read), "item", "t")
    return bag.select("item", "token", F.round("w", 9).alias("w"))


PHRASES = f"""with recursive {NAMES}, w as (select item, string_split(item, ' ')[3] g, string_split(lower(item), ' ') t, n from names), cards as (select g, sum(n) cards from w group by 1),
grams as (select distinct item, g, n, t[i:i + k - 1] x from (select item, g, n, t, k, unnest(range(1, greatest(1, len(t) - k + 2))) i from (select *, unnest(range(2, 13)) k from w))),
found as (select g, x, sum(n) n from grams group by 1, 2 having sum(n) >= 2),
ranked as (select *, row_number() over (partition by g order by n * len(x) desc, len(x) desc, array_to_string(x, ' ')) k from found),
walk(g, k, chosen) as (select distinct g, 0::bigint, []::varchar[][] from ranked union all select r.g, r.k, case when len(chosen) < 6 and len(list_filter(chosen, lambda c: list_has_any(
 list_transform(range(1, len(c) - (6 * least(len(c), len(r.x)) + 9) // 10 + 2), lambda i: array_to_string(c[i:i + (6 * least(len(c), len(r.x)) + 9) // 10 - 1], ' ')),
 list_transform(range(1, len(r.x) - (6 * least(len(c), len(r.x)) + 9) // 10 + 2), lambda i: array_to_string(r.x[i:i + (6 * least(len(c), len(r.x)) + 9) // 10 - 1], ' '))))) = 0 then list_append(chosen, r.x) else chosen end from walk join ranked r on r.g = walk.g and r.k = walk.k + 1),
kept as (select g, unnest(chosen) x, unnest(range(1, len(chosen) + 1)) turn from (select g, arg_max(chosen, k) chosen from walk group by 1))
select g, array_to_string(x, ' ') phrase, cast(n as bigint) n, round(n / cards::double, 4) share, row_number() over (partition by g order by turn > 1, n desc, array_to_string(x, ' ')) place from kept join found using (g, x) join cards using (g)"""


@query("phrase_mining", PHRASES)
def phrase_mining(read):
    w = names(read).withColumn("words", F.split(F.lower("item"), " ")).withColumn("g", F.element_at(F.split("item", " "), 3))
    found = phrases.mine(w, "g", "words", "n")
    return found.select("g", "phrase", "n", F.round("share", 4).alias("share"), "place")


@query("anchor_learning", f"with {NAMES}, w as (select distinct item, string_split(item, ' ')[3] g, unnest(string_split(item, ' ')[1:2]) w from names), c as (select g, w, count(*) k from w group by 1, 2), t as (select w, count(*) t from w group by 1), s as (select g, count(distinct item) s from w group by 1), a as (select count(distinct item) a from w) select g, w, k, round(ln((k + 0.5::double) / (s - k + 0.5)) - ln((t - k + 0.5::double) / (a - s - t + k + 0.5)), 7) odds from c join t using (w) join s using (g), a where k >= 5 and k >= 0.03 * s")
def anchor_learning(read):
    w = names(read).select("item", F.element_at(F.split("item", " "), 3).alias("g"), F.explode(F.slice(F.split("item", " "), 1, 2)).alias("w")).distinct()
    c, t = w.groupBy("g", "w").agg(F.count(F.lit(1)).alias("k")), w.groupBy("w").agg(F.count(F.lit(1)).alias("t"))
    s, a = w.groupBy("g").agg(F.count_distinct("item").alias("s")), w.agg(F.count_distinct("item").alias("a"))
    x = c.join(t, "w").join(s, "g").join(F.broadcast(a)).where("k >= 5 and k >= 0.03 * s")
    odds = F.log((F.col("k") + 0.5) / (F.col("s") - F.col("k") + 0.5)) - F.log((F.col("t") - F.col("k") + 0.5) / (F.col("a") - F.col("s") - F.col("t") + F.col("k") + 0.5))
    return x.select("g", "w", "k", F.round(odds, 7).alias("odds"))
