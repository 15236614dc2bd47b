"""Versioned tables, batches of edits and their undoing, over documents as cards."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators.batches import EditLog, refusals
from ..sources.files import shared_folder
from ..sources.versions import Versions
from .registry import query


@query("atomic_file_sink", "select doc_id, upper(source) source, true as refused, 3::bigint as versions from documents where doc_id % 2 = 0")
def atomic_file_sink(read):
    """A table replaced twice and once more by a write that fails: readers still see the second."""
    docs = read("documents").select("doc_id", "source")
    at = Versions(docs.sparkSession, shared_folder(docs.sparkSession), keep=2)
    at.write(docs)
    at.write(docs.where("doc_id % 3 = 0"))
    at.write(docs.where("doc_id % 2 = 0").withColumn("source", F.upper("source")))
    whole = at.current()
    try:
        at.write(docs.withColumn("source", F.when(F.col("doc_id") % 7 == 3, F.raise_error(F.lit("broken row"))).otherwise(F.col("source"))))
        refused = False
    except PySparkException:
        refused = at.current() == whole
    return at.read().select("doc_id", "source", F.lit(refused).alias("refused"), F.lit(len(at.names())).cast("long").alias("versions"))


CARDS = """c as (select doc_id oid, 'g' || (n_chars % 30) mine, 'g' || ((n_chars + 1) % 30) other, 'g' || ((n_chars + 2) % 30) third from documents)"""


def card_tables(read):
    """Cards, groups (g7 is not offered), members (precise for every fourth card) and the groups asked for."""
    name = lambda k: F.concat(F.lit("g"), ((F.col("n_chars") + k) % 30).cast("string"))
    c = read("documents").select(F.col("doc_id").alias("oid"), name(0).alias("mine"), name(1).alias("other"), name(2).alias("third"))
    groups = c.sparkSession.range(30).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gid"), (F.col("id") != 7).alias("offered"))
    members = c.select("oid", F.col("mine").alias("gid"), (F.col("oid") % 4 == 0).alias("precise"))
    return c, c.select("oid"), groups, members


def _rows(c, where, group, action, score=0.5):
    return c.where(where).select("oid", F.col(group).alias("gid"), F.lit(action).alias("action"), F.lit(score).cast("double").alias("score"))


@query("batch_log", f"with {CARDS} select oid, other gid, 'add' as action, 'b1' batch, 4::integer revision, '200 200 409 200 404 409 200 200 200' codes from c where oid % 3 = 1 and other <> 'g7' union all select oid, third, 'add', 'b4', 4, '200 200 409 200 404 409 200 200 200' from c where oid % 6 = 4 and third <> 'g7'")
def batch_log(read):
    """Nine steps: a batch, the same again, its id with other rows, one over it, two that are refused, another, the second undone twice."""
    c, cards, groups, members = card_tables(read)
    log = EditLog(c.sparkSession, shared_folder(c.sparkSession))
    first = _rows(c, "oid % 3 = 1 and other <> 'g7'", "other", "add")
    unknown = c.sparkSession.createDataFrame([(-5, "g1", "add", 0.5)], first.schema)
    apply = lambda batch, items, **more: log.apply(batch, items, cards, groups, members, **more)
    steps = [
        apply("b1", first), apply("b1", first), apply("b1", first.where("oid % 2 = 0")), apply("b2", _rows(c, "oid % 6 = 1", "other", "remove"), override=True),
        apply("b3", unknown), apply("b4", _rows(c, "oid % 6 = 4", "third", "add"), revision=1), apply("b4", _rows(c, "oid % 6 = 4 and third <> 'g7'", "third", "add"), override=True, revision=2),
        log.undo("b2"), log.undo("b2"),
    ]
    return log.table("edits").select("oid", "gid", "action", "batch", F.lit(log.revision()).alias("revision"), F.lit(" ".join(str(s["code"]) for s in steps)).alias("codes"))


@query("edit_codes", f"""with {CARDS}, i as (select oid, case oid % 7 when 0 then mine when 1 then other when 2 then null when 3 then 'g99' when 4 then 'none:fits' else third end gid, case oid % 5 when 0 then 'remove' when 1 then 'move' when 2 then 'nofit' else 'add' end as action, case when oid % 11 = 0 then 2.0 else 0.5 end score from c union all select oid, 'g1', 'add', 0.5 from c where oid % 13 = 0 union all select oid, 'g1', 'add', 0.5 from c where oid % 13 = 0 union all select -oid - 1, 'g1', 'add', 0.5 from c where oid % 50 = 0),
t as (select oid, gid, count(*) n from i group by 1, 2), ed as (select oid from c where oid % 9 = 0),
x as (select i.*, t.n from i left join t on t.oid = i.oid and t.gid = i.gid),
r as (select x.oid, x.gid, case when x.gid is null then '400 oid or group is missing' when x.action = 'move' then '400 unknown action' when (x.action = 'nofit') <> (x.gid = 'none:fits') then '400 nofit and its group go together' when score > 1 then '422 score is not from 0 to 1' when x.oid < 0 then '404 unknown card' when x.gid not in (select 'g' || g from range(30) r(g)) and x.gid <> 'none:fits' then '422 unknown group'
 when n > 1 then '422 the same card and group twice' when x.action = 'add' and x.oid % 4 = 0 and x.gid = c.mine then '409 the card is already in this group' when x.action = 'add' and x.gid = 'g7' then '422 this group is not offered' when x.action = 'nofit' and x.oid % 9 = 0 then '409 the card has a hand placement' when x.oid % 9 = 0 then '409 the card has a hand entry' end r from x left join c on c.oid = x.oid)
select oid, gid, left(r, 3)::integer code, substring(r, 5) as error from r where r is not null""")
def edit_codes(read):
    """Why rows of a batch are refused."""
    c, cards, groups, members = card_tables(read)
    k = lambda n: F.col("oid") % n
    gid = F.when(k(7) == 0, F.col("mine")).when(k(7) == 1, F.col("other")).when(k(7) == 2, F.lit(None)).when(k(7) == 3, "g99").when(k(7) == 4, "none:fits").otherwise(F.col("third"))
    action = F.when(k(5) == 0, "remove").when(k(5) == 1, "move").when(k(5) == 2, "nofit").otherwise("add")
    items = c.select("oid", gid.alias("gid"), action.alias("action"), F.when(k(11) == 0, 2.0).otherwise(0.5).alias("score"))
    twice = c.where("oid % 13 = 0").select("oid", F.lit("g1").alias("gid"), F.lit("add").alias("action"), F.lit(0.5).alias("score"))
    strange = c.where("oid % 50 = 0").select((-F.col("oid") - 1).alias("oid"), F.lit("g1").alias("gid"), F.lit("add").alias("action"), F.lit(0.5).alias("score"))
    edits = c.where("oid % 9 = 0").select("oid", F.lit("g3").alias("gid"), F.lit("add").alias("action"))
    return refusals(items.unionByName(twice).unionByName(twice).unionByName(strange), cards, groups, members, edits)
