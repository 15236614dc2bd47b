"""Hand edits in batches: all or nothing, told apart by id and signature, undone by what they replaced.

The log is one versioned folder of three tables: edits (oid, gid, action, batch), replaced (what a batch took the place of) and batches (batch, signature,
undone, seq, n).  Each step writes all three as a new version, so a step that fails leaves the former.  Steps follow each other; rows of a step are joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions

_KINDS = {"edits": "oid bigint, gid string, action string, batch string", "replaced": "by string, oid bigint, gid string, action string, batch string", "batches": "batch string, signature string, undone boolean, seq bigint, n bigint"}
#: The pseudo group of what fits nowhere, and the actions of a row.
NOFIT = "none:fits"
ACTIONS = ["add", "remove", "nofit"]


def refusals(items: DataFrame, cards: DataFrame, groups: DataFrame, members: DataFrame, edits: DataFrame, override: bool = False) -> DataFrame:
    """(oid, gid, code, error) of the rows of a batch that can't be applied, with the first reason of each.

    items: oid, gid, action, score; cards: oid; groups: gid, offered; members: oid, gid, precise; edits: oid, gid, action."""
    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    twice = items.groupBy("oid", "gid").agg(F.count(F.lit(1)).alias("times"))
    held = members.groupBy("oid", "gid").agg(F.bool_or("precise").alias("precise"))
    x = items.join(twice, ["oid", "gid"], "left").join(flag(cards, ["oid"], "card"), "oid", "left").join(groups.select("gid", "offered", F.lit(True).alias("group")), "gid", "left")
    x = x.join(held, ["oid", "gid"], "left").join(flag(edits, ["oid"], "edited"), "oid", "left")
    added = edits.where("action = 'add'").select("oid", F.lit(True).alias("placed")).distinct()
    x = x.join(added, "oid", "left")
    unset = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    to_nofit = F.col("gid") == NOFIT
    reason = lambda code, text: F.struct(F.lit(code).alias("code"), F.lit(text).alias("error"))
    first = (
        F.when(F.col("oid").isNull() | F.col("gid").isNull(), reason(400, "oid or group is missing"))
        .when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)), reason(400, "unknown action"))
        .when((F.col("action") == "nofit") != to_nofit, reason(400, "nofit and its group go together"))
        .when(F.col("score").isNotNull() & ~F.col("score").between(0, 1), reason(422, "score is not from 0 to 1"))
        .when(unset("card"), reason(404, "unknown card"))
        .when(~to_nofit & unset("group"), reason(422, "unknown group"))
        .when(F.col("times") > 1, reason(422, "the same card and group twice"))
        .when((F.col("action") == "add") & ~unset("precise"), reason(409, "the card is already in this group"))
        .when((F.col("action") == "add") & unset("offered"), reason(422, "this group is not offered"))
        .when((F.col("action") == "nofit") & ~unset("placed"), reason(409, "the card has a hand placement"))
        .when(F.lit(not override) & ~unset("edited"), reason(409, "the card has a hand entry"))
    )
    return x.withColumn("r", first).where("r is not null").select("oid", "gid", "r.code", "r.error")


def signature(items: DataFrame) -> str:
    """A mark of a batch's rows, whatever their order."""
    h = F.xxhash64("oid", "gid", "action")
    s = items.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("s")).first()
    return f"{s['n']}:{s['x']}:{s['s']}"


class EditLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Versions(spark, path)

    def table(self, name: str) -> DataFrame:
        version = self.store.current()
        return self.store.read(name, version) if version else self.spark.createDataFrame([], _KINDS[name])

    def revision(self) -> int:
        return int((self.store.current() or "v-0").split("-")[1])

    def _answer(self, changed: bool, code: int = 200, error: str | None = None, rows: DataFrame | None = None) -> dict:
        return {"ok": error is None, "code": code, "error": error, "changed": changed, "revision": self.revision(), "rows": rows}

    def _commit(self, version: str | None, **tables: DataFrame) -> None:
        self.store.write({name: tables.get(name, self.table(name)) for name in _KINDS}, expected=version)

    def apply(self, batch: str, items: DataFrame, cards: DataFrame, groups: DataFrame, members: DataFrame, override: bool = False, revision: int | None = None) -> dict:
        """Apply a batch: {ok, code, error, changed, revision, rows (refused rows)}.  The same batch again changes nothing; its id with other rows, or a stale revision, is a conflict."""
        version = self.store.current()
        sig = signature(items)
        known = self.table("batches").where(F.col("batch") == batch).first()
        if known:
            same = known["signature"] == sig and not known["undone"]
            return self._answer(False) if same else self._answer(False, 409, "this batch id was already used")
        if revision is not None and revision != self.revision():
            return self._answer(False, 409, "the log has moved on")
        edits = self.table("edits")
        refused = refusals(items, cards, groups, members, edits, override)
        worst = refused.agg(F.max("code")).first()[0]
        if worst is not None:
            return self._answer(False, 409 if refused.where("code = 409").limit(1).count() else worst, "batch rejected, nothing written", refused)
        gone = items.select("oid", "gid").unionByName(items.where("action = 'add'").select("oid", F.lit(NOFIT).alias("gid"))).distinct()
        new = items.select("oid", "gid", "action", F.lit(batch).alias("batch"))
        kept = edits.join(gone, ["oid", "gid"], "left_anti").select("oid", "gid", "action", "batch")
        took = edits.join(gone, ["oid", "gid"], "left_semi").select(F.lit(batch).alias("by"), "oid", "gid", "action", "batch")
        row = self.spark.createDataFrame([(batch, sig, False, self.revision() + 1, int(sig.split(":")[0]))], _KINDS["batches"])
        self._commit(version, edits=kept.unionByName(new), replaced=self.table("replaced").unionByName(took), batches=self.table("batches").unionByName(row))
        return self._answer(True)

    def undo(self, batch: str) -> dict:
        """Take a batch back: its rows go, what they replaced returns unless something stands there now.  Undone twice, nothing changes."""
        version, batches = self.store.current(), self.table("batches")
        known = batches.where(F.col("batch") == batch).first()
        if not known:
            return self._answer(False, 404, "unknown batch")
        if known["undone"]:
            return self._answer(False)
        left = self.table("edits").where(F.col("batch") != batch)
        back = self.table("replaced").where(F.col("by") == batch).select("oid", "gid", "action", "batch")
        back = back.join(left.select("oid", "gid"), ["oid", "gid"], "left_anti").select("oid", "gid", "action", "batch")
        marked = batches.withColumn("undone", F.col("undone") | (F.col("batch") == batch))
        self._commit(version, edits=left.unionByName(back), batches=marked)
        return self._answer(True)
