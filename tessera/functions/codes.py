"""Checksums, shards, bit masks and small numeric rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour letters in order, each one bit.
COLOURS = "WUBRG"


def shard(key: Column, shards: int = 64) -> Column:
    """Shard of a key by its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % shards).cast("int")


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of an ASCII string."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # xor first, then times the prime modulo 2**32
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(16777619) % F.lit(1 << 32))


def colour_mask(letters: Column) -> Column:
    """Letters of WUBRG as a 5-bit number."""
    out = F.lit(0)
    for i, c in enumerate(COLOURS):
        out = out + F.when(letters.contains(c), 1 << i).otherwise(0)
    return out


def colour_ok(mask: Column, chosen: str, mode: str) -> Column:
    """Five modes over letters, C (colourless) and M (several colours); nothing chosen passes all."""
    if not chosen:
        return F.lit(True)
    want, c, m = sum(1 << i for i, x in enumerate(COLOURS) if x in chosen), "C" in chosen, "M" in chosen
    n, letters = F.bit_count(mask), bool(sum(x in chosen for x in COLOURS))
    none, several = n == 0, n >= 2
    if mode == "any":
        return (mask.bitwiseAND(want) != 0) | (none & F.lit(c)) | (several & F.lit(m))
    if mode == "all":
        return (mask.bitwiseAND(want) == want) & ~(F.lit(c) & ~none) & ~(F.lit(m) & ~several)
    if mode == "only":
        inside = F.lit(True) if m and not letters else mask.bitwiseAND(31 - want) == 0
        return F.when(none, F.lit(c)).otherwise(inside & (several | F.lit(not m)))
    if mode == "exactly":
        if c:
            return none & F.lit(not letters)
        return several if not letters else (mask == want) & (several | F.lit(not m))
    if mode == "not":
        return (mask.bitwiseAND(want) == 0) & ~(F.lit(c) & none) & ~(F.lit(m) & several)
    raise ValueError(mode)


def mana_value(cost: Column) -> Column:
    """Value of a cost such as {2}{W}{X}: numbers as they are, X nothing, {2/W} two, others one; null without a cost."""
    parts = F.regexp_extract_all(cost, F.lit(r"\{([^}]*)\}"), F.lit(1))
    value = lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("int")).when(p == "X", 0).when(p.startswith("2/"), 2).otherwise(1)
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0), lambda n, p: n + value(p)))


def mv_bucket(mv: Column) -> Column:
    return F.when(mv.isNull(), "none").when(mv >= 6, "6+").otherwise(mv.cast("string"))


def sign_class(x: Column) -> Column:
    """Sign of a change such as +2/-1: +, -, 0, ± for both, ? where it is no number."""
    plus, minus = x.rlike(r"\+[1-9]"), x.rlike(r"-[1-9]")
    return F.when(plus & minus, "±").when(plus, "+").when(minus, "-").when(x.rlike("[0-9]"), "0").otherwise("?")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the Wilson interval of k of n."""
    p, nn = k / n, n.cast("double")
    mid, half, by = p + z * z / (2 * nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn)), 1 + z * z / nn
    return (mid - half) / by, (mid + half) / by
