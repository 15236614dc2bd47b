"""Text functions as Column expressions: normal forms, splitting, tokens, stems."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of their own when two effects are compared.
STOPWORDS = (
    "a an the this that these those there here and or but if then than as so of to in into on onto from with at for by up down out off over under "
    "is are was were be been being am it its they them their he she his her him do does did done have has had will would shall should may might must can could each other another same"
).split()
#: Keyword abilities that may stand alone on a line, parted by commas.
KEYWORDS = [
    "deathtouch",
    "defender",
    "double strike",
    "enchant",
    "equip",
    "first strike",
    "flash",
    "flying",
    "haste",
    "hexproof",
    "indestructible",
    "intimidate",
    "landwalk",
    "lifelink",
    "protection",
    "reach",
    "shroud",
    "trample",
    "vigilance",
    "banding",
    "rampage",
    "cumulative upkeep",
    "flanking",
    "phasing",
    "buyback",
    "shadow",
    "echo",
    "horsemanship",
    "fading",
    "kicker",
    "flashback",
    "madness",
    "fear",
    "morph",
    "amplify",
    "provoke",
    "storm",
    "affinity",
    "entwine",
    "modular",
    "sunburst",
    "bushido",
    "soulshift",
    "splice",
    "offering",
    "ninjutsu",
    "epic",
    "convoke",
    "dredge",
    "transmute",
    "bloodthirst",
    "haunt",
    "replicate",
    "forecast",
    "graft",
    "recover",
    "ripple",
    "split second",
    "suspend",
    "vanishing",
    "absorb",
    "aura swap",
    "delve",
    "fortify",
    "frenzy",
    "gravestorm",
    "poisonous",
    "transfigure",
    "champion",
    "changeling",
    "evoke",
    "hideaway",
    "prowl",
    "reinforce",
    "conspire",
    "persist",
    "wither",
    "retrace",
    "devour",
    "exalted",
    "unearth",
    "cascade",
    "annihilator",
    "level up",
    "rebound",
    "totem armor",
    "infect",
    "battle cry",
    "living weapon",
    "undying",
    "miracle",
    "soulbond",
    "overload",
    "scavenge",
    "unleash",
    "cipher",
    "evolve",
    "extort",
    "fuse",
    "bestow",
    "tribute",
    "dethrone",
    "outlast",
    "prowess",
    "dash",
    "exploit",
    "menace",
    "renown",
    "awaken",
    "devoid",
    "ingest",
    "myriad",
    "surge",
    "skulk",
    "emerge",
    "escalate",
    "melee",
    "crew",
    "fabricate",
    "partner",
    "undaunted",
    "improvise",
    "aftermath",
    "embalm",
    "eternalize",
    "afflict",
    "ascend",
    "assist",
    "jump-start",
    "mentor",
    "afterlife",
    "riot",
    "spectacle",
    "escape",
    "companion",
    "mutate",
    "encore",
    "boast",
    "foretell",
    "demonstrate",
    "daybound",
    "nightbound",
    "disturb",
    "decayed",
    "cleave",
    "training",
    "compleated",
    "reconfigure",
    "blitz",
    "casualty",
    "enlist",
    "read ahead",
    "ravenous",
    "squad",
    "space sculptor",
    "visit",
    "prototype",
    "living metal",
    "backup",
    "bargain",
    "craft",
    "disguise",
    "plot",
    "saddle",
    "spree",
    "freerunning",
    "gift",
    "offspring",
    "impending",
    "flurry",
]
#: Marks that open a choice.
BULLET = r"^\s*[•*∙]\s*"
#: The line before choices; a pattern of this library.
LEAD = r"(?i)^choose (one|two|three|any number)[^\n]*[-—•]\s*$"
#: Letters that are folded to other than their base letter.
SPECIAL = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}
#: Words of the term index; mana symbols, stat changes, words with inner apostrophes or hyphens, numbers.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'+/-]*[\p{L}\p{N}_])?"
TOKEN = r"\{[^}]{1,12}\}|[+-]?\d+/[+-]?\d+|[a-z]+(?:['-][a-z]+)*|\d+"


def normalize(x: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def effect_id(x: Column, prefix: str = "eff_", digits: int = 10) -> Column:
    """Prefix and the first digits of the SHA-1 of the normal form."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(normalize(x)), 1, digits))


def fold(x: Column) -> Column:
    """Search form: lower case, apostrophes dropped, all else but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "['’]", ""), "[^a-z0-9]+", " "))


def _folds() -> dict[str, str]:
    """Characters of the Latin blocks and what they are without their marks; by the rules of Unicode."""
    out = {}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c.isascii())
        if base:
            out[chr(code)] = base
    return out | SPECIAL


def fold_marks(x: Column) -> Column:
    """Name form: Latin letters without their marks, lower case, // as a space, all else but a to z, digits and spaces dropped."""
    folds = _folds()
    single = {c: b for c, b in folds.items() if len(b) == 1}
    x = F.translate(x, "".join(single), "".join(single.values()))
    for c, b in folds.items():
        if len(b) != 1 and any(v.isalnum() for v in b):
            x = F.replace(x, F.lit(c), F.lit(b))
    x = F.regexp_replace(x, "[^\\x00-\\x7f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(x), F.lit("//"), F.lit(" ")), "[^a-z0-9 ]+", ""), " +", " "))


def effects(x: Column, keywords=KEYWORDS) -> Column:
    """Pieces (kind, effect) in order: each bullet, each line before choices, each keyword of a line that has nothing but
    keywords and their reminders between commas, else whole lines.  No line is split by its meaning."""
    piece = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s.alias("effect"))
    strip = lambda s: F.btrim(s, F.lit(" \t\r\f\v"))
    known = lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s*\([^)]*\)\s*$", "")).isin(*keywords)

    def pieces(s: Column) -> Column:
        parts = F.transform(F.split(s, ",", -1), strip)
        return (
            F.when(s.rlike(BULLET), F.array(piece("bullet", strip(F.regexp_replace(s, BULLET, "")))))
            .when(s.rlike(LEAD), F.array(piece("lead", s)))
            .when(F.forall(parts, known), F.transform(parts, lambda p: piece("keyword", p)))
            .otherwise(F.array(piece("line", s)))
        )

    return F.flatten(F.transform(F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != ""), pieces))


def lines(x: Column) -> Column:
    """Lines that are not blank, without space at the ends."""
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def sentences(x: Column) -> Column:
    """Pieces that end with a full stop before white space, or at a line's end."""
    return F.filter(F.transform(F.split(x, r"(?<=\.)\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def tokens(x: Column, drop_reminders: bool = True) -> Column:
    """Tokens in order, stopwords and text in parentheses left out."""
    low = F.lower(x)
    if drop_reminders:
        low = F.regexp_replace(low, r"\([^()]*\)", " ")
    low = F.replace(F.replace(low, F.lit("—"), F.lit(" ")), F.lit("’"), F.lit("'"))
    return F.filter(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def token_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(x)))


def stem(w: Column) -> Column:
    """Plural endings off: ies to y, es after ss, x, z, ch, sh, and s but for ss, us, is."""
    n = F.length(w)
    return (
        F.when((n > 4) & w.rlike("ies$"), F.concat(F.substr(w, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & w.rlike("(ss|x|z|ch|sh)es$"), F.substr(w, F.lit(1), n - 2))
        .when((n > 3) & w.rlike("s$") & ~w.rlike("(ss|us|is)$"), F.substr(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def variants(w: Column) -> Column:
    """The stem, and the stem without ing or ed."""
    s = stem(w)
    n = F.length(s)
    extra = F.when((n > 5) & s.rlike("ing$"), F.substr(s, F.lit(1), n - 3)).when((n > 4) & s.rlike("ed$"), F.substr(s, F.lit(1), n - 2))
    return F.array_compact(F.array(s, extra))


def terms(x: Column, stop=STOPWORDS) -> Column:
    """Words of letters, digits and inner marks, and all two in a row, after stopwords are left out."""
    words = F.filter(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*stop))
    return F.element_at(F.transform(F.array(words), lambda ws: F.concat(ws, ngrams(ws, 2))), 1)


def ngrams(words: Column, n: int) -> Column:
    """All n words in a row, joined by a space."""

    def runs(ws: Column) -> Column:
        count = F.size(ws) - (n - 1)
        return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words), runs), 1)  # words are made once, not once a run
