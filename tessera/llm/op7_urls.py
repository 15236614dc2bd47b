"""URL filters: rules first, then an empirical-Bayes reputation of hosts.

Labelled pages give each host a number of outcomes and of bad ones.  Rates shrink through beta-binomial
priors: a suffix's towards the overall rate, a registered domain's towards its suffix's, a host's
towards its domain's.  The strength of each prior is fitted by moments from the spread of the groups of
that level.  A host is blocked when the lower bound of its posterior rate passes a threshold, so that a
few bad pages of an unknown host do not block it.

Only built-in functions.  Counts are summed before the shuffle and written once as a table of hosts; four rows of sums reach the driver; pages
meet their host's verdict in a join that adaptive execution splits where one host has most pages.

Defined cases: a null url, or one without "://", has empty host and path and belongs to host ''; labels of
unknown pages count nowhere; several labels of a page count as bad if one is; rows of one page id are outcomes
each, with the label of that id; a null page id has no label; a host without labels has its prior alone; without
any label every host has the rate 1/2 and, its bound being low, is allowed; an input column named like a result
is replaced, others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, inner, keep_names

#: (verdict, host and path) of the rules; longest fit wins.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
THRESHOLD, Z = 0.5, 1.645


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (length, rule, verdict), or null."""
    fits = []
    for verdict, text in rules:
        own, sep, rest = text.partition("/")
        own = own.lower()
        fit = ((h == own) | h.endswith(f".{own}")) & p.startswith(sep + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(text)).alias("n"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits, F.lit(None)) if len(fits) > 1 else fits[0] if fits else F.lit(None)


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level from the spread of its groups' rates, the ANOVA moment estimate held to 1..1000."""
    x = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    if not x["g"] or x["g"] < 2 or x["n"] <= x["g"]:
        return 10.0
    n, g, p = float(x["n"]), x["g"], x["bad"] / x["n"]
    between = (x["bb"] - n * p * p) / (g - 1)
    inside = (x["bad"] - x["bb"]) / (n - g)
    size = (n - x["nn"] / n) / (g - 1)
    spread = between + (size - 1) * inside
    rho = (between - inside) / spread if spread > 0 else 0.0
    return min(1000.0, max(1.0, 1 / rho - 1)) if rho > 0 else 1000.0


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per host of pages (host), with labels (id, bad): host, domain, suffix, n, bad, mean, lower."""
    bad = labels.groupBy("id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    seen = pages.join(bad, "id", "left")
    scratch = Scratch(pages.sparkSession)
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    parts = F.split("host", r"\.")
    hosts = hosts.withColumns({"suffix": F.element_at(parts, -1), "domain": F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.col("host"))})
    hosts = scratch.write(hosts, "hosts")  # the three strengths, the total and the result all start from here
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k_host, k_domain, k_suffix = _strength(hosts), _strength(domains), _strength(suffixes)
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    shrunk = lambda prior, k: (F.col("bad") + k * prior) / (F.col("n") + k)
    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), k_suffix).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate"), k_domain).alias("domain_rate"))
    a, b = F.col("bad") + k_host * F.col("domain_rate"), F.col("n") - F.col("bad") + k_host * (1 - F.col("domain_rate"))
    out = hosts.join(domains, ["domain", "suffix"]).withColumns({"mean": a / (a + b), "sd": F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))})
    return out.select("host", "domain", "suffix", "n", "bad", "mean", (F.col("mean") - Z * F.col("sd")).alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, path, rule, lower (posterior bound of the host's bad rate) and verdict; labels: id, bad."""
    kept = keep_names(pages, ["host", "path", "rule", "lower", "verdict"])
    u = F.col(f"`{url}`")
    held = pages.select(*[F.col(f"`{c}`") for c in kept], host(u).alias("host"), path(u).alias("path"))
    known = reputation(held.select(F.col(f"`{page_id}`").alias("id"), "host"), labels).select("host", "lower")
    fit = rule(F.col("host"), F.col("path"), rules)
    mark = inner("fit", kept)
    out = held.withColumn(mark, fit).join(known, "host", "left")
    verdict = F.coalesce(F.col(f"{mark}.verdict"), F.when(F.col("lower") > threshold, "block").otherwise("allow"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col(f"{mark}.rule").alias("rule"), "lower", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages are the labels under their id: bad is toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    return judge(pages, labels).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, table: str) -> str:
    s = f"(select sum(n)::double n, sum(bad)::double bad, count(*)::double g, sum(n*n)::double nn, sum(bad*bad/n::double) bb from {table} where n > 0)"
    between, inside, size = "((bb - bad*bad/n) / (g-1))", "((bad - bb) / (n-g))", "((n - nn/n) / (g-1))"
    rho = f"(case when {between} + ({size}-1)*{inside} > 0 then ({between} - {inside}) / ({between} + ({size}-1)*{inside}) else 0 end)"
    return f"{name} as (select case when coalesce(g, 0) < 2 or n <= g then 10.0::double when {rho} > 0 then least(1000.0, greatest(1.0, 1/{rho} - 1)) else 1000.0 end k from {s})"


_FITS = ", ".join(f"case when (host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}') then {{'n': {len(t)}, 'rule': '{t}', 'verdict': '{v}'}} end" for v, t in RULES)
#: DuckDB SQL of query().
ORACLE = rf"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path from pages),
l as (select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) bad from labels group by 1),
h as (select host, count(bad) n, coalesce(sum(bad), 0) bad, string_split(host, '.')[-1] suffix, case when len(string_split(host, '.')) > 1 then array_to_string(string_split(host, '.')[-2:], '.') else host end domain from p left join l on doc_id = page_id group by host),
d as (select suffix, domain, sum(n) n, sum(bad) bad from h group by 1, 2), s as (select suffix, sum(n) n, sum(bad) bad from d group by 1),
{_level("kh", "h")}, {_level("kd", "d")}, {_level("ks", "s")},
sr as (select suffix, (bad + k * (select (sum(bad) + 1.0::double) / (sum(n) + 2) from s)) / (n + k) r from s, ks),
dr as (select d.suffix, domain, (bad + k * r) / (n + k) r from d join sr using (suffix), kd),
ab as (select host, bad + k * r a, n - bad + k * (1 - r) b from h join dr using (suffix, domain), kh),
v as (select host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) lower from ab),
f as (select p.*, lower, list_max(list_filter([{_FITS}], lambda x: x is not null)) fit from p join v using (host))
select page_id, host, path, fit.rule as rule, coalesce(fit.verdict, case when lower > {THRESHOLD} then 'block' else 'allow' end) verdict from f
"""
