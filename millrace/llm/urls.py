"""URL filters: host rules first, then Empirical-Bayes host reputation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized

#: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A page is bad if its text has more runs of symbols than a tenth of its words, or more capitals than three tenths of its
#: letters (A-Z), or if its path has an empty segment, as crawler traps do.
SYMBOLS, CAPITALS = 0.1, 0.3
#: Second labels under a two-letter one that belong to the suffix.
SECOND = "ac|co|com|edu|gov|net|org"
#: Standard errors below the posterior mean; the bound from which a host is blocked; limits of a prior's weight, in pages.
Z, LIMIT, WEIGHTS = 1.645, 0.5, (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first `://`: the host, A-Z lower-cased, and the path without query and fragment; else both empty."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host + path) that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


#: Regular expressions that Java and RE2 read alike.
TAG, RUN, WORD, TRAP = "<[^>]*>", "[!$%*#?]{2,}", "[^\\x20\\x09-\\x0D]+", "//"
USER, PORT, DOTS = "^.*@", ":[0-9]*$", "[.]+$"
ADDRESS, LONG, SHORT, FIRST = "^[0-9.]+$|^[\\[]", f"[^.]+[.]({SECOND})[.][a-z][a-z]$", "[^.]*[.][^.]*$", "^[^.]*[.]?"


def page_outcomes(pages: DataFrame) -> DataFrame:
    """pages(host, path, html) to (host, bad): every page's outcome, from its own text and path; null where html is null.

    So a host may have pages of both kinds, whatever its name.
    """
    text = F.regexp_replace("html", TAG, " ")
    count = lambda c, rx: F.regexp_count(c, F.lit(rx))
    p = pages.select("host", "path", text.alias("_text"))
    p = p.select("host", "path", *[count(F.col("_text"), rx).alias(n) for n, rx in (("marks", RUN), ("words", WORD), ("up", "[A-Z]"), ("letters", "[A-Za-z]"))])
    bad = (F.col("marks") > SYMBOLS * F.col("words")) | (F.col("up") > CAPITALS * F.col("letters")) | F.col("path").rlike(TRAP)
    return p.select("host", F.when(F.col("marks").isNotNull(), bad.cast("long")).alias("bad"))


def site(host: Column) -> Column:
    """A host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, USER, ""), PORT, ""), DOTS, "")


def domain_of(name: Column) -> Column:
    """The registered domain: a label before the suffix, which has two labels in names such as a.co.uk; addresses and single labels whole."""
    long, short = F.regexp_extract(name, LONG, 0), F.regexp_extract(name, SHORT, 0)
    return F.when(name.rlike(ADDRESS), name).when(long != "", long).when(short != "", short).otherwise(name)


def suffix_of(domain: Column) -> Column:
    """What follows a domain's first label; addresses and single labels share the empty suffix."""
    return F.when(domain.rlike(ADDRESS), "").otherwise(F.regexp_replace(domain, FIRST, ""))


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes(host, bad) to (host, n, bad, bad_bound), a row a host, without user and port.

    Each level's rate shrinks to the one above it: suffix to all pages,
    registered domain to its suffix, host to its domain. The
    weight of a level's beta prior, in pages, comes from its children's rates by
    moments, between WEIGHTS. bad_bound is the host's posterior mean less Z
    posterior standard deviations. Null outcomes count nowhere; counts are partial
    sums, so that a hot host costs a row a task.
    """
    h = outcomes.where("host IS NOT NULL AND bad IS NOT NULL").groupBy(site(F.col("host")).alias("host")).agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    h = materialize(h.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))))
    d = materialize(h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    s = materialize(d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))

    def weight(level: DataFrame, name: str) -> DataFrame:
        t = level.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
        p = (F.col("tk") + 0.5) / (F.col("tn") + 1)
        v = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("p"), F.lit(2))) / F.sum("n")
        w = level.crossJoin(F.broadcast(t.select(p.alias("p")))).groupBy("p").agg(v.alias("v"))  # one row of totals
        m = F.when(F.col("v") > 0, F.col("p") * (1 - F.col("p")) / F.col("v") - 1).otherwise(WEIGHTS[1])
        return w.select("p", F.least(F.lit(WEIGHTS[1]), F.greatest(F.lit(WEIGHTS[0]), m)).alias(name))

    ws, wd, wh = (F.broadcast(materialize(weight(x, n))) for x, n in ((s, "ws"), (d, "wd"), (h, "wh")))
    s = s.crossJoin(ws).select("suffix", ((F.col("k") + F.col("ws") * F.col("p")) / (F.col("n") + F.col("ws"))).alias("suffix_rate"))
    d = d.join(s, "suffix").crossJoin(wd.select("wd")).select("domain", "suffix", ((F.col("k") + F.col("wd") * F.col("suffix_rate")) / (F.col("n") + F.col("wd"))).alias("rate"))
    a, b = F.col("k") + F.col("wh") * F.col("rate"), F.col("n") - F.col("k") + F.col("wh") * (1 - F.col("rate"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.join(d, ["domain", "suffix"]).crossJoin(wh.select("wh")).select("host", "n", F.col("k").alias("bad"), (a / (a + b) - Z * sd).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """pages(page_id, url) to (page_id, host, path, rule, verdict, bad_bound), a row for each.

    The longest fitting rule decides; else a host is blocked if the lower bound of
    its rate of bad pages is `limit` or more. outcomes: (host, bad) of labelled
    pages, by default page_outcomes(). Hosts without outcomes are allowed and have a
    null bound. Null urls have an empty host and path.
    """
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    if outcomes is None:
        html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
        outcomes = page_outcomes(pages.select(host.alias("host"), path.alias("path"), html.alias("html")))
    known = materialize(reputation(outcomes).select(F.col("host").alias("_host"), "bad_bound"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") >= limit, F.lit("block")).otherwise("allow")
    joined = p.join(sized(known), site(p["host"]) == known["_host"], "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bad_bound", 6).alias("bad_bound"))


def judge_sql() -> str:
    """judge() over the table pages, for DuckDB."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fit = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    case = lambda i, last: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fit) + f" ELSE {last} END"
    low, high = WEIGHTS
    weight = lambda t, p: f"(SELECT CASE WHEN v > 0 THEN least({high}::DOUBLE, greatest({low}::DOUBLE, p * (1 - p) / v - 1)) ELSE {high}::DOUBLE END FROM (SELECT {p} AS p, sum(n * pow(k / n - {p}, 2)) / sum(n) AS v FROM {t}))"
    site_of = lambda h: f"regexp_replace(regexp_replace(regexp_replace({h}, '{USER}', ''), '{PORT}', ''), '{DOTS}', '')"
    count = lambda rx: f"len(regexp_extract_all(t, '{rx}'))"
    return f"""
WITH u AS (SELECT page_id, regexp_replace(html, '{TAG}', ' ', 'g') AS t, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT page_id, t, translate(regexp_extract(a, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT {site_of('host')} AS host, CASE WHEN {count(RUN)} > {SYMBOLS} * {count(WORD)} OR {count('[A-Z]')} > {CAPITALS} * {count('[A-Za-z]')} OR regexp_matches(path, '{TRAP}') THEN 1 ELSE 0 END AS bad FROM p WHERE t IS NOT NULL),
g AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM o GROUP BY 1),
q AS (SELECT *, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN host WHEN regexp_extract(host, '{LONG}', 0) <> '' THEN regexp_extract(host, '{LONG}', 0)
      WHEN regexp_extract(host, '{SHORT}', 0) <> '' THEN regexp_extract(host, '{SHORT}', 0) ELSE host END AS domain FROM g),
h AS (SELECT *, CASE WHEN regexp_matches(domain, '{ADDRESS}') THEN '' ELSE regexp_replace(domain, '{FIRST}', '') END AS suffix FROM q),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
t AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS g FROM h),
w AS (SELECT g, {weight('s', 'g')} AS ws, {weight('d', 'g')} AS wd, {weight('h', 'g')} AS wh FROM t),
sr AS (SELECT suffix, (k + ws * g) / (n + ws) AS r FROM s, w),
dr AS (SELECT domain, suffix, (k + wd * r) / (n + wd) AS rate FROM d JOIN sr USING (suffix), w),
ab AS (SELECT host, k + wh * rate AS a, n - k + wh * (1 - rate) AS b FROM h JOIN dr USING (domain, suffix), w),
rep AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, p.host, path, {case(1, 'NULL').replace('host', 'p.host')} AS rule,
       {case(2, f"CASE WHEN bound >= {LIMIT} THEN 'block' ELSE 'allow' END").replace('host', 'p.host')} AS verdict, round(bound, 6) AS bad_bound
FROM p LEFT JOIN rep ON {site_of('p.host')} = rep.host"""
