"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule accepts or rejects train one model each.  Both are character
models of variable order: the longest context of up to three symbols that was
seen ``MIN_CONTEXT`` times gives the probability, smoothed by the method of
Witten and Bell towards the next shorter one.  A URL without a rule is accepted
if its log-likelihood difference, divided by its length, reaches a threshold
that is calibrated on the URLs with rules.  DataFrame functions only.

URLs are written in ``SYMBOLS`` and two more signs, for the start and for all
else, so a model has at most ``BASE ** 4`` entries (2.8 million, of 24 bytes)
whatever the number of URLs: the tables that are broadcast are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789/.-"
BASE = len(SYMBOLS) + 2
ORDER = 4
MIN_CONTEXT = 4

#: Fixed values: (host, path, verdict); a rule fits its host and all subdomains.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def _ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; the first by name among equally long ones."""
    rule = verdict = None
    for h, p, v in reversed(_ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, v).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


#: Characters that a task takes, about.
TASK_CHARS = 1 << 18


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row ``code`` per character: its symbol and the three before it, as a number to the base BASE."""
    symbols = F.expr(f"transform(filter(split(lower(url), ''), c -> c <> ''), c -> coalesce(nullif(instr('{SYMBOLS}', c), 0), {BASE - 1}))")
    padded = urls.select(*keep, F.concat(F.array_repeat(F.lit(0), ORDER - 1), symbols).alias("s"))
    code = " + ".join(f"cast(s[i + {k}] as long) * {BASE ** (ORDER - 1 - k)}" for k in range(ORDER))
    return padded.where(f"size(s) >= {ORDER}").select(*keep, F.explode(F.expr(f"transform(sequence(0, size(s) - {ORDER}), i -> {code})")).alias("code"))


def fit(labelled: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The models as log ratios: tables ``(code, v)`` of n-grams for n = 1 to ORDER, and ``(context, d)`` of back-off weights for n = 2 to ORDER.

    labelled: ``url, verdict`` (allow or block).
    """
    sides = ("a", "r")
    counted = _grams(labelled, "verdict").groupBy("code").agg(*[F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(s) for s, v in zip(sides, ("allow", "block"), strict=True)])
    counted = materialize(counted, "ngrams")
    one = counted.groupBy((F.col("code") % BASE).alias("code")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    symbols = labelled.sparkSession.range(BASE).select(F.col("id").alias("code")).join(one, "code", "left").na.fill(0, ["a", "r"])
    total = one.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sides]).first()
    shorter = materialize(symbols.select("code", *[((F.col(s) + 1) / F.lit(float(total[s] + BASE))).alias(f"p{s}") for s in sides]), "order1")
    ratio = (F.log("pa") - F.log("pr")).alias("v")
    grams, backs = [shorter.select("code", ratio)], []
    for n in range(2, ORDER + 1):
        seen = counted.groupBy((F.col("code") % BASE**n).alias("code")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("context", F.expr(f"code div {BASE}"))
        contexts = seen.groupBy("context").agg(*[F.sum(s).alias(f"n{s}") for s in sides], *[F.sum((F.col(s) > 0).cast("long")).alias(f"t{s}") for s in sides]).where(f"na + nr >= {MIN_CONTEXT}")
        contexts = materialize(contexts, "contexts")
        lower = shorter.select(F.col("code").alias("suffix"), *[F.col(f"p{s}").alias(f"q{s}") for s in sides])
        p = [F.when(F.col(f"n{s}") == 0, F.col(f"q{s}")).otherwise((F.col(s) + F.col(f"t{s}") * F.col(f"q{s}")) / F.greatest(F.col(f"n{s}") + F.col(f"t{s}"), F.lit(1))).alias(f"p{s}") for s in sides]
        shorter = seen.join(F.broadcast(contexts), "context").withColumn("suffix", F.col("code") % BASE ** (n - 1)).join(F.broadcast(lower), "suffix").select("code", *p)
        shorter = materialize(shorter, f"order{n}")
        back = [F.when(F.col(f"n{s}") == 0, 0.0).otherwise(F.log(F.col(f"t{s}") / F.greatest(F.col(f"n{s}") + F.col(f"t{s}"), F.lit(1)))) for s in sides]
        grams.append(shorter.select("code", ratio))
        backs.append(contexts.select("context", (back[0] - back[1]).alias("d")))
    return grams, backs


def score(urls: DataFrame, grams: list[DataFrame], backs: list[DataFrame]) -> DataFrame:
    """``url, score``: mean log ratio of the characters of each URL; an empty one has no row."""
    rows = _grams(urls, "url")
    for n, table in enumerate(grams, 1):
        rows = rows.join(F.broadcast(table.select(F.col("code").alias(f"c{n}"), F.col("v").alias(f"v{n}"))), F.col("code") % BASE**n == F.col(f"c{n}"), "left")
    for n, table in enumerate(backs, 2):
        rows = rows.join(F.broadcast(table.select(F.col("context").alias(f"x{n}"), F.col("d").alias(f"d{n}"))), F.expr(f"(code % {BASE**n}) div {BASE}") == F.col(f"x{n}"), "left")
    value = F.col("v1")
    for n in range(2, ORDER + 1):
        value = F.coalesce(F.col(f"v{n}"), F.coalesce(F.col(f"d{n}"), F.lit(0.0)) + value)
    return rows.groupBy("url").agg(F.avg(value).alias("score"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Verdict of each page's URL: ``page_id, host, path, rule, verdict, score``.

    pages: ``page_id, url`` (other columns are not read); one row per row.  A null or empty URL, or
    one without ``://``, has an empty host and path; without a score it is allowed, as are all URLs
    without a rule if no URL is accepted by rule or none rejected.  Very long URLs are taken whole.  Of
    rules of equal length that fit, the first by name holds; a score equal to the threshold is allowed.
    Repeated rows have one verdict.  An empty table gives no rows.  Rules are at most some hundreds.
    """
    host, path = address(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    urls = materialize(rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n"), F.min("ruled").alias("verdict")), "urls")
    # A row becomes as many as it has characters; dealt by URL they need no shuffle to be summed.
    size = urls.agg(F.coalesce(F.sum(F.length("url")), F.lit(0))).first()[0]
    urls = urls.repartition(max(1, -(-size // TASK_CHARS)), "url")
    grams, backs = fit(urls.where("verdict is not null"))
    scores = materialize(score(urls, grams, backs), "scores")

    # Calibration: between the means of both sides, in the proportion of their deviations.
    sides = {r["verdict"]: r for r in urls.where("verdict is not null").join(scores, "url").groupBy("verdict").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    threshold = None
    if len(sides) == 2:
        a, r = sides["allow"], sides["block"]
        wide = a["s"] + r["s"]
        threshold = (a["m"] * r["s"] + r["m"] * a["s"]) / wide if wide else (a["m"] + r["m"]) / 2
    unlike = F.lit(False) if threshold is None else F.coalesce(F.col("score") < threshold, F.lit(False))
    judged = rows.join(scores, "url", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(unlike, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))


def filter_urls_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for the query over pages."""
    cases = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in _ordered(rules)]
    pick = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[k]}'" for c in cases) + " END"
    code = " + ".join(f"s[i + {k + 1}] * {BASE ** (ORDER - 1 - k)}" for k in range(ORDER))
    parts = f"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path FROM pages),
r AS (SELECT *, {pick(1)} AS rule, {pick(2)} AS ruled FROM p),
u AS (SELECT url, min(ruled) AS verdict FROM r WHERE url IS NOT NULL GROUP BY url),
t AS (SELECT url, verdict, list_concat([0, 0, 0], list_transform(list_filter(string_split(lower(url), ''), lambda c: c <> ''),
  lambda c: CASE WHEN instr('{SYMBOLS}', c) = 0 THEN {BASE - 1} ELSE instr('{SYMBOLS}', c) END))::BIGINT[] AS s FROM u),
g AS MATERIALIZED (SELECT url, verdict, unnest(list_transform(range(0, len(s) - {ORDER - 1}), lambda i: {code})) AS code FROM t WHERE len(s) >= {ORDER}),
n AS MATERIALIZED (SELECT code, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS r FROM g WHERE verdict IS NOT NULL GROUP BY code),
n1 AS (SELECT code % {BASE} AS code, sum(a) AS a, sum(r) AS r FROM n GROUP BY 1),
g1 AS (SELECT x.code, (coalesce(a, 0) + 1)::DOUBLE / (coalesce((SELECT sum(a) FROM n1), 0) + {BASE}) AS pa,
  (coalesce(r, 0) + 1)::DOUBLE / (coalesce((SELECT sum(r) FROM n1), 0) + {BASE}) AS pr FROM range({BASE}) AS x(code) LEFT JOIN n1 ON n1.code = x.code)"""
    for k in range(2, ORDER + 1):
        prob = lambda s: f"CASE WHEN n{s} = 0 THEN q.p{s} ELSE ({s} + t{s} * q.p{s}) / (n{s} + t{s}) END AS p{s}"
        parts += f""",
n{k} AS (SELECT code % {BASE**k} AS code, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM n GROUP BY 1),
x{k} AS MATERIALIZED (SELECT code // {BASE} AS context, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0)::DOUBLE AS ta, count(*) FILTER (r > 0)::DOUBLE AS tr
  FROM n{k} GROUP BY 1 HAVING sum(a) + sum(r) >= {MIN_CONTEXT}),
g{k} AS MATERIALIZED (SELECT n{k}.code, {prob("a")}, {prob("r")} FROM n{k} JOIN x{k} ON n{k}.code // {BASE} = x{k}.context JOIN g{k - 1} AS q ON q.code = n{k}.code % {BASE ** (k - 1)}),
d{k} AS (SELECT context, CASE WHEN na = 0 THEN 0 ELSE ln(ta / (na + ta)) END - CASE WHEN nr = 0 THEN 0 ELSE ln(tr / (nr + tr)) END AS d FROM x{k})"""
    value = "ln(g1.pa) - ln(g1.pr)"
    for k in range(2, ORDER + 1):
        value = f"coalesce(ln(g{k}.pa) - ln(g{k}.pr), coalesce(d{k}.d, 0) + {value})"
    joins = " ".join(f"LEFT JOIN g{k} ON g{k}.code = g.code % {BASE**k}" for k in range(1, ORDER + 1)) + " " + " ".join(f"LEFT JOIN d{k} ON d{k}.context = (g.code % {BASE**k}) // {BASE}" for k in range(2, ORDER + 1))
    return parts + f""",
s AS MATERIALIZED (SELECT url, avg({value}) AS score FROM g {joins} GROUP BY url),
m AS (SELECT verdict, avg(score) AS m, stddev_pop(score) AS s FROM u JOIN s USING (url) WHERE verdict IS NOT NULL GROUP BY verdict),
c AS (SELECT CASE WHEN a.s + b.s > 0 THEN (a.m * b.s + b.m * a.s) / (a.s + b.s) ELSE (a.m + b.m) / 2 END AS threshold
  FROM m AS a, m AS b WHERE a.verdict = 'allow' AND b.verdict = 'block')
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score < (SELECT threshold FROM c) THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score
FROM r LEFT JOIN s USING (url)"""
