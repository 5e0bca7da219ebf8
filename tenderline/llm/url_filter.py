"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only.

URLs that a rule allows train the model of accepted URLs, those that a rule blocks the model of rejected ones. Both are
variable-order Markov models over the characters after ``://``: order 3 backs off through 2, 1 and 0 to a uniform base by
Witten-Bell smoothing. Every four-character string of the table gets one whole number, the log ratio in millionths, so
sums do not depend on their order. A URL's score is its sum over its characters divided by their number. The threshold
is calibrated on the URLs that have a rule: it is the score that best tells the two apart (sensitivity plus
specificity, from a histogram of fixed bins).

Defined results: a null URL, or one without ``://``, has empty host and path and no rule; a null or empty URL has no
character to score and is allowed; equal URLs get equal verdicts, as scores are made once for each distinct URL; with no
rule-labelled URL of either kind every ratio is 0 and nothing beyond the rules is blocked. An empty table gives an empty
result; columns beside id and URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

#: (host, path, verdict). A rule's string is host and path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 3
#: The base spreads its mass evenly over so many characters.
ALPHABET = 256
UNIT = 1_000_000
#: Width of a calibration bin, in natural-log units a character, and the bins' range.
BIN, RANGE = 0.01, 20
#: A model of up to so many strings (about 10 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000

PAD, END = "\x02", "\x03"


def split_url(url: str) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    u = F.coalesce(F.col(url), F.lit(""))
    after = F.when(F.locate("://", u) > 0, F.substring(u, F.locate("://", u) + 3, F.length(u))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict): of the rules that fit, the one with the longest string; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strings(urls: DataFrame) -> DataFrame:
    """uid, verdict, n, g: the ORDER + 1 characters that end at each character of a URL and at its end."""
    at = F.locate("://", F.col("url"))
    body = F.lower(F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.col("url")))
    padded = F.concat(F.lit(PAD * ORDER), body, F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length("body") - ORDER), lambda i: F.substring(F.col("body"), i, ORDER + 1))
    return urls.withColumn("body", padded).select("uid", "verdict", "n", F.explode(grams).alias("g"))


def model(strings: DataFrame) -> DataFrame:
    """g -> llr: log(P accepted / P rejected) of the last character after the others, in millionths."""
    full = strings.groupBy("g").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(c) for v, c in (("allow", "a"), ("block", "r"))))
    lower = None
    for k in range(ORDER + 1):  # k characters of context
        t = full.groupBy(F.substring("g", ORDER + 1 - k, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        w = Window.partitionBy(F.substring("g", 1, k)) if k else Window.partitionBy()
        t = t.withColumn("below", F.substring("g", 2, k))
        for c in "ar":
            t = t.withColumn(f"n{c}", F.sum(c).over(w)).withColumn(f"t{c}", F.sum((F.col(c) > 0).cast("long")).over(w))
        if lower is None:
            t = t.withColumn("pa0", F.lit(1.0 / ALPHABET)).withColumn("pr0", F.lit(1.0 / ALPHABET))
        else:
            t = t.join(lower, "below")
        for c in "ar":
            total = F.col(f"n{c}") + F.col(f"t{c}")
            t = t.withColumn(f"p{c}", F.when(total > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}0")) / total).otherwise(F.col(f"p{c}0")))
        lower = t.select(F.col("g").alias("below"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"))
    return t.select("g", F.round(F.ln(F.col("pa") / F.col("pr")) * UNIT).cast("long").alias("llr"))


def judge(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (natural-log units a character; null where there is nothing to score)."""
    host, path = split_url("url")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", by_rule)
    urls = rows.where("url != ''").groupBy("url").agg(F.first("by_rule").alias("verdict"), F.count("*").alias("n"))
    # The strings multiply the rows, so the URLs are dealt out first, whatever their bytes; their number stands for them from here on.
    urls = materialize(spark, urls.repartition(parallelism(spark)).withColumn("uid", F.monotonically_increasing_id()), "urls")
    strings = _strings(urls)
    # With one kind of label only there is nothing to compare.
    kinds = {r[0] for r in urls.where("verdict is not null").groupBy("verdict").count().collect()}
    ratios = materialize(spark, model(strings), "url-model")
    if len(kinds) < 2:
        ratios = ratios.withColumn("llr", F.lit(0).cast("long"))
    if ratios.count() <= BROADCAST_ROWS:
        ratios = F.broadcast(ratios)
    scores = strings.join(ratios, "g").groupBy("uid").agg((F.sum("llr").cast("double") / F.count("*") / UNIT).alias("score"))
    scores = materialize(spark, urls.join(scores, "uid").select("url", "verdict", "n", "score"), "url-scores")
    limit = calibrate(scores)
    out = rows.join(scores.select("url", "score"), "url", "left")
    verdict = F.when(F.col("by_rule").isNotNull(), F.col("by_rule")).when(F.col("score") < limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def calibrate(scores: DataFrame) -> float:
    """The lower edge of the bin from which on URLs are accepted; one row comes to the driver."""
    b = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-int(RANGE / BIN))), F.lit(int(RANGE / BIN))).cast("long")
    bins = scores.where("verdict is not null").groupBy(b.alias("b")).agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")))
    before, everything = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    part = lambda v: F.sum(v).over(everything)
    below = lambda v: F.coalesce(F.sum(v).over(before), F.lit(0))
    bins = bins.withColumn("good", F.try_divide(below("block"), part("block")) - F.try_divide(below("allow"), part("allow")))
    best = bins.orderBy(F.col("good").desc_nulls_last(), "b").first()
    return best["b"] * BIN if best and best["good"] is not None else -float(RANGE)


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    when = lambda out: " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{out(h, p, v)}'" for h, p, v in rules)
    levels = []
    for k in range(ORDER + 1):
        below = f"JOIN l{k - 1} AS lower ON lower.g = substr(w.g, 2, {k})" if k else ""
        base = lambda c: f"lower.p{c}" if k else f"(1.0::DOUBLE / {ALPHABET})"  # noqa: B023, E731
        p = ", ".join(f"CASE WHEN n{c} + t{c} > 0 THEN ({c}::DOUBLE + t{c} * {base(c)}) / (n{c} + t{c}) ELSE {base(c)} END AS p{c}" for c in "ar")
        sums = ", ".join(f"sum({c}) OVER (PARTITION BY substr(g, 1, {k}))::BIGINT AS n{c}, sum(({c} > 0)::INT) OVER (PARTITION BY substr(g, 1, {k}))::BIGINT AS t{c}" for c in "ar")
        levels.append(f"g{k} AS (SELECT substr(g, {ORDER + 1 - k}, {k + 1}) AS g, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM f GROUP BY 1), w{k} AS (SELECT *, {sums} FROM g{k}), l{k} AS (SELECT w.g, {p} FROM w{k} AS w {below})")
    bound = int(RANGE / BIN)
    return f"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
x AS (SELECT *, CASE {when(lambda h, p, v: h + p)} END AS rule, CASE {when(lambda h, p, v: v)} END AS by_rule FROM h),
urls AS (SELECT url, any_value(by_rule) AS v, count(*) AS n FROM x WHERE url <> '' GROUP BY url),
b AS (SELECT *, repeat(chr(2), {ORDER}) || lower(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE url END) || chr(3) AS body FROM urls),
e AS (SELECT url, v, n, body, unnest(generate_series(1, length(body) - {ORDER})) AS i FROM b),
s AS (SELECT url, v, n, substr(body, i, {ORDER + 1}) AS g FROM e),
f AS (SELECT g, coalesce(sum(n) FILTER (v = 'allow'), 0) AS a, coalesce(sum(n) FILTER (v = 'block'), 0) AS r FROM s GROUP BY g),
{", ".join(levels)},
m AS (SELECT g, CASE WHEN (SELECT count(DISTINCT v) FROM urls) = 2 THEN round(ln(pa / pr) * {UNIT})::BIGINT ELSE 0 END AS llr FROM l{ORDER}),
sc AS (SELECT url, any_value(v) AS v, any_value(n) AS n, sum(llr)::DOUBLE / count(*) / {UNIT} AS score FROM s JOIN m USING (g) GROUP BY url),
bins AS (SELECT least(greatest(floor(score / {BIN}::DOUBLE), -{bound}), {bound})::BIGINT AS b, coalesce(sum(n) FILTER (v = 'allow'), 0)::BIGINT AS a, coalesce(sum(n) FILTER (v = 'block'), 0)::BIGINT AS r FROM sc WHERE v IS NOT NULL GROUP BY 1),
good AS (SELECT b, coalesce(sum(r) OVER w, 0)::DOUBLE / nullif(sum(r) OVER (), 0) - coalesce(sum(a) OVER w, 0)::DOUBLE / nullif(sum(a) OVER (), 0) AS good FROM bins WINDOW w AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT CASE WHEN good IS NULL THEN -{RANGE}::DOUBLE ELSE b * {BIN}::DOUBLE END AS cut FROM good ORDER BY good DESC NULLS LAST, b LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN by_rule IS NOT NULL THEN by_rule WHEN score < (SELECT cut FROM cut) THEN 'block' ELSE 'allow' END AS verdict, score
FROM x LEFT JOIN sc USING (url)
"""


SQL = _sql()
