"""URL filters: given rules first, then association rules mined from the urls that those rules label.

A url's tokens are its host's labels (`h:`) and its path's words (`p:`, numbers as `p:#`), each once. The urls that a given rule decides are labelled with its verdict;
FP-growth mines the token combinations that occur with a verdict in at least SUPPORT of them. A combination becomes a rule at CONFIDENCE, and stays one if no combination
with one token less says the same at least as surely. Rules are looked up by an inverted index: each is filed under its rarest token and compared with the urls
that have that token. The surest rule decides, then the one with more support, then block before allow; a url that no rule fits is allowed.

Null urls and urls without `://` have an empty host and path and no tokens, so they are allowed; a null page_id is carried along; equal urls are judged once and get the
same verdict; pages that no given rule decides, or an empty table, leave nothing to mine and all else allowed; columns beyond page_id and url play no part.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, written
from .merkle import LOWER, UPPER

Rule = tuple[str, str, str]
#: Verdict, host and path.
RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
SUPPORT, CONFIDENCE = 0.005, 0.8
SORTS = ["confidence", "support", "verdict", "why"]


def split_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    rows = pages.select("page_id", F.coalesce(after, F.lit("")).alias("rest")).withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), "^[^?#]*", 0)
    return rows.select("page_id", F.translate("host", UPPER, LOWER).alias("host"), path.alias("path"))


def decided(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows (host, path, ..) with the longest rule that fits, as rule (host and path) and given (its verdict), null where none does. The rules are a short list."""
    rule = given = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, given = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(given)
    return rows.withColumns({"rule": rule, "given": given})


def tokens() -> Column:
    """The distinct tokens of columns host and path."""
    words = f"filter(split(translate(path, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), x -> x <> '')"
    words = f"transform({words}, x -> CASE WHEN x rlike '^[0-9]+$' THEN 'p:#' ELSE concat('p:', x) END)"
    return F.expr(f"array_distinct(concat(transform(filter(split(host, '[.]'), x -> x <> ''), x -> concat('h:', x)), {words}))")


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame | None:
    """Rules from labelled urls (tokens, given): (antecedent, verdict, confidence, support, why, token: its rarest one); nothing where there are none."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "given"))).alias("items"))
    if items.isEmpty():
        return None
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where("consequent[0] LIKE '=%' AND NOT exists(antecedent, x -> x LIKE '=%')")
    rules = written(rules.selectExpr("array_sort(antecedent) AS antecedent", "substring(consequent[0], 2) AS verdict", "confidence", "support"))
    less = rules.select("antecedent", "verdict", F.col("confidence").alias("sure"))
    shorter = rules.where("size(antecedent) > 1").selectExpr("antecedent AS whole", "verdict", "confidence", "explode(transform(antecedent, t -> array_remove(antecedent, t))) AS antecedent")
    needless = shorter.join(less, ["antecedent", "verdict"]).where("sure >= confidence").select(F.col("whole").alias("antecedent"), "verdict").distinct()
    kept = rules.join(needless, ["antecedent", "verdict"], "left_anti")
    each = kept.select("*", F.explode("antecedent").alias("t")).join(model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("t"), "freq"), "t")
    return each.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min_by("t", F.struct("freq", "t")).alias("token")).withColumn("why", F.array_join("antecedent", " "))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls (host, path, tokens) that a mined rule fits, with the one that decides: (host, path, by)."""
    filed = urls.select("host", "path", "tokens", F.explode("tokens").alias("token")).join(rules, "token")
    fitting = filed.where("size(array_except(antecedent, tokens)) = 0")
    return fitting.groupBy("host", "path").agg(F.max(F.struct(*SORTS)).alias("by"))


def judged(pages: DataFrame, rules: list[Rule] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, and what a mined verdict rests on: why (its tokens) and confidence."""
    with Scratch(pages.sparkSession) as made:
        rows = written(decided(split_urls(pages), rules).withColumn("tokens", tokens()))
        found = mined(rows.where("given IS NOT NULL"), support, confidence)
        if found is None:
            out = rows.selectExpr("*", "coalesce(given, 'allow') AS verdict", "cast(NULL AS string) AS why", "cast(NULL AS double) AS confidence")
        else:
            by = matched(rows.where("given IS NULL").select("host", "path", "tokens").distinct(), written(found))
            rest = rows.where("given IS NULL").join(by, ["host", "path"], "left").withColumn("given", F.col("by.verdict"))
            both = rest.unionByName(rows.where("given IS NOT NULL"), allowMissingColumns=True)
            out = both.selectExpr("*", "coalesce(given, 'allow') AS verdict", "by.why", "by.confidence")
        return made.outlive(out.select("page_id", "host", "path", "rule", "verdict", "why", "confidence"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _case(column: str) -> str:
    whens = [f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v if column == 'given' else h + p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"CASE {' '.join(whens)} END AS {column}"


#: All token combinations of the labelled urls, counted, stand for the mined ones.
SQL = rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
u AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM hp),
r AS (SELECT *, {_case('rule')}, {_case('given')},
 list_distinct(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
 || list_transform(list_filter(regexp_split_to_array(translate(path, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'p:#' ELSE 'p:' || x END)) AS tokens FROM u),
lab AS (SELECT given, list_sort(tokens) AS tokens FROM r WHERE given IS NOT NULL),
subs AS (SELECT given, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM (SELECT *, unnest(range(1, CAST(2 ** len(tokens) AS BIGINT))) AS mask FROM lab)),
cnt AS (SELECT items, v AS verdict, count(*) AS n, count(*) FILTER (given = v) AS both_n, (SELECT count(*) FROM lab) AS total FROM subs, (VALUES ('allow'), ('block')) t(v) GROUP BY ALL),
rules AS (SELECT items, verdict, CAST(both_n AS DOUBLE) / n AS confidence, CAST(both_n AS DOUBLE) / total AS support FROM cnt WHERE both_n >= ceil({SUPPORT}::DOUBLE * total) AND CAST(both_n AS DOUBLE) / n >= {CONFIDENCE}),
less AS (SELECT items, verdict, confidence, list_filter(items, lambda x, j: j <> i) AS part FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM rules)),
kept AS (SELECT * FROM rules WHERE (items, verdict) NOT IN (SELECT (less.items, less.verdict) FROM less JOIN rules q ON q.items = part AND q.verdict = less.verdict WHERE q.confidence >= less.confidence)),
fit AS (SELECT host, path, verdict, array_to_string(items, ' ') AS why, confidence, support FROM (SELECT DISTINCT host, path, tokens FROM r WHERE given IS NULL) JOIN kept ON list_has_all(tokens, items)),
win AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY confidence DESC, support DESC, verdict DESC, encode(why) DESC) = 1)
SELECT page_id, r.host, r.path, rule, coalesce(given, verdict, 'allow') AS verdict, why, confidence FROM r LEFT JOIN win ON given IS NULL AND win.host = r.host AND win.path = r.path"""
