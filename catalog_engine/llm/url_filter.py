"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that any URL it fits
must contain. Tokens of all URLs are counted once, each rule is filed under its
rarest token, the tokens of a URL fetch candidate rules by an equi-join, and only
those run their expressions. A verdict is a function of the URL alone, so the work
is done once per distinct (host, path), and joined back.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule and the default verdict; repeated rows are judged alike; with no rules every
URL gets the default; of rules that fit, the most specific tier wins, then the
longest rule, then the first by name. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """regex runs on host + path with the host lower-cased; tokens are whole [a-z0-9]+ runs of the lower-cased URL."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    tier: int = 0


def site_rule(verdict: str, rule: str) -> UrlRule:
    """A host with its subdomains and a path prefix, such as example.org/en/1."""
    host, _, path = rule.partition("/")
    path = "/" + path
    whole = path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]  # the last run may go on in the URL
    tokens = dict.fromkeys(re.findall("[a-z0-9]+", (host + whole).lower()))
    return UrlRule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), 1)


def word_rule(verdict: str, word: str) -> UrlRule:
    """A word of the host name, alone or joined by hyphens."""
    return UrlRule(f"*{word}*", verdict, rf"^[^/]*(?:^|[.-]){word}(?:[.-]|/|$)", (word,))


#: The contract's host and path rules, then word rules for kinds of site that training text should not come from.
RULES = tuple(site_rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))) + tuple(
    word_rule("block", w) for w in ("casino", "bets", "adult", "porn", "xxx", "spam", "pills", "viagra", "ads", "malware", "phishing")
)


def rules_table(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    """The rules as rows of literals; their number is what the caller wrote."""
    lit = lambda x: F.lit(x)
    rows = F.array(
        *[
            F.struct(lit(r.name).alias("rule"), lit(r.verdict).alias("rule_verdict"), lit(r.regex).alias("regex"), F.array(*[lit(t) for t in r.tokens]).cast("array<string>").alias("tokens"), lit(r.tier).alias("tier"), lit(len(r.name)).alias("length"))
            for r in rules
        ]
    )
    return spark.range(1).select(F.inline(rows))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, rule_tier and verdict of every row."""
    spark = df.sparkSession
    url = F.col(url_col).cast("string")
    pages = df.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    # a page without a URL has no tokens, so no rule can fit it: it stays out of the shuffles
    blank = pages.filter("host = '' and path = ''")
    some = pages.filter("host <> '' or path <> ''")
    urls = some.groupBy("host", "path").count()
    # rules without a token (hosts in other scripts, say) are filed under the empty one, which every URL then has
    tokens = F.array_distinct(F.array_remove(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"), ""))
    if isinstance(rules, DataFrame) or any(not r.tokens for r in rules):
        tokens = F.array_append(tokens, F.lit(""))
    tokens = urls.withColumn("token", F.explode(tokens))
    table = rules if isinstance(rules, DataFrame) else (rules_table(spark, rules) if rules else None)
    if table is None:
        found = pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string"), "tier": F.lit(None).cast("int")})
    else:
        literals = table.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
        often = tokens.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("count").alias("often"))
        rarest = Window.partitionBy("rule", "regex").orderBy("often", "token")
        index = literals.join(often, "token", "left").fillna({"often": 0}).withColumn("nth", F.row_number().over(rarest)).filter("nth = 1")
        index = index.select("token", "rule", "rule_verdict", "regex", "tier", "length")
        hits = tokens.join(index, "token").filter(F.expr("concat(host, path) rlike regex"))
        best = F.max_by(F.struct("rule", "rule_verdict", "tier"), F.struct("tier", "length", "rule"))
        found = some.join(hits.groupBy("host", "path").agg(best.alias("best")), ["host", "path"], "left").select("page_id", "host", "path", "best.*")
        found = found.unionByName(blank, allowMissingColumns=True)
    return found.select("page_id", "host", "path", "rule", F.col("tier").alias("rule_tier"), F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns: rule is a host and path rule or null; pattern names the word rule that decided."""
    site = F.col("rule_tier") == 1
    return judged.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict", F.when(~site, F.col("rule")).alias("pattern"))


def _oracle_sql() -> str:
    sites = sorted((r for r in RULES if r.tier == 1), key=lambda r: -len(r.name))
    words = sorted((r for r in RULES if r.tier == 0), key=lambda r: (-len(r.name), r.name))
    words = sorted(words, key=lambda r: (len(r.name), r.name), reverse=True)
    case = lambda rs, out: "CASE " + " ".join(f"WHEN regexp_matches(host || path, '{r.regex.replace(chr(92) + '-', '-')}') THEN '{out(r)}'" for r in rs) + " END"
    return rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, {case(sites, lambda r: r.name)} AS rule, {case(sites, lambda r: r.verdict)} AS v, {case(words, lambda r: r.name)} AS word FROM p
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN word END AS pattern FROM r"""


ORACLE_SQL = _oracle_sql()
