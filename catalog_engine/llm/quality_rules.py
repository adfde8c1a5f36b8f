"""Quality rules: a threshold table compiled into one projection of built-in functions.

Counting (words, symbols, lines, repeated windows) and the verdict are Spark
expressions on one row each; there is no shuffle, no user function and no join.

Defined results: null or empty text has zero counts and fails ``n_words``; texts
of any length are read whole; extra columns of the input are left alone. In
``apply_rules`` a column that clashes with a metric is replaced; ``keep`` returns
every input column as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import SPACE, free_name

WINDOW = 8
#: Frequent function words of the four languages of the corpus, as plain text.
STOP_WORDS = (
    "the of and to in a is that for it on was with as are be this have from at by or an not "
    "la le les de des du et un une que en est pour dans qui au sur pas ce "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las del y por con para se no su una lo como mas"
).split()


@dataclass(frozen=True)
class Rule:
    """Passes if low * divisor <= metric * scale <= high * divisor, all in whole numbers."""

    name: str
    metric: str
    divisor: str | None = None
    low: int | None = None
    high: int | None = None
    scale: int = 1


#: The threshold table. Ratios are per ``scale`` so that no floating point decides.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=16),
    Rule("symbol_ratio", "n_symbols", "n_words", high=10, scale=100),
    Rule("shout_ratio", "n_shouts", "n_words", high=30, scale=100),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=2, scale=100),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=40, scale=100),
)


def _verdict(rule: Rule) -> Column:
    value = F.col(rule.metric) * F.lit(rule.scale)
    per = F.col(rule.divisor) if rule.divisor else F.lit(1)
    checks = [F.lit(True)]
    if rule.low is not None:
        checks.append(value >= F.lit(rule.low) * per)
    if rule.high is not None:
        checks.append(value <= F.lit(rule.high) * per)
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the metrics of the threshold table (all long) to each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = {n: free_name(df, f"_{n}") for n in ("words", "windows", "sorted", "starts", "lines")}
    stops = [w for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize()))]
    out = df.withColumn(own["words"], F.array_remove(F.split(text, SPACE), ""))
    out = out.withColumn(
        own["windows"],
        F.when(F.size(own["words"]) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(own["words"]) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(own["words"], i, WINDOW)))),
    )
    # windows that occur again, as (hash, position) pairs in order of hash
    again = F.size(F.array_distinct(own["windows"])) < F.size(own["windows"])
    out = out.withColumn(own["sorted"], F.when(again, F.array_sort(F.transform(own["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twin(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(own["sorted"], k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(own["sorted"], k + 1)["h"] == x["h"], F.lit(False))

    out = out.withColumn(own["starts"], F.array_sort(F.transform(F.filter(own["sorted"], twin), lambda x: x["i"])))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(own["lines"], lines)
    covered = F.aggregate(
        F.transform(own["starts"], lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(own["starts"], k + 1) - s, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    out = out.withColumns(
        {
            "n_words": F.size(own["words"]).cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size(own["lines"]).cast("long"),
            "n_dup_lines": (F.size(own["lines"]) - F.size(F.array_distinct(own["lines"]))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_shouts": F.size(F.filter(own["words"], lambda w: w.endswith("!!"))).cast("long"),
            "n_stop_words": F.size(F.filter(own["words"], lambda w: w.isin(stops))).cast("long"),
        }
    )
    return out.drop(*own.values())


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input with metrics, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measure(df, text_col)
    return out.withColumns(
        {
            "base_failed": base,
            "failed_rules": F.array_compact(F.array(*[F.when(~_verdict(r), F.lit(r.name)) for r in rules])),
        }
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that pass, with the columns they came with."""
    # the row number keeps the optimizer from copying the whole projection into a filter below it
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"), F.col(text_col).alias("text"))
    judged = apply_rules(whole).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter("kept and _row >= 0").select("input.*")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the digest of ``documents``."""
    word, space = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize())))
    tests = []
    for r in rules:
        value, per = f"{r.metric} * {r.scale}", r.divisor or "1"
        tests += [f"{value} >= {r.low} * {per}"] if r.low is not None else []
        tests += [f"{value} <= {r.high} * {per}"] if r.high is not None else []
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS ls FROM d
), win AS (
  SELECT rid, p, list_aggregate(list_slice(ws, p, p + 7), 'string_agg', ' ') AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS p FROM w WHERE len(ws) > 8)
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - p, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: x LIKE '%!!'))::BIGINT AS n_shouts,
         len(list_filter(ws, lambda x: x IN ({stops})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(tests)}) AS kept
FROM b"""
