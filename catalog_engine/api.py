"""SQL surface: domain tables as views and formulas as SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as nm
from .functions import scores
from .plan_udtf import QueryPlanTable
from .plans import fixtures
from .rules import COST, SCORE

_K = math.log(19) / (SCORE.profit_ceiling - SCORE.profit_target)

_TOTAL = "100D * (" + " + ".join(f"{w}D * {n}" for n, w in SCORE.weights) + ")"

#: Name, parameters, result type and body of each function.
FUNCTIONS = (
    ("positive_number", "x DOUBLE", "DOUBLE", "CASE WHEN x > 0 AND NOT isnan(x) AND x < double('Infinity') THEN x END"),
    (
        "tier_price",
        "tiers ARRAY<STRUCT<min_qty: DOUBLE, price_cny: DOUBLE>>, base DOUBLE, qty DOUBLE",
        "DOUBLE",
        "coalesce(get(array_sort(filter(tiers, t -> t.min_qty > 0 AND t.price_cny > 0 AND t.min_qty <= qty), (a, b) -> CASE WHEN a.min_qty > b.min_qty THEN -1 WHEN a.min_qty < b.min_qty THEN 1 ELSE 0 END), 0).price_cny, "
        "get(array_sort(filter(tiers, t -> t.min_qty > 0 AND t.price_cny > 0), (a, b) -> CASE WHEN a.min_qty < b.min_qty THEN -1 WHEN a.min_qty > b.min_qty THEN 1 ELSE 0 END), 0).price_cny, base)",
    ),
    ("purchase_cost", "price_cny DOUBLE", "DOUBLE", f"price_cny * {COST.cny_to_usd}D"),
    ("score_profit", "margin DOUBLE", "DOUBLE", f"CASE WHEN margin <= {SCORE.profit_floor} THEN 0D WHEN margin >= {SCORE.profit_ceiling} THEN 1D ELSE 1D / (1D + exp(-{_K}D * (margin - {SCORE.profit_target}D))) END"),
    ("supplier_profit_score", "margin DOUBLE", "DOUBLE", "CASE WHEN margin <= 0 THEN 0D WHEN margin >= 0.40 THEN 1D ELSE round(margin / 0.40D, 4) END"),
    ("retry_backoff", "attempt INT", "DOUBLE", "least(2D * pow(2D, attempt - 1), 60D)"),
    ("total_score", ", ".join(f"{n} DOUBLE" for n, _ in SCORE.weights), "DOUBLE", _TOTAL),
    ("validate_asin", "s STRING", "STRING", "CASE WHEN upper(trim(s)) RLIKE '^[A-Z0-9]{10}$' THEN upper(trim(s)) END"),
)


_MEASURES = "weight DOUBLE, length DOUBLE, width DOUBLE, height DOUBLE"
#: Name, parameters and Column function of what SQL users get from the library's own definitions.
COLUMN_FUNCTIONS = (
    ("parse_numeric", "s STRING", lambda: nm.numeric_parts(F.col("s"))[0]),
    ("parse_lower_bound", "s STRING", lambda: nm.numeric_parts(F.col("s"))[1]),
    ("parse_numeric_simple", "s STRING", lambda: nm.numeric_simple(F.col("s"))),
    ("score_demand", "bsr_rank DOUBLE, monthly_sales DOUBLE, opportunity DOUBLE, search_volume DOUBLE, price DOUBLE, daily_sales DOUBLE", lambda: scores.score_demand(*map(F.col, ("bsr_rank", "monthly_sales", "opportunity", "search_volume", "price", "daily_sales")))),
    ("score_competition", "listings DOUBLE, top10_share DOUBLE", lambda: scores.score_competition(F.col("listings"), F.col("top10_share"))),
    (
        "score_supply",
        "n_offers DOUBLE, avg_repeat DOUBLE, min_moq DOUBLE, min_days DOUBLE, min_price DOUBLE, avg_match DOUBLE, factory_score DOUBLE, avg_sales DOUBLE, any_fba BOOLEAN",
        lambda: scores.score_supply(),
    ),
    ("score_logistics", _MEASURES, lambda: scores.score_logistics(*map(F.col, ("weight", "length", "width", "height")))),
    ("score_risk", "category STRING, brand STRING, title STRING, cv DOUBLE", lambda: scores.score_risk(*map(F.col, ("category", "brand", "title", "cv")))),
    ("opportunity_estimate", "volume DOUBLE, rate DOUBLE, difficulty DOUBLE", lambda: scores.opportunity_estimate(*map(F.col, ("volume", "rate", "difficulty")))),
)


def sql_body(spark: SparkSession, parameters: str, column: Column) -> str:
    """SQL text of a Column over columns named as the parameters."""
    rows = spark.createDataFrame([], parameters)
    whole = rows.select(column.alias("x"))._jdf.queryExecution().analyzed().expressions().head()
    return whole.child().sql()


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Creates the SQL functions, the table function query_plan_udtf, and the domain views if a folder of tables is given."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, column in COLUMN_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {sql_body(spark, parameters, column())}")
    spark.udtf.register("query_plan_udtf", QueryPlanTable)
    if sf_dir:
        for name in ("products", "offers", "competitors", "market"):
            getattr(fixtures, name)(spark, sf_dir).createOrReplaceTempView(name)
