"""Export rows keep their cells' values, and a plan reads each cell once."""

from pyspark.sql import functions as F

from catalog_engine.sources import readers

HEADERS = ["店铺名称", "Brand Name", "商品ASIN", "avg_price", "评分", "Review Count", "上架时间", "月销量", "note", "_texts"]
CELLS = [
    ("N/A", " Acme   Inc ", "b000000001", "$1,234.56", "4.5", "1,200", "2024/3/7", "12k", "x", 1),
    (" Shop\tOne ", "-", " B000000002 ", "(usd 5)", "4.5+", "3万", "2024-03-07", "1.5 m+", " - ", 2),
    (None, None, "B00", "usdt 5", "n/a", "--", "20240307", "千", None, 3),
    ("none", "B", None, "CNY 8.12345", ".5", "5.", "3/7/2024", "usd usd 7", "", 4),
]
WANT = [
    ("Acme Inc", "Acme Inc", "B000000001", 1234.56, 4.5, 1200.0, "2024-03-07", 12000.0, "x", 1),
    ("Shop One", None, "B000000002", -5.0, 4.5, 30000.0, "2024-03-07", 1500000.0, " - ", 2),
    (None, None, None, None, None, None, "2024-03-07", None, None, 3),
    ("B", "B", None, 8.1235, 0.5, 5.0, "2024-03-07", 7.0, "", 4),
]


def test_competitor_cells_are_read_once(spark):
    out = readers.competitor_rows(spark.createDataFrame(CELLS, ", ".join(f"`{h}` {'int' if h == '_texts' else 'string'}" for h in HEADERS)))
    own = ["seller", "brand", "asin", "price", "rating", "review_count", F.col("launch_date").cast("string"), "monthly_sales", "note", "_texts"]
    assert [tuple(r) for r in out.select(*own).collect()] == WANT
    assert {"title", "monthly_revenue", "seller_product_count"} < set(out.columns) and out.filter("title is not null or monthly_revenue is not null").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 20, "cells are worked out again in every place that reads them"
