"""Continuous scoring: product and offer rows arrive as streams, and each batch scores again only the products it touches.

Under ``path`` there are three tables in hash buckets of the asin: ``products`` and
``offers`` keep what has arrived, ``results`` the scores. A batch writes its rows under
its own number, reads the touched buckets only, keeps of these the touched products,
scores them from their newest rows, and appends results whose key is not there yet. The
key is a hash of the product and all its offers, so the same evidence is scored once. A
batch that comes again writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..plans.pipeline import score_products
from ..sources.buckets import BUCKETS, bucket, read_buckets, shuffles_removed, touched, write_buckets
from .events import continuous

PRODUCT_KEY, OFFER_KEY = ["asin"], ["asin", "offer_id"]


def _newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key by batch, then version; of equal ones the greatest."""
    own = [c for c in rows.columns if c not in (*keys, "batch", "bucket")]
    best = F.max_by(F.struct(*own), F.struct("batch", version, F.xxhash64(*own)))
    return rows.groupBy(*keys).agg(best.alias("row")).select(*keys, "row.*")


def fingerprints(products: DataFrame, offers: DataFrame) -> DataFrame:
    """(asin, result_key): changes whenever the product or one of its offers does; offers add up, so nothing is collected."""
    mine = products.select("asin", F.sha2(F.to_json(F.struct(*sorted(products.columns))), 256).alias("own"))
    line = offers.select("asin", F.xxhash64(F.to_json(F.struct(*sorted(offers.columns)))).cast("decimal(38,0)").alias("h"))
    sums = line.groupBy("asin").agg(F.count("*").alias("n"), F.sum("h").alias("s"), F.bit_xor(F.col("h").cast("long")).alias("x"))
    return mine.join(sums, "asin").select("asin", F.sha2(F.concat_ws("|", "asin", "own", "n", "s", "x"), 256).alias("result_key"))


def score_batch(products: DataFrame, offers: DataFrame, market: DataFrame, path: str, batch: int, version: str = "source_pos", buckets: int = BUCKETS, score: Callable[..., DataFrame] = score_products) -> None:
    """One batch: takes in its rows and scores the products that they touch. On disk are its tables and the shuffles of one job at a time."""
    with shuffles_removed(products.sparkSession):
        _score_batch(products, offers, market, path, batch, version, buckets, score)


def _score_batch(products: DataFrame, offers: DataFrame, market: DataFrame, path: str, batch: int, version: str, buckets: int, score: Callable[..., DataFrame]) -> None:
    spark = products.sparkSession
    number = F.lit(batch).cast("long").alias("batch")
    kept = [StructField("batch", LongType()), StructField("bucket", IntegerType())]
    whole = {"products": StructType([*products.schema.fields, *kept]), "offers": StructType([*offers.schema.fields, *kept])}
    for name, rows in (("products", products), ("offers", offers)):
        write_buckets(rows.select("*", number, bucket(PRODUCT_KEY, buckets)), f"{path}/{name}", "overwrite", "batch")
    # what has arrived is read back from what was just written, so that the batch's own plan runs once
    own = lambda name: read_buckets(spark, f"{path}/{name}", whole[name]).filter(F.col("batch") == batch).select("asin", "bucket")
    arrived = own("products").union(own("offers")).distinct()
    numbers = touched(arrived)

    def state(name: str, keys: list[str]) -> DataFrame:
        rows = read_buckets(spark, f"{path}/{name}", whole[name], numbers).filter(F.col("batch") <= batch)
        # by asin alone (it gives the bucket), so that one shuffle serves this join, the newest rows, the pairs and their groups
        return _newest(rows.join(arrived.select("asin"), "asin", "left_semi"), keys, version)

    now_products, now_offers = state("products", PRODUCT_KEY), state("offers", OFFER_KEY)
    scored = score(now_products, now_offers, market.join(arrived.select("asin"), "asin", "left_semi"))
    results = scored.join(fingerprints(now_products, now_offers), "asin").select("*", number, bucket(PRODUCT_KEY, buckets))
    before = read_buckets(spark, f"{path}/results", results.schema, numbers).filter(F.col("batch") < batch)
    write_buckets(results.join(before.select("bucket", "asin", "result_key"), ["bucket", "asin", "result_key"], "left_anti"), f"{path}/results", "overwrite", "batch")


def current_scores(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of each product."""
    rows = spark.read.parquet(f"{path}/results")
    own = [c for c in rows.columns if c not in ("asin", "batch", "bucket")]
    return rows.groupBy("asin").agg(F.max_by(F.struct(*own), "batch").alias("row")).select("asin", "row.*")


def continuous_scoring(products: DataFrame, offers: DataFrame, market: DataFrame, path: str, checkpoint: str, version: str = "source_pos", buckets: int = BUCKETS, trigger: dict | None = None):
    """Starts the query over two streams; ``market`` is a table that each batch reads for its products. Each batch takes rows of both streams."""
    row = lambda df: F.struct(*df.columns)
    none = lambda df: F.lit(None).cast(df.schema)
    both = products.select(row(products).alias("product"), none(offers).alias("offer")).unionByName(offers.select(none(products).alias("product"), row(offers).alias("offer")))

    def handle(rows: DataFrame, batch: int) -> None:
        part = lambda c: rows.filter(F.col(c).isNotNull()).select(f"{c}.*")
        score_batch(part("product"), part("offer"), market, path, batch, version, buckets)

    return continuous(both, checkpoint, handle, trigger)
