"""Set operations over rows and over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARD_FIELDS = ("capacity", "dimensions", "material", "pack_count")


def union_queue(accepted: DataFrame, review: DataFrame, rejected: DataFrame) -> DataFrame:
    """One table of all decisions, each row with its route."""
    mark = lambda df, r: df.withColumn("route", F.lit(r))
    return mark(accepted, "accepted").unionByName(mark(review, "review"), allowMissingColumns=True).unionByName(mark(rejected, "rejected"), allowMissingColumns=True)


def feature_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def refs_subset(observed: Column, available: Column) -> Column:
    """complete if every observed reference is available, else partial."""
    return F.when(F.size(F.array_except(observed, available)) == 0, "complete").otherwise("partial")


def hard_conflicts(conflicts: Column) -> Column:
    return F.array_sort(F.array_intersect(conflicts, F.array(*[F.lit(f) for f in HARD_FIELDS])))


def hidden_except(results: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    return results.join(hidden.select(key).distinct(), key, "left_anti")


def reason_union(*lists: Column) -> Column:
    """Distinct reasons in order of first appearance; a missing list counts as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))


def evidence_gaps(entities: DataFrame, evidence: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Per entity, sorted: name:missing, name:status or name:untrusted for each required field. Evidence columns: field_name, status, trusted."""
    wanted = entities.select(key, F.explode(F.array(*[F.lit(r) for r in required])).alias("field_name"))
    found = wanted.join(evidence.select(key, "field_name", "status", "trusted"), [key, "field_name"], "left")
    good = F.col("status").isin("extracted", "verified")
    gap = F.when(F.col("status").isNull(), "missing").when(~good, F.col("status")).when(~F.coalesce("trusted", F.lit(False)), "untrusted")
    named = found.withColumn("gap", F.when(gap.isNotNull(), F.concat_ws(":", "field_name", gap)))
    return named.groupBy(key).agg(F.array_sort(F.collect_set("gap")).alias("gaps"))
