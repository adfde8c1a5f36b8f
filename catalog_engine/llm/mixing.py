"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral is
the source's share of the token budget; its running integral, scaled to that
share, is the source's cumulative token demand. A document's words sit at a known
point of its source's word stream, so inverting the demand curve at that point
gives the document's training position, and one range sort by position gives the
training order.

``place`` shuffles (doc_id, source, size, key) only, no text; ``mix`` carries the
rows themselves, once to their running sums and once to their place in the order.
Running sums inside a source are taken per (source, run), a run being a key prefix,
with offsets from the runs' totals, so a source that holds most rows is still spread
over many tasks. A row that occurs more than HEAVY times is dealt to as many runs.

Defined results: null text has size 0 and is never taken; a null source is one
source of its own and comes last; repeated rows are separate documents; with no
words at all every target is 0; clashing extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpoint, word_count, written

#: Hex digits of the key that split a source: 16**3 runs a source.
PREFIX = 3
#: Equal rows in one run.
HEAVY = 100_000
#: Relative weight at equally spaced times for each weight class: the heaviest sources lead, the lightest finish.
SCHEDULES = ((1.4, 1.2, 0.8, 0.4), (1.0, 1.0, 1.0, 1.0), (0.4, 0.8, 1.2, 1.6))


@dataclass(frozen=True)
class Curve:
    """A piecewise-linear schedule and its normalised running integral."""

    knots: tuple[float, ...]

    def segments(self) -> list[tuple[float, float, float, float, float]]:
        """(f_lo, f_hi, t_lo, w_lo, w_hi) for each segment; f is the share of demand met; weights are scaled to integral 1."""
        n = len(self.knots) - 1
        total = sum((a + b) / 2 / n for a, b in zip(self.knots, self.knots[1:]))
        out, f = [], 0.0
        for i, (a, b) in enumerate(zip(self.knots, self.knots[1:])):
            g = f + (a + b) / 2 / n / total
            out.append((f, g if i < n - 1 else 1.0, i / n, a / total, b / total))
            f = g
        return out


def _position(share, cls):
    """Training time at which a source has met this share of its demand."""
    out = F.lit(None).cast("double")
    for c, knots in enumerate(SCHEDULES):
        n = len(knots) - 1
        for f_lo, f_hi, t_lo, a, b in reversed(Curve(knots).segments()):
            slope = (b - a) * n
            rest = share - F.lit(f_lo)
            step = (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * rest)) - a) / slope if abs(slope) > 1e-12 else rest / a
            out = F.when((cls == c) & (share >= f_lo) & (share <= f_hi), F.lit(t_lo) + step).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(src, source_size, weight_class, target): shares of percent % of all sizes, none above ``most`` times its size.

    The level is found by rounds of one-row aggregates: sources that a level would
    take over their limit are held there and the rest share what remains. The
    table has one row for each source.
    """
    sources = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight_class", ((F.row_number().over(order) - 1) % len(weights)).cast("int")).drop("source")
    sources = checkpoint(sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("weight_class") + 1)))
    full = F.col("source_size") * most
    level, total = -1.0, None
    while True:
        free = F.lit(True) if total is None else (F.col("weight") * F.lit(level) <= full)
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(free, 0).otherwise(full)).alias("held"),
            F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("weights"),
        ).first()
        total = (row["all"] or 0) * percent / 100
        new = (total - row["held"]) / row["weights"] if row["weights"] else level
        if new <= level or not row["weights"]:
            break
        level = new
    return sources.select("src", "source_size", "weight_class", F.least(full.cast("double"), F.col("weight") * F.lit(float(max(level, 0.0)))).alias("target"))


def place(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, takes, and ``carry``.

    ``takes`` lists (pass, words, position) of each pass that takes words of the
    document; ``taken`` is their sum. The last document of a source may be taken
    in part, so that the source meets its target to the word.
    """
    text = F.col(text_col).cast("string")
    source = F.col(source_col).cast("string")
    own = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    docs = df.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source)).alias("src"),
        word_count(text).alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))).alias("row_key"),
        own.alias("own"),
    ).withColumn("nth", F.monotonically_increasing_id())
    equal = docs.groupBy("row_key").count().filter(F.col("count") > HEAVY).select("row_key", F.ceil(F.col("count") / HEAVY).alias("deal"))
    run = F.substring("row_key", 1, PREFIX)
    dealt = F.concat(run, F.lit("+"), F.col("row_key"), F.format_string("%08x", F.pmod(F.xxhash64("nth"), F.col("deal"))))
    # at most one key for HEAVY rows: some 30 MB for the rows of 100 TB
    docs = docs.join(F.broadcast(written(equal, "mix-equal")), "row_key", "left").withColumn("run", F.coalesce(dealt, run)).drop("deal", "nth")
    sizes = written(docs.drop("own"), "mix-sizes")
    runs = sizes.groupBy("src", "run").agg(F.sum("size").alias("run_size"))
    before = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("run_size").over(before), F.lit(0))).drop("run_size")
    runs = runs.join(source_targets(sizes, weights, percent, most), "src")
    if not carry:
        docs = sizes.withColumn("own", F.lit(None).cast("int"))
    inside = Window.partitionBy("src", "run").orderBy("row_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(runs, ["src", "run"])
    words = F.floor("target").cast("long")
    placed = placed.withColumns(
        {"at": F.col("start") + F.col("at"), "passes": F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")}
    )
    rest = words - F.col("passes") * F.col("source_size")
    placed = placed.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("at"))))
    takes = []
    for p in range(most + 1):
        w = F.when(F.lit(p) < F.col("passes"), F.col("size")).when(F.lit(p) == F.col("passes"), F.col("extra")).otherwise(F.lit(0)).cast("long")
        share = F.least(F.lit(1.0), (p * F.col("source_size") + F.col("at")) / F.greatest(F.col("target"), F.lit(1.0)))
        takes.append(F.when(w > 0, F.struct(F.lit(p).alias("pass"), w.alias("words"), _position(share, F.col("weight_class")).alias("position"))))
    placed = placed.withColumn("takes", F.array_compact(F.array(*takes)))
    taken = (F.col("passes") * F.col("size") + F.col("extra")).cast("long")
    return placed.select("doc_id", "row_key", "size", "source_size", "target", taken.alias("taken"), "takes", *([F.col("own")] if carry else []))


def digest(placed: DataFrame) -> DataFrame:
    """One row per document in training order of its first pass; documents left out come last."""
    first = F.get("takes", 0)["position"]
    out = placed.select("doc_id", "size", "source_size", "target", "taken", F.round(first, 9).alias("position"), "row_key")
    return out.orderBy(F.col("position").asc_nulls_last(), "row_key").drop("row_key")


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed training rows: the input's columns once per pass that takes words of them, sorted by position."""
    placed = place(df, carry=tuple(df.columns), **options)
    rows = placed.select("own", "row_key", F.explode("takes").alias("take")).orderBy("take.position", "row_key", "take.pass")
    return rows.select("own.*")


def _position_sql() -> str:
    cases = []
    for c, knots in enumerate(SCHEDULES):
        n = len(knots) - 1
        for f_lo, f_hi, t_lo, a, b in Curve(knots).segments():
            slope = (b - a) * n
            rest = f"(share - {f_lo!r}::DOUBLE)"
            step = f"(sqrt(greatest(0.0::DOUBLE, {a * a!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest})) - {a!r}::DOUBLE) / {slope!r}::DOUBLE" if abs(slope) > 1e-12 else f"{rest} / {a!r}::DOUBLE"
            cases.append(f"WHEN cls = {c} AND share >= {f_lo!r}::DOUBLE AND share <= {f_hi!r}::DOUBLE THEN {t_lo!r}::DOUBLE + {step}")
    return "CASE " + " ".join(cases) + " END"


ORACLE_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS z,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS cls, [5, 2, 1][cls + 1] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, (SELECT sum(z) FROM s) * 150 / 100.0::DOUBLE AS total,
         coalesce(sum(2 * z) OVER b, 0) AS held, sum(w) OVER a AS ws
  FROM s WINDOW b AS (ORDER BY z / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                a AS (ORDER BY z / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT max((total - held) / ws) AS level FROM o
), t AS (
  SELECT source, cls, z AS source_size, least((2 * z)::DOUBLE, w * level) AS target FROM s CROSS JOIN l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.cls, floor(t.target)::BIGINT AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, (CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
             + greatest(0, least(size, words % source_size - pos)) END)::BIGINT AS taken,
         least(1.0::DOUBLE, pos::DOUBLE / greatest(target, 1.0::DOUBLE)) AS share
  FROM p
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round("""
    + _position_sql()
    + """, 9) END AS position
FROM q"""
)
