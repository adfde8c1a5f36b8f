"""Normalisation of imported text cells: numbers, durations, dates, prices, measures and keys."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that mean no value (fixed values).
NULL_TOKENS = ("", "-", "--", "n/a", "na", "none", "null", "—")
#: Multipliers of number units (fixed values).
UNITS = {"k": 1e3, "m": 1e6, "b": 1e9, "千": 1e3, "万": 1e4, "百万": 1e6, "亿": 1e8}
#: Currency words and signs that a number may carry (fixed values).
CURRENCY_WORDS = ("usd", "cny", "rmb", "eur", "gbp", "jpy", "cad", "aud", "hkd")
CURRENCY_SIGNS = "$¥￥€£₹"
#: Seconds of duration units (fixed values).
SECONDS = {
    "d": 86400, "day": 86400, "days": 86400, "天": 86400,
    "h": 3600, "hour": 3600, "hours": 3600, "小时": 3600, "时": 3600,
    "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "分钟": 60, "分": 60,
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "秒": 1,
}


def header_key(name: str) -> str:
    """A header's lookup form: lower case, separators and runs of space as one space."""
    return " ".join(name.lstrip("﻿").casefold().replace("_", " ").replace("-", " ").split())


def canonical_headers(df: DataFrame, aliases: dict[str, list[str]], strict: bool, required: tuple[str, ...] = ()) -> DataFrame:
    """Renames columns to their canonical names; unknown ones are kept. Strict: two headers of one name are an error, else the first wins."""
    by_key = {header_key(a): name for name, words in aliases.items() for a in [name, *words]}
    seen: dict[str, str] = {}
    columns = []
    for c in df.columns:
        name = by_key.get(header_key(c))
        if name in seen:
            if strict:
                raise ValueError(f"headers {seen[name]!r} and {c!r} both mean {name}")
            name = None
        if name:
            seen[name] = c
        columns.append(F.col(f"`{c}`").alias(name or c))
    if required and not any(r in seen for r in required):
        raise ValueError(f"MISSING_IDENTITY: none of {', '.join(required)}")
    return df.select(*columns)


def spaced(c: Column) -> Column:
    """Trimmed, runs of space as one."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def known(t: Column) -> Column:
    """Null tokens are null."""
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def text(c: Column) -> Column:
    """Trimmed, runs of space as one; null tokens are null."""
    return known(spaced(c))


def bare_number(t: Column) -> Column:
    """What is left of a number's text: (5) is -5, currency words and signs, % and thousands marks are dropped."""
    low = F.lower(t)
    bare = F.when(low.startswith("("), F.regexp_replace(low, r"^\((.*)\)$", "-$1")).otherwise(low)
    words = "|".join(CURRENCY_WORDS)
    bare = F.when(low.rlike(words), F.regexp_replace(bare, rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])", "")).otherwise(bare)  # most texts have none and need no look around
    return F.translate(bare, CURRENCY_SIGNS + "%, ", "")


def number_value(bare: Column) -> Column:
    """Value of a bare number, its unit multiplied; null if it is none."""
    number = r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+))(k|m|b|千|万|百万|亿)?(\+)?$"
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in UNITS.items()))
    scale = F.coalesce(F.try_element_at(table, F.regexp_extract(bare, number, 2)), F.lit(1.0))
    return F.regexp_extract(bare, number, 1).try_cast("double") * scale


def numeric_parts(c: Column) -> tuple[Column, Column]:
    """(exact, lower_bound) of a number cell; a trailing + makes it a lower bound."""
    bare = bare_number(text(c))
    value, plus = number_value(bare), bare.endswith("+")
    return F.when(~plus, value), F.when(plus, value)


def numeric(c: Column) -> Column:
    """struct(exact, lower_bound) of a number cell."""
    exact, bound = numeric_parts(c)
    return F.struct(exact.alias("exact"), bound.alias("lower_bound"))


def numeric_simple(c: Column) -> Column:
    """As numeric, but a trailing + is ignored; 4 decimals."""
    return F.round(number_value(bare_number(text(c))), 4)


def duration_seconds(c: Column) -> Column:
    """Seconds of texts such as 2 days 3h 15 min or 2天3小时; null if anything but such parts, spaces and commas is in it."""
    t = F.lower(text(c))
    token = rf"(\d+(?:\.\d+)?)\s*({'|'.join(sorted(SECONDS, key=lambda u: (-len(u), u)))})(?![a-z])"
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in SECONDS.items()))
    parts = F.zip_with(F.regexp_extract_all(t, F.lit(token), F.lit(1)), F.regexp_extract_all(t, F.lit(token), F.lit(2)), lambda n, u: n.cast("double") * F.element_at(table, u))
    return F.when(t.rlike(rf"^(?:[\s,]*{token}[\s,]*)+$"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


#: Date formats in order, each with the shape a cell must have.
DATES = (("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("yyyyMMdd", r"^\d{8}$"))


def date(c: Column) -> Column:
    """First format that parses; null otherwise."""
    t = F.trim(c)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_date(t, f)) for f, shape in DATES])


def price_usd(c: Column, jpy: float = 0.0067) -> Column:
    """Retail price text in USD: list prices are rejected, yen converted, '$12 34' and '$1234' read as cents, a bare whole number from 500 up as yen."""
    t = F.lower(F.trim(c))
    marked = t.rlike(r"¥|￥|jpy|円")
    number = F.regexp_replace(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
    split = F.regexp_extract(t, r"^\$\s*(\d{1,4})\s+(\d{2})$", 1).try_cast("double") + F.regexp_extract(t, r"^\$\s*(\d{1,4})\s+(\d{2})$", 2).try_cast("double") / 100
    compact = F.regexp_extract(t, r"^\$(\d{3,6})$", 1).try_cast("double") / 100
    bare = F.when(t.rlike(r"^\d+$") & (number >= 500), number * jpy)
    return F.when(t.rlike(r"^\s*(?:list|was|rrp)\b"), F.lit(None).cast("double")).when(marked, number * jpy).otherwise(F.coalesce(split, compact, bare, number))


def weight_kg(c: Column, pound: float = 0.45359237, ounce: float = 0.028349523125) -> Column:
    """First weight in kilograms; the factors may be those that a source rounds to."""
    t = F.lower(c)
    pattern = r"(\d+(?:\.\d+)?)\s*(kilograms?|kg|pounds?|lbs?|ounces?|oz|grams?|g)\b"
    v, u = F.regexp_extract(t, pattern, 1).try_cast("double"), F.regexp_extract(t, pattern, 2)
    return F.when(u.rlike("^k"), v).when(u.rlike("^(p|l)"), v * pound).when(u.rlike("^o"), v * ounce).when(u.rlike("^g"), v / 1000)


def dimensions_cm(c: Column) -> Column:
    """Three sides in cm, longest first; null without all three and a unit."""
    t = F.lower(c)
    pattern = r"(\d+(?:\.\d+)?)\s*(?:[a-z\"]*)\s*[x×*]\s*(\d+(?:\.\d+)?)\s*(?:[a-z\"]*)\s*[x×*]\s*(\d+(?:\.\d+)?)\s*(inches|inch|in|cm|mm|\")"
    unit = F.regexp_extract(t, pattern, 4)
    scale = F.when(unit == "cm", 1.0).when(unit == "mm", 0.1).otherwise(2.54)
    sides = F.array(*[F.regexp_extract(t, pattern, i).try_cast("double") * scale for i in (1, 2, 3)])
    return F.when(unit != "", F.sort_array(sides, asc=False))


def asin(c: Column) -> Column:
    """Ten letters or digits, upper case; null otherwise."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike("^[A-Z0-9]{10}$"), t)


def card_price_cny(c: Column) -> Column:
    """Price of an offer card; only values in (0, 9999] count."""
    v = F.regexp_extract(c, r"[¥￥]\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when((v > 0) & (v <= 9999), v)


#: Wordings of a month's sales on offer cards, in order, and whether the number counts in ten thousands (fixed values).
CARD_SALES = ((r"全网([\d.]+)万\+?件", True), (r"([\d.]+)万\+?件", True), (r"月销[量售]*([\d.]+)万\+?件", True), (r"月成交([\d.]+)万\+?", True), (r"(?:月销[量售]*|成交|已售|sold)\s*([\d.]+)万", True), (r"(?:月销[量售]*|成交|已售|sold)\s*([\d,]+)", False), (r"([\d,]+)\s*笔", False))
SUPPLIER_WORDS = ("公司", "工厂", "厂家", "有限", "店")


def card_monthly_sales(c: Column) -> Column:
    """Sales of a month by the first wording that a card has."""
    low = F.lower(c)
    value = lambda p: F.replace(F.regexp_extract(low, p, 1), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(*[value(p) * 10000 if many else value(p) for p, many in CARD_SALES])


def card_supplier(c: Column) -> Column:
    """The last line of a card that names a kind of company, else its last line; 40 characters at most."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), lambda x: x != "")
    named = F.filter(lines, lambda x: x.rlike("|".join(SUPPLIER_WORDS)))
    return F.substring(F.coalesce(F.try_element_at(named, F.lit(-1)), F.try_element_at(lines, F.lit(-1))), 1, 40)


def card_offer_id(url: Column) -> Column:
    """Offer id of an address: in its path, else its query."""
    part = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(part(r"(?i)/offer/(\d+)"), part(r"(?i)[?&]offerId=(\d+)"))


def card_repeat_rate(c: Column) -> Column:
    return F.regexp_extract(c, r"(?:回头率|复购率)\s*(\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100


def card_moq(c: Column) -> Column:
    """Minimum order; null if the card names none."""
    return F.regexp_extract(c, r"(\d+)\s*(?:件|个|套|pcs)\s*起", 1).try_cast("int")


def source_metadata(df: DataFrame, mode: str, query: Column, pos: str = "source_pos") -> DataFrame:
    """Sets source_mode, source_query and source_rank where they are not set; the rank is the list rank or the position."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.withColumns({"source_mode": F.coalesce(has("source_mode"), F.lit(mode)), "source_query": F.coalesce(has("source_query"), query), "source_rank": F.coalesce(has("source_rank"), has("bsr_rank"), F.col(pos))})


def public_rows(df: DataFrame, allowed: list[str], keys: list[str], first: int = 20, pos: str = "source_pos") -> DataFrame:
    """The first rows of each key in source order as JSON of the allowed columns without nulls."""
    from ..operators.windows import top_per_key

    shown = top_per_key(df, keys, [F.asc(pos)], first, "nth")
    return shown.select(*keys, "nth", F.to_json(F.struct(*[c for c in allowed if c in df.columns])).alias("row"))


def repair_evidence(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, audit rows) of legacy evidence: confidence 0 or out of range is unknown, counts that are not positive are unknown and make the row partial."""
    c = F.col
    bad = ~c("confidence").between(0, 1) | (c("confidence") == 0) | F.isnan("confidence")
    zero = c("result_count") <= 0
    fixed = df.withColumns(
        {
            "new_confidence": F.when(~bad, c("confidence")),
            "new_count": F.when(~zero, c("result_count")),
            "new_status": F.when(zero & (c("status") == "completed"), F.lit("partial")).otherwise(c("status")),
        }
    )
    changes = F.array_compact(
        F.array(
            *[
                F.when(~old.eqNullSafe(new), F.struct(F.lit(name).alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new")))
                for name, old, new in (("confidence", c("confidence"), c("new_confidence")), ("result_count", c("result_count"), c("new_count")), ("status", c("status"), c("new_status")))
            ]
        )
    )
    audit = fixed.select(key, F.explode(changes).alias("change")).select(key, "change.*")
    repaired = fixed.drop("confidence", "result_count", "status").withColumnsRenamed({"new_confidence": "confidence", "new_count": "result_count", "new_status": "status"})
    return repaired, audit


#: Search words with a known English wording (fixed values).
QUERY_WORDS = {"螺栓": "bolt", "齿轮": "gear", "户外取暖器": "patio heater", "遮阳伞": "patio umbrella"}


def query_keyword(c: Column, words: dict[str, str] = QUERY_WORDS) -> Column:
    """struct(keyword, requires_english_query): mapped words in English; other Chinese text stays and is flagged."""
    t = text(c)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in words.items()))
    mapped = F.coalesce(F.try_element_at(table, t), t)
    return F.struct(mapped.alias("keyword"), F.coalesce(mapped.rlike("[\\u4e00-\\u9fff]"), F.lit(False)).alias("requires_english_query"))
