"""Text to features at corpus scale: specifications, brands, queries, links and titles, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .specs import alias_present


def brand_tokens(brand: Column) -> Column:
    """The brand and its words of two letters or more, lower case, longest first."""
    low = F.lower(F.trim(brand))
    words = F.filter(F.split(low, r"[\s#/]+"), lambda w: F.length(w) >= 2)
    tokens = F.array_distinct(F.filter(F.concat(F.array(low), words), lambda w: F.length(w) >= 2))
    return F.array_sort(tokens, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


_quoted = lambda t: F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])\Q"), t, F.lit(r"\E(?![\p{L}\p{N}])"))


def contains_brand(text: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.regexp_like(text, _quoted(t)))


def remove_brand_terms(text: Column, tokens: Column) -> Column:
    out = F.aggregate(tokens, text, lambda acc, t: F.regexp_replace(acc, _quoted(t), F.lit(" ")))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Query types and the word that marks each (fixed values).
TYPE_QUALIFIERS = {
    "generic_name": "通用产品", "supply_chain_name": "供应链", "function": "功能款", "material": "材质款", "structure": "结构件", "use_case": "应用场景",
    "specification": "规格款", "package_quantity": "包装批发", "replacement_consumable": "替换耗材", "debranded_description": "产品描述", "factory_synonym": "生产厂家", "alibaba_category": "1688类目",
}
QUERY_TYPES = tuple(TYPE_QUALIFIERS)
#: Names of relations and categories in queries, and the words that a rewrite adds by iteration (fixed values).
RELATION_NAMES = {"replacement": "替换件", "consumable": "耗材", "full_product": "整品", "unknown": "通用产品"}
CATEGORY_NAMES = {"outdoor_storage": "户外储物", "patio_heater": "户外取暖器", "patio_furniture_sets": "户外家具套装", "patio_umbrellas_shade": "户外遮阳"}
REWRITE_SUFFIXES = {1: "精准厂家", 2: "源头工厂"}


def _named(value: Column, names: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def query_texts(columns: list[str]) -> dict[str, Column]:
    """Raw wording of each query type from a product's columns; those the table lacks count as unknown.

    Text columns: generic_name, supply_name, relation, category, subcategory; arrays:
    function, material, components, use_case, dimensions, factory_words; package_quantity.
    """
    col = lambda c, t="string": F.col(c) if c in columns else F.lit(None).cast(t)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    some = lambda c, n: F.array_join(F.filter(F.transform(F.slice(F.coalesce(col(c, "array<string>"), F.array().cast("array<string>")), 1, n), F.trim), lambda x: x != ""), " ")
    name, supply = F.coalesce(col("generic_name"), F.lit("")), F.coalesce(col("supply_name"), F.lit(""))
    function, material, structure = some("function", 2), some("material", 2), some("components", 3)
    around = lambda part, t: F.concat_ws(" ", F.coalesce(blank(part), name), name, F.lit(TYPE_QUALIFIERS[t]))
    quantity = col("package_quantity", "int")
    pack = F.when(quantity > 0, F.concat(quantity.cast("string"), F.lit("件装"))).otherwise(F.lit("包装批发"))
    category = _named(col("category"), CATEGORY_NAMES, F.coalesce(blank(col("category")), blank(col("subcategory")), F.lit("工业品")))
    return {
        "generic_name": F.concat_ws(" ", name, F.lit("通用产品")),
        "supply_chain_name": F.concat_ws(" ", supply, F.lit("供应链")),
        "function": around(function, "function"),
        "material": around(material, "material"),
        "structure": around(structure, "structure"),
        "use_case": around(some("use_case", 2), "use_case"),
        "specification": around(some("dimensions", 2), "specification"),
        "package_quantity": F.concat_ws(" ", pack, name),
        "replacement_consumable": F.concat_ws(" ", _named(col("relation"), RELATION_NAMES, F.lit("通用产品")), supply),
        "debranded_description": F.concat_ws(" ", material, function, structure, name, F.lit("产品描述")),
        "factory_synonym": F.concat_ws(" ", F.coalesce(blank(some("factory_words", 3)), supply), F.lit("生产厂家")),
        "alibaba_category": F.concat_ws(" ", F.lit("1688"), category, supply),
    }


def clean_query(raw: Column, tokens: Column) -> Column:
    """Without brand and imitation words, single spaces, no signs at either end, at most 120 characters."""
    out = F.regexp_replace(remove_brand_terms(raw, tokens), r"(?i)仿(?:牌|款)?|同款|高仿|复刻", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.substring(F.regexp_replace(out, r"^[ ,，\-_/|]+|[ ,，\-_/|]+$", ""), 1, 120)


def query_fingerprint(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def query_id(key: Column, query_type: Column, text: Column, retry_of: Column) -> Column:
    """Head of a SHA-256 over product, type, text and the query that this one retries."""
    return F.substring(F.sha2(F.concat_ws("|", key, query_type, query_fingerprint(text), F.coalesce(retry_of, F.lit(""))), 256), 1, 24)


def query_plan(df: DataFrame, texts: dict[str, Column], key: str = "asin", brand: str = "brand") -> DataFrame:
    """Twelve search queries per product: brand and imitation words removed, 120 characters at most, one text each.

    A text that a product has already gets a counter. Columns: key, n, query_type,
    text, query_id, retry_of (null here).
    """
    rows = df.withColumn("_tokens", brand_tokens(F.coalesce(F.col(brand), F.lit(""))))
    pairs = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("query_type"), F.lit(q).alias("qualifier"), texts[t].alias("raw")) for i, (t, q) in enumerate(TYPE_QUALIFIERS.items())])
    rows = rows.select(key, "_tokens", F.inline(pairs)).withColumn("text", clean_query(F.col("raw"), F.col("_tokens")))
    rows = rows.withColumn("text", F.when(F.length("text") < 2, F.col("qualifier")).otherwise(F.col("text")))
    nth = F.row_number().over(Window.partitionBy(key, query_fingerprint(F.col("text"))).orderBy("n")) - 1
    suffix = F.concat(F.lit(" 查询"), F.col("_nth").cast("string"))
    counted = F.concat(F.substring("text", F.lit(1), F.lit(120) - F.length(suffix)), suffix)
    rows = rows.withColumn("_nth", nth).withColumn("text", F.when(F.col("_nth") > 0, counted).otherwise(F.col("text")))
    none = F.lit(None).cast("string")
    return rows.select(key, "n", "query_type", "text", query_id(F.col(key).cast("string"), F.col("query_type"), F.col("text"), none).alias("query_id"), none.alias("retry_of"))


def rewrite_queries(plan: DataFrame, rates: DataFrame, products: DataFrame, iteration: int, key: str = "asin", least: float = 0.2) -> DataFrame:
    """Rewrites of queries whose hit rate is known and low: supply name, generic name, the type's word and the iteration's.

    ``plan``: all queries so far, as ``query_plan`` gives them; ``rates``: query_id,
    hit_rate; ``products``: key, supply_name, generic_name, brand. The first iteration
    rewrites queries of the plan, the second their rewrites, and there is no third.
    Texts that the product has, or gets from an earlier row, are left out.
    """
    if iteration not in REWRITE_SUFFIXES:
        return plan.limit(0)
    low = plan.join(rates.filter(F.col("hit_rate") < least).select("query_id").distinct(), "query_id", "left_semi")
    if iteration == 1:
        low = low.filter("retry_of is null")
    else:
        parents = plan.filter("retry_of is null").select(F.col(key), F.col("query_id").alias("retry_of"))
        low = low.join(parents, [key, "retry_of"], "left_semi")
    raw = F.concat_ws(" ", F.coalesce("supply_name", F.lit("")), F.coalesce("generic_name", F.lit("")), _named(F.col("query_type"), TYPE_QUALIFIERS, F.lit("")), F.lit(REWRITE_SUFFIXES[iteration]))
    rows = low.select(key, "n", "query_type", F.col("query_id").alias("retry_of")).join(products, key)
    rows = rows.withColumn("text", clean_query(raw, brand_tokens(F.coalesce("brand", F.lit(""))))).filter(F.length("text") >= 2).withColumn("_print", query_fingerprint(F.col("text")))
    rows = rows.join(plan.select(key, query_fingerprint(F.col("text")).alias("_print")).distinct(), [key, "_print"], "left_anti")
    first = F.row_number().over(Window.partitionBy(key, "_print").orderBy("n", "retry_of"))
    rows = rows.withColumn("_nth", first).filter("_nth = 1")
    return rows.select(key, "n", "query_type", "text", query_id(F.col(key).cast("string"), F.col("query_type"), F.col("text"), F.col("retry_of")).alias("query_id"), "retry_of")


def search_keywords(title: Column, core: tuple[str, ...], modifiers: tuple[str, ...]) -> Column:
    """Distinct core words of a title, and core x modifier pairs, two of each at most."""
    low = F.lower(F.coalesce(title, F.lit("")))
    found = lambda words: F.slice(F.array_compact(F.array(*[F.when(alias_present(low, w), F.lit(w)) for w in words])), 1, 2)
    pairs = F.flatten(F.transform(found(core), lambda c: F.transform(found(modifiers), lambda m: F.concat_ws(" ", m, c))))
    return F.array_distinct(F.concat(found(core), pairs))


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, 2))).otherwise(F.array().cast("array<string>"))


def title_match_score(title: Column, keywords: Column) -> Column:
    """Best keyword: 1.0 if the title contains it, else its share of bigrams in the title when there are two or more."""
    low = F.lower(F.coalesce(title, F.lit("")))

    def one(k: Column) -> Column:
        k = F.lower(F.trim(k))
        grams = bigrams(k)
        hits = F.size(F.filter(grams, lambda g: F.contains(low, g)))
        return F.when(k == "", F.lit(0.0)).when(F.contains(low, k), F.lit(1.0)).when(hits >= 2, hits / F.size(grams)).otherwise(F.lit(0.0))

    return F.aggregate(F.transform(keywords, one), F.lit(0.0), lambda a, x: F.greatest(a, x))


def extract_links(df: DataFrame, keys: list[str], html: str, pattern: str) -> DataFrame:
    """Distinct captures of a pattern in order of first appearance, with their rank."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)))
    return df.select(*keys, F.posexplode(found).alias("rank", "link"))


def json_objects(text: Column, depth: int = 24) -> Column:
    """JSON objects in a text, outermost first, with up to ``depth`` levels of braces inside; braces in quoted strings do not count."""
    quoted = r'"(?:[^"\\\\]|\\\\.)*+"'.replace("\\\\", "\\")
    inner = rf'\{{(?:[^{{}}"]|{quoted})*+\}}'
    for _ in range(depth):
        inner = rf'\{{(?:[^{{}}"]|{quoted}|{inner})*+\}}'
    return F.regexp_extract_all(text, F.lit(f"({inner})"), F.lit(1))


def extract_reasons(text: Column) -> Column:
    """``reasons`` of the first JSON object in a text that parses and has them; objects may be nested."""
    return F.get_json_object(F.get(F.filter(json_objects(text), lambda o: F.get_json_object(o, "$.reasons").isNotNull()), 0), "$.reasons")


#: Names that a label and a value of an attribute go by (fixed values).
ATTRIBUTE_NAMES = ("attributeName", "attrName", "name", "key", "propertyName")
ATTRIBUTE_VALUES = ("value", "attributeValue", "attrValue", "propertyValue", "text")


def flatten_attributes(value: Column, depth: int = 5) -> Column:
    """Attributes of a JSON text as 'label: value' lines in order of level: an object with a label and a plain value is one, wherever it stands down to ``depth`` levels."""
    variant = lambda v, t, p: F.try_variant_get(v, p, t)
    below = lambda v: F.concat(F.coalesce(variant(v, "array<variant>", "$"), F.array().cast("array<variant>")), F.coalesce(F.map_values(variant(v, "map<string,variant>", "$")), F.array().cast("array<variant>")))
    first = lambda v, names: F.coalesce(*[F.when(F.schema_of_variant(F.coalesce(variant(v, "variant", f"$.{n}"), v)).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), variant(v, "string", f"$.{n}")) for n in names])
    line = lambda v: F.when(first(v, ATTRIBUTE_NAMES).isNotNull() & first(v, ATTRIBUTE_VALUES).isNotNull(), F.concat_ws(": ", first(v, ATTRIBUTE_NAMES), first(v, ATTRIBUTE_VALUES)))
    level = F.array(F.try_parse_json(value))
    lines = []
    for _ in range(depth + 1):
        lines.append(F.array_compact(F.transform(level, line)))
        level = F.flatten(F.transform(F.filter(level, lambda v: v.isNotNull()), below))
    return F.array_join(F.concat(*lines), "\n")
