"""Search words for wholesale offers out of a retail title: kinds, materials and features by rule, sizes in local units, supply-chain names, and their combination."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import measures as ms

# Fixed values: (search word, words of a title), in order.
TITLE_KINDS = (
    ("灭蚁饵剂", ("ant killer", "ant bait", "ant trap", "bait station")),
    ("驱蚊用品", ("mosquito repellent", "mosquito killer", "mosquito trap")),
    ("杀蟑胶饵", ("cockroach bait", "roach bait", "roach killer")),
    ("床品套件", ("sheet set", "bed sheet", "bed sheets", "bedding set", "fitted sheet", "duvet cover")),
    ("床笠", ("deep pocket", "fitted sheet")),
    ("保温杯", ("insulated water bottle", "vacuum bottle", "thermos", "travel mug")),
    ("水杯", ("water bottle", "tumbler", "sports bottle", "drinking bottle", "bottle")),
    ("瑜伽垫", ("yoga mat", "exercise mat", "fitness mat")),
    ("收纳盒", ("storage box", "storage bin", "organizer box", "organizer")),
    ("厨房垫", ("kitchen mat", "sink mat", "counter mat", "dish drying mat")),
    ("枕头", ("pillow", "neck pillow", "bed pillow")),
    ("手机支架", ("phone stand", "phone holder", "tablet stand")),
    ("折叠桌", ("folding table", "foldable table", "camping table")),
    ("户外储物箱", ("deck box", "outdoor storage", "patio storage", "garden storage")),
    ("户外储物棚", ("storage shed", "garden shed")),
    ("户外取暖器", ("patio heater", "outdoor heater", "terrace heater", "propane heater")),
    ("户外家具套装", ("patio furniture", "outdoor furniture set", "conversation set", "outdoor dining set")),
    ("庭院遮阳伞", ("patio umbrella", "market umbrella")),
    ("户外侧立伞", ("cantilever umbrella", "offset umbrella")),
    ("户外遮阳帆", ("shade sail", "sun shade sail")),
    ("毛巾", ("towel", "dish towel", "kitchen towel")),
)
TITLE_MATERIALS = (("不锈钢", ("stainless steel", "304 steel", "304 stainless")), ("硅胶", ("silicone",)), ("塑料", ("plastic", "pp", "abs")), ("铝合金", ("aluminum", "aluminium")))
TITLE_FEATURES = (("吸管", ("straw",)), ("带盖", ("with lid", "lid")), ("折叠", ("folding", "foldable")), ("防滑", ("non slip", "non-slip", "anti slip", "anti-slip")), ("防水", ("waterproof",)), ("可机洗", ("machine washable",)))
SMALL_WORDS = ("with", "for", "and", "or", "the", "a", "an")
#: Words of shoppers and the names that makers use; the first row with a word counts.
SUPPLY_NAMES = (
    (("ant trap", "ant bait", "ant killer", "bait station"), ("灭蚁饵剂", "蚂蚁诱饵盒")),
    (("mosquito repellent", "mosquito killer", "mosquito trap"), ("驱蚊用品", "灭蚊器")),
    (("cockroach bait", "roach bait", "roach killer"), ("杀蟑胶饵", "蟑螂诱饵盒")),
    (("insulated water bottle", "vacuum bottle", "thermos"), ("保温杯",)),
    (("storage box", "storage bin", "organizer box"), ("收纳盒",)),
    (("sheet set", "bed sheet", "bed sheets", "bedding set", "duvet cover"), ("床品套件",)),
    (("fitted sheet", "deep pocket", "sheet & pillowcase"), ("床笠",)),
    (("cooling sheets", "cooling bed sheets"), ("凉感床品",)),
    (("yoga mat", "exercise mat"), ("瑜伽垫",)),
    (("deck box", "outdoor storage", "patio storage"), ("户外储物箱", "庭院收纳箱")),
    (("storage shed", "garden shed"), ("户外储物棚", "庭院工具房")),
    (("patio heater", "outdoor heater", "terrace heater"), ("户外取暖器", "露台取暖器")),
    (("patio furniture", "outdoor furniture set", "conversation set"), ("户外家具套装", "庭院桌椅组合")),
    (("patio umbrella", "market umbrella"), ("庭院遮阳伞", "户外中柱伞")),
    (("cantilever umbrella", "offset umbrella"), ("户外侧立伞", "悬臂遮阳伞")),
    (("shade sail", "sun shade sail"), ("户外遮阳帆",)),
)
#: Millilitres of each unit as titles are read; the first that fits counts.
TITLE_ML = {"oz": 29.5735, "fl oz": 29.5735, "floz": 29.5735, "ml": 1.0, "l": 1000.0, "gallon": 3785.41, "quart": 946.353, "pint": 473.176}
LARGE, SMALL, SIZED = "大容量", "小容量", "多尺寸规格"
BOXED, PIECES = ("bait station", "bait trap", "ant trap", "roach trap"), ("towel", "cloth", "wipe")
SPEC = r"(?i)^\d+(?:\.\d+)?\s*(?:ml|l|oz|g|kg|cm|mm|英寸|件套|条装|盒装|只装|个装|支装|片装)$"
CJK = r"[一-鿿]"
_NONE = lambda: F.array().cast("array<string>")


def has_word(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike(rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in words)})(?![a-z0-9])")


def noisy(word: Column) -> Column:
    """Whether a search word says nothing: general sizes, product codes, bare capacities, short codes, and rows of such words."""

    def alone(w: Column) -> Column:
        code = w.rlike(r"(?i)^[A-Z0-9]{2,12}$") & (w.rlike(r"\d") | (w == F.upper(w)))
        return w.isin("", LARGE, SMALL, SIZED) | w.rlike(r"(?i)^B0[A-Z0-9]{8}$") | w.rlike(r"(?i)^\d+(?:\.\d+)?\s*(?:ml|l|oz|fl\s*oz|gallon|quart|pint)$") | code

    parts = F.transform(F.split(word, r"\s+"), lambda p: F.btrim(p, F.lit(" ,;:/()[]")))
    return alone(word) | ((F.size(parts) > 1) & F.forall(parts, alone))


def distinct_words(words: Column) -> Column:
    """Each word once in order of first appearance, noise left out."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(F.coalesce(w, F.lit("")))), lambda w: ~noisy(w)))


def title_keywords(title: Column) -> Column:
    """Search words of a title: material with the first kind, kinds, material, features, and the title's first words."""
    raw = F.coalesce(title, F.lit(""))
    low = F.lower(raw)
    named = lambda table: F.array_compact(F.array(*[F.when(has_word(low, words), F.lit(name)) for name, words in table]))
    kinds, material = named(TITLE_KINDS), F.coalesce(*[F.when(has_word(low, words), F.lit(name)) for name, words in TITLE_MATERIALS])
    made = F.array_compact(F.array(F.concat(material, F.get(kinds, F.lit(0)))))
    words = F.filter(F.transform(F.split(F.trim(raw), r"\s+"), lambda w: F.btrim(w, F.lit(" ,;:/()[]"))), lambda w: w != "")
    clean = F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS))
    firsts = [F.array_join(F.slice(x, 1, n), " ") for x, n in ((words, 8), (clean, 7), (words, 3))]
    return distinct_words(F.concat(made, kinds, F.array_compact(F.array(material)), named(TITLE_FEATURES), F.array(*firsts)))


def dimension_keywords(title: Column) -> Column:
    """Sizes of a title in local units: capacities with a word for large and small ones, pack counts with their measure word, and whether it has sides."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return ms.let(ms.pairs(low), lambda numbers: _dimensions(low, numbers))


def _dimensions(low: Column, numbers: Column) -> Column:
    units = "|".join(r"fl\s*oz" if u == "fl oz" else u for u in TITLE_ML if u != "floz")
    unit = lambda p: F.regexp_replace(F.regexp_extract(p["after"], f"^({units})", 1), r"\s+", "")
    table = F.create_map(*[F.lit(x) for k, v in TITLE_ML.items() if k != "fl oz" for x in (k, v)])

    def capacity(p: Column) -> Column:
        ml = ms.plain(p) * F.try_element_at(table, unit(p))
        litres = F.when(ml % 1000 == 0, F.format_string("%.0fL", ml / 1000)).otherwise(F.format_string("%.1fL", ml / 1000))
        label = F.when(ml >= 1000, litres).otherwise(F.format_string("%.0fml", ml))
        return F.when(ml.between(50, 100_000), F.array_compact(F.array(label, F.when(ml >= 500, LARGE).when(ml <= 200, SMALL)))).otherwise(_NONE())

    def count(p: Column) -> Column:
        of_set, of_pack = ms.ends(p["before"], ("set of",)), ms.ends(p["before"], ("pack of",))
        counted = of_set | of_pack | p["after"].rlike("^[- ]?(?:pack|count|pcs|piece)")
        word = F.when(has_any(low, BOXED), "盒装").when(has_any(low, PIECES), "条装").when(of_set, "件套").otherwise("个装")
        n = ms.plain(p).cast("int")
        return F.when(counted & n.between(1, 100), F.array(F.concat(n.cast("string"), word))).otherwise(_NONE())

    at = lambda i: F.get(numbers, i)
    joined = lambda p: p["after"].rlike(r"^x\s*$")
    sized = F.exists(F.transform(numbers, lambda p, i: F.coalesce(joined(p) & joined(at(i + 1)) & at(i + 2)["after"].rlike("^(?:in|cm|mm)"), F.lit(False))), lambda x: x)
    return F.concat(F.flatten(F.transform(numbers, lambda p: capacity(p))), F.flatten(F.transform(numbers, lambda p: count(p))), F.when(sized, F.array(F.lit(SIZED))).otherwise(_NONE()))


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike("|".join(re.escape(w) for w in words))


def supply_chain_keywords(words: Column) -> Column:
    """Shoppers' words as makers name the goods; words in Chinese stay, and those without a name stay as they are."""

    def one(w: Column) -> Column:
        low = F.lower(w)
        names = F.coalesce(*[F.when(has_any(low, said), F.array(*[F.lit(n) for n in made])) for said, made in SUPPLY_NAMES], _NONE())
        return F.concat(names, F.when(w.rlike(CJK) | (F.size(names) == 0), F.array(w)).otherwise(_NONE()))

    return distinct_words(F.flatten(F.transform(F.transform(words, lambda w: F.trim(F.coalesce(w, F.lit("")))), one)))


def enriched_keywords(dimensions: Column, cores: Column) -> Column:
    """Core words, in Chinese where there are any, and the first two of them with the first two sizes; a bare size is no search word."""
    spec = lambda w: w.rlike(SPEC)
    words = distinct_words(F.filter(F.transform(cores, lambda w: F.trim(F.coalesce(w, F.lit("")))), lambda w: ~spec(w)))
    local = F.filter(words, lambda w: w.rlike(CJK))
    words = F.when(F.size(local) > 0, local).otherwise(words)
    sizes = F.slice(F.array_distinct(F.filter(F.transform(dimensions, F.trim), spec)), 1, 2)
    return distinct_words(F.concat(words, F.flatten(F.transform(F.slice(words, 1, 2), lambda c: F.transform(sizes, lambda m: F.concat_ws(" ", c, m))))))
