"""The query plan as a Python table function for SQL users: a table argument, partitioned by product."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql.functions import udtf

from .operators.text import CATEGORY_NAMES, RELATION_NAMES, TYPE_QUALIFIERS

_SPACE, _SIGNS = r"[ \t\n\x0b\f\r]+", " ,，-_/|"
IMITATIONS = r"(?i)仿(?:牌|款)?|同款|高仿|复刻"


def _plan_texts(row: dict) -> dict[str, str]:
    """Raw wording of each query type."""
    said = lambda k: (row.get(k) or "").strip(" ")
    some = lambda k, n: " ".join(x for x in ((v or "").strip(" ") for v in (row.get(k) or [])[:n]) if x)
    name, supply = row.get("generic_name") or "", row.get("supply_name") or ""
    function, material, structure = some("function", 2), some("material", 2), some("components", 3)
    around = {"function": function, "material": material, "structure": structure, "use_case": some("use_case", 2), "specification": some("dimensions", 2)}
    quantity = row.get("package_quantity")
    category = CATEGORY_NAMES.get(row.get("category"), said("category") or said("subcategory") or "工业品")
    return {
        "generic_name": f"{name} 通用产品", "supply_chain_name": f"{supply} 供应链", **{t: f"{part or name} {name} {TYPE_QUALIFIERS[t]}" for t, part in around.items()},
        "package_quantity": f"{f'{quantity}件装' if quantity and quantity > 0 else '包装批发'} {name}", "replacement_consumable": f"{RELATION_NAMES.get(row.get('relation'), '通用产品')} {supply}",
        "debranded_description": f"{material} {function} {structure} {name} 产品描述", "factory_synonym": f"{some('factory_words', 3) or supply} 生产厂家", "alibaba_category": f"1688 {category} {supply}",
    }


def _clean(raw: str, brand: str) -> str:
    low = brand.strip(" ").lower()
    tokens = {w for w in (low, *re.split(r"[ \t\n\x0b\f\r#/]+", low)) if len(w) >= 2}
    for t in sorted(tokens, key=lambda t: (-len(t), t)):
        raw = re.sub(rf"(?i)(?<![^\W_]){re.escape(t)}(?![^\W_])", " ", raw)
    raw = re.sub(_SPACE, " ", raw).strip(" ")
    return re.sub(_SPACE, " ", re.sub(IMITATIONS, " ", raw)).strip(_SIGNS)[:120]


@udtf(returnType="asin string, n int, query_type string, text string, query_id string")
class QueryPlanTable:
    """Twelve queries for each row of a partition; texts that the product has already get a counter.

    ``SELECT * FROM query_plan_table(TABLE(products) PARTITION BY asin ORDER BY ...)``.
    Columns read, each of which may be missing: asin, brand, generic_name, supply_name,
    relation, category, subcategory, package_quantity, and the arrays function, material,
    components, use_case, dimensions, factory_words. Only the texts of one product are held.
    """

    def __init__(self):
        self.rows: list[tuple[int, str, str]] = []
        self.asin: str | None = None

    def eval(self, row):
        product = row.asDict()
        self.asin = None if product.get("asin") is None else str(product["asin"])
        texts = _plan_texts(product)
        for n, (kind, word) in enumerate(TYPE_QUALIFIERS.items()):
            text = _clean(texts[kind], product.get("brand") or "")
            self.rows.append((n, kind, text if len(text) >= 2 else word))

    def terminate(self):
        seen: Counter[str] = Counter()
        key = lambda text: re.sub(_SPACE, " ", text).strip(" ").lower()
        for n, kind, text in sorted(self.rows, key=lambda r: r[0]):
            nth, seen[key(text)] = seen[key(text)], seen[key(text)] + 1
            if nth:
                text = text[: 120 - len(f" 查询{nth}")] + f" 查询{nth}"
            parts = [p for p in (self.asin, kind, key(text), "") if p is not None]
            yield self.asin, n, kind, text, hashlib.sha256("|".join(parts).encode()).hexdigest()[:24]
