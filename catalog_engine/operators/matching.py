"""Comparing a product's specification with an offer's: per-field states, scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field weights of the comparison (fixed values).
SPEC_WEIGHTS = (("category", 2.0), ("material", 1.2), ("capacity", 1.0), ("pack_count", 1.0), ("dimensions", 1.0), ("color", 0.4))


def same(a: Column, b: Column) -> Column:
    """True, false, or null if either side is unknown."""
    return a == b


def close_number(target: Column, other: Column, tolerance: float) -> Column:
    return F.abs(target - other) <= F.abs(target) * tolerance


def close_dimensions(target: Column, other: Column, tolerance: float = 0.15) -> Column:
    """Sides compared in order of size, each within the tolerance of the larger of it and 1."""
    pairs = F.zip_with(F.sort_array(target), F.sort_array(other), lambda a, b: F.abs(a - b) <= tolerance * F.greatest(a, F.lit(1.0)))
    return F.when((F.size(target) == 3) & (F.size(other) == 3), F.forall(pairs, lambda x: x))


def compare_specs(states: dict[str, Column], has_target: dict[str, Column], features: Column | None = None, hits: Column | None = None) -> Column:
    """struct(score, matched, missing, conflicts) of tri-state fields.

    A true field earns its weight, a false one nothing and is a conflict, an unknown
    one earns 0.35 of it where the target has the field and is skipped otherwise.
    """
    score, total = F.lit(0.0), F.lit(0.0)
    matched, missing, conflicts = [], [], []
    for name, weight in SPEC_WEIGHTS:
        if name not in states:
            continue
        s, has = states[name], has_target[name]
        counted = s.isNotNull() | has
        total = total + F.when(counted, F.lit(weight)).otherwise(F.lit(0.0))
        score = score + F.when(s, F.lit(weight)).when(s.isNull() & has, F.lit(weight) * 0.35).otherwise(F.lit(0.0))
        matched.append(F.when(s, F.lit(name)))
        conflicts.append(F.when(~s, F.lit(name)))
        missing.append(F.when(s.isNull() & has, F.lit(name)))
    if features is not None:
        n = F.coalesce(F.size(features), F.lit(0))
        total = total + F.when(n > 0, F.lit(0.8)).otherwise(F.lit(0.0))
        score = score + F.when((n > 0) & (hits > 0), F.lit(0.8) * F.least(hits / n, F.lit(1.0))).when(n > 0, F.lit(0.2)).otherwise(F.lit(0.0))
        matched.append(F.when((n > 0) & (hits > 0), F.lit("features")))
        missing.append(F.when((n > 0) & ~(hits > 0), F.lit("features")))
    listed = lambda cs: F.array_compact(F.array(*cs))
    return F.struct(F.round(F.when(total > 0, score / total).otherwise(F.lit(0.0)), 4).alias("score"), listed(matched).alias("matched"), listed(missing).alias("missing"), listed(conflicts).alias("conflicts"))


def match_quality(attribute: Column, title: Column, spec: Column, visual: Column, n_conflicts: Column, irrelevant: Column) -> Column:
    """struct(score, decision): heuristics of attributes and title blended with specification and visual evidence; conflicts scale it down; keep above 0.40."""
    h = F.lit(0.40) * F.coalesce(attribute, F.lit(0.45)) + F.lit(0.60) * F.coalesce(title, F.lit(0.45))
    blend = F.lit(0.55) * h + F.lit(0.30) * F.coalesce(spec, F.lit(0.45)) + F.lit(0.15) * F.coalesce(visual, F.lit(0.45))
    scaled = blend * F.greatest(F.lit(0.45), F.lit(1.0) - F.lit(0.15) * n_conflicts)
    value = F.when(irrelevant, F.lit(0.0)).otherwise(F.round(scaled, 4))
    return F.struct(value.alias("score"), F.when(value > 0.40, "keep").otherwise("reject").alias("decision"))


def match_decision(mismatch: Column, malformed_visual: Column, manual_profile: Column, missing: Column, critical: Column, confidence: Column) -> Column:
    """struct(decision, confidence): any mismatch rejects, whatever the score; unclear evidence caps the confidence at 0.49."""
    lacks = F.arrays_overlap(missing, critical)
    capped = F.least(confidence, F.lit(0.49))
    decision = (
        F.when(F.size(mismatch) > 0, "reject")
        .when(malformed_visual | manual_profile, "manual_review")
        .when(lacks, "retry")
        .when(confidence >= 0.70, "keep")
        .otherwise("manual_review")
    )
    value = F.when((F.size(mismatch) == 0) & (malformed_visual | manual_profile | lacks), capped).otherwise(confidence)
    return F.struct(decision.alias("decision"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4).alias("confidence"))


def pair_specs(targets: DataFrame, candidates: DataFrame, key: str, spec: str = "spec") -> DataFrame:
    """Targets with each candidate of their key and ``match``: struct of compare_specs over the two specifications (structs of specs.extract_specs). Features count as hits where the candidate has them."""
    other = {c: f"candidate_{c}" if c in targets.columns and c != key else c for c in candidates.columns}
    pairs = targets.join(candidates.withColumnsRenamed(other), key)
    a, b = (lambda n: F.col(f"{spec}.{n}")), (lambda n: F.col(f"{other[spec]}.{n}"))
    names = {"category": "category", "material": "material", "color": "color", "pack_count": "pack_count", "capacity": "capacity_ml", "dimensions": "dimensions_cm"}
    states = {"capacity": close_number(a("capacity_ml"), b("capacity_ml"), 0.12), "dimensions": close_dimensions(a("dimensions_cm"), b("dimensions_cm"))}
    states |= {n: same(a(n), b(n)) for n in ("category", "material", "color", "pack_count")}
    has = {n: a(c).isNotNull() for n, c in names.items()}
    return pairs.withColumn("match", compare_specs(states, has, a("features"), F.size(F.array_intersect(a("features"), b("features")))))


#: Conflicts of a specification that no score outweighs, and evidence that a decision cannot do without (fixed values).
HARD_SPECS = ("capacity", "dimensions", "material", "pack_count")
CRITICAL_STATES = ("function", "product_type", "price", "moq")


def match_evidence(states: dict[str, Column], spec: Column, profile: Column | None = None, visual_match: Column | None = None, malformed_visual: Column | None = None, brand_exclusive: Column | None = None, wants_quantity: Column | None = None) -> Column:
    """struct(decision, confidence, mismatch, missing, passed) of a product and an offer.

    ``states``: 1.0, 0.0 or null for function, product_type, price, moq and, where the
    product asks for them, package_quantity (``wants_quantity``) and manufacturer (with a
    profile). ``spec``: struct of compare_specs; ``profile``: struct of
    profiles.compare, null where the product has none. Mismatches are named from the
    states and conflicts, confidence is the mean of the known states and the profile's
    (else the specification's) score.
    """
    none, false = F.array().cast("array<string>"), F.lit(False)
    flag = lambda c: F.coalesce(c, false) if c is not None else false
    has_profile = profile.isNotNull() if profile is not None else false
    asked = {n: F.lit(True) for n in CRITICAL_STATES} | {"package_quantity": flag(wants_quantity), "manufacturer": has_profile}
    state = {n: states[n] if n in states else F.lit(None).cast("double") for n in asked}
    known = {n: asked[n] & state[n].isNotNull() for n in asked}
    prefixed = lambda names, head: F.transform(F.coalesce(names, none), lambda x: F.concat(F.lit(head), x))
    of_profile = lambda name, head: F.when(has_profile, prefixed(profile[name], head)).otherwise(none) if profile is not None else none
    bad = {"product_type": "accessory_full_product_conflict", "package_quantity": "package_quantity_conflict", "function": "core_function_conflict"}
    seen = F.coalesce(visual_match, F.lit(None).cast("boolean")) if visual_match is not None else F.lit(None).cast("boolean")
    listed = lambda cs: F.array_compact(F.array(*cs))
    hard = F.array_sort(F.array_intersect(spec["conflicts"], F.array(*[F.lit(x) for x in HARD_SPECS])))
    mismatch = F.array_distinct(F.concat(
        listed([*[F.when(asked[n] & (state[n] == 0), F.lit(m)) for n, m in bad.items()], F.when(flag(brand_exclusive), F.lit("brand_exclusive_conflict"))]),
        prefixed(hard, "specification_conflict:"), of_profile("conflicts", "target_category_conflict:"),
        listed([F.when(has_profile & (state["manufacturer"] == 0), F.lit("manufacturer_evidence_conflict")), F.when(~seen, F.lit("visual_mismatch"))]),
    ))
    malformed = flag(malformed_visual) & seen.isNull()
    missing = F.array_sort(F.array_distinct(F.concat(listed([*[F.when(asked[n] & ~known[n], F.lit(n)) for n in asked], F.when(malformed, F.lit("visual"))]), of_profile("missing", "target_category:"))))
    passed = F.array_distinct(F.concat(listed([F.when(known[n] & (state[n] == 1), F.lit(n)) for n in asked]), of_profile("matched", "target_category:"), listed([F.when(seen, F.lit("visual"))])))
    score = F.when(has_profile, profile["score"]).otherwise(spec["score"]) if profile is not None else spec["score"]
    total = sum((F.when(known[n], state[n]).otherwise(F.lit(0.0)) for n in asked), F.lit(0.0)) + score
    count = sum((known[n].cast("int") for n in asked), F.lit(1))
    manual = has_profile & (profile["decision"] == "manual_review") if profile is not None else false
    critical = listed([F.when(asked[n], F.lit(n)) for n in asked])
    verdict = match_decision(mismatch, malformed, F.coalesce(manual, false), missing, critical, total / count)
    return F.struct(verdict["decision"].alias("decision"), verdict["confidence"].alias("confidence"), mismatch.alias("mismatch"), missing.alias("missing"), passed.alias("passed"))


def type_match(target: Column, other: Column) -> Column:
    """1.0 or 0.0 where both kinds are known, else null."""
    known = (target != "unknown") & (other != "unknown")
    return F.when(known & (target == other), F.lit(1.0)).when(known, F.lit(0.0))


def function_match(target: Column, other: Column) -> Column:
    """1.0 if any wanted function is offered, 0.0 if none, null if either list is unknown or empty."""
    known = (F.size(target) > 0) & (F.size(other) > 0)
    return F.when(known & F.arrays_overlap(target, other), F.lit(1.0)).when(known, F.lit(0.0))


def manufacturer_match(factory: Column) -> Column:
    return F.when(factory, F.lit(1.0)).when(~factory, F.lit(0.0))


def alias_group(value: Column, groups: dict[str, list[str]]) -> Column:
    """Name of the group whose words hold the value (lower case), else the value itself."""
    low = F.lower(F.trim(value))
    out = low
    for name, words in groups.items():
        out = F.when(low.isin(name, *words), F.lit(name)).otherwise(out)
    return out


#: Colours and materials that count as one (fixed values).
COLOURS = {"black": ["黑", "黑色"], "white": ["白", "白色"], "grey": ["gray", "灰", "灰色"], "blue": ["蓝", "蓝色"], "red": ["红", "红色"], "green": ["绿", "绿色"], "brown": ["棕", "棕色"]}
MATERIALS = {"steel": ["stainless steel", "不锈钢"], "aluminum": ["aluminium", "铝", "铝合金"], "plastic": ["pp", "pe", "abs", "塑料"], "wood": ["wooden", "bamboo", "木", "竹"], "glass": ["玻璃"], "silicone": ["硅胶"]}
