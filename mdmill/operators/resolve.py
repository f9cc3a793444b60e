"""Entity resolution: match pairs, components, golden records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdmill.functions import rules, text
from mdmill.functions.semantics import golden_code, shown_attributes, standard_name
from mdmill.operators.components import connected_components
from mdmill.session import save
from mdmill.sources.materials import enrich

ATTRIBUTES = ["model", "brand", "dn", "pressure", "material"]
#: A pair needs this cosine before the bonuses for brand and material.
LEAST_COSINE = rules.EDGE - rules.SAME_BRAND - rules.SAME_MATERIAL


def token_weights(items: DataFrame) -> DataFrame:
    """(id, token, w, rest): unit term-frequency vectors; rest is the norm of the token and all more common ones.

    items has id and tokens. A token whose rest is at least LEAST_COSINE lies in
    the prefix: two vectors of that cosine share a token that is in both prefixes.
    """
    counts = items.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    common = counts.groupBy("token").agg(F.count("*").alias("df"))
    own = Window.partitionBy("id")
    tail = own.orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    unit = counts.join(common, "token").withColumn("w", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(own)))
    return unit.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(tail)))


def match_pairs(records: DataFrame) -> DataFrame:
    """(src, dst) row ids: pairs that score EDGE by token cosine with bonuses, or SEMANTIC_EDGE by characters.

    records are enriched, with row_id. Rows with equal texts are one item and
    linked to its least row. Items are compared only if they share a rare token
    (prefix filter on the cosine, with what brand and material add) or a rare character (prefix filter on the
    character sets), which loses no pair that qualifies. Two different
    non-blank models, pressures or sizes forbid a pair.
    """
    key = ["material_name", "description", "std_category"]
    whole = F.concat_ws(" ", "material_name", "description", F.lit(""))
    items = records.groupBy(*key).agg(F.min("row_id").alias("id"), *(F.first(a).alias(a) for a in ATTRIBUTES))
    items, _ = save(items.withColumns({"standard": text.standardize(whole), "semantic": text.standardize(F.concat_ws(" ", *key))}), "standard")
    items, _ = save(items.withColumn("plain", text.plain(F.col("standard"))), "plain")
    items = items.withColumn("tokens", text.semantic_tokens(*(F.col(a) for a in (*ATTRIBUTES, "standard", "plain"))))
    items, _ = save(
        items.withColumn(
            "letters",
            F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower("semantic"), r"(?U)\s+", ""), "")), lambda c: c != ""),
        ),
        "items",
    )
    same = records.join(items.select(*key, "id"), key).where("row_id <> id").select(F.col("id").alias("src"), F.col("row_id").alias("dst"))
    weights, _ = save(token_weights(items), "weights")
    prefix = weights.where(F.col("rest") >= LEAST_COSINE - 1e-9).select("id", "token", "rest")
    letters = items.select("id", F.size("letters").alias("n"), F.explode("letters").alias("token"))
    common = letters.groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    first = letters.join(common, "token").withColumn("place", place)
    first = first.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * rules.SEMANTIC_EDGE - 1e-9) + 1).select("id", "token", F.lit(1.0).alias("rest"))
    # Items that differ in a stated model, pressure or size never match: the guards hold before pairs are made,
    # and letter sets of sizes too far apart are not paired at all. The cosine of two items is at most the product of what
    # their vectors weigh from the first common token on, so that product must reach what brand and material leave to reach.
    guard = items.select("id", F.size("letters").alias("size"), "model", "pressure", "dn", "brand", "material")
    equal = lambda a: (F.col(a) != "") & (F.col(a) == F.col(f"{a}_o"))
    needed = rules.EDGE - F.when(equal("brand"), rules.SAME_BRAND).otherwise(0.0) - F.when(equal("material"), rules.SAME_MATERIAL).otherwise(0.0)

    def meet(keys, sized):
        own = keys.join(guard, "id")
        other = own.select("token", *(F.col(c).alias(f"{c}_o") for c in ("id", "rest", "size", "model", "pressure", "dn", "brand", "material")))
        both = own.join(other, "token").where("id < id_o")
        for a in ("model", "pressure", "dn"):
            both = both.where(f"{a} = '' OR {a}_o = '' OR {a} = {a}_o")
        if sized:
            both = both.where(F.least("size", "size_o") >= F.greatest("size", "size_o") * rules.SEMANTIC_EDGE - 1e-9)
        else:
            both = both.where(F.col("rest") * F.col("rest_o") >= needed - 1e-9)
        return both.select("id", F.col("id_o").alias("other"))

    pairs = meet(prefix, False).union(meet(first, True)).distinct()
    side = lambda n: items.select(*(F.col(c).alias(f"{c}_{n}") for c in ("id", *ATTRIBUTES, "letters")))
    pairs = pairs.join(side(1), F.col("id") == F.col("id_1")).join(side(2), F.col("other") == F.col("id_2"))
    for a in ("model", "pressure", "dn"):
        pairs = pairs.where(f"{a}_1 = '' OR {a}_2 = '' OR {a}_1 = {a}_2")
    pairs, _ = save(pairs.drop("id_1", "id_2"), "pairs")
    mine = weights.select("id", "token", "w")
    yours = weights.select(F.col("id").alias("other"), F.col("token"), F.col("w").alias("v"))
    cosine = pairs.select("id", "other").join(mine, "id").join(yours, ["other", "token"]).groupBy("id", "other").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    score = (
        F.coalesce("cosine", F.lit(0.0))
        + F.when((F.col("brand_1") != "") & (F.col("brand_1") == F.col("brand_2")), rules.SAME_BRAND).otherwise(0.0)
        + F.when((F.col("material_1") != "") & (F.col("material_1") == F.col("material_2")), rules.SAME_MATERIAL).otherwise(0.0)
    )
    both = F.size(F.array_intersect("letters_1", "letters_2"))
    alike = both / (F.size("letters_1") + F.size("letters_2") - both)
    linked = pairs.join(cosine, ["id", "other"], "left").where((score >= rules.EDGE - 1e-12) | (alike >= rules.SEMANTIC_EDGE))
    return same.union(linked.select(F.col("id").alias("src"), F.col("other").alias("dst")))


def golden_records(records: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """One row a component of match_pairs: master_id (least row_id), attributes of that row, name, code, members, decision, confidence.

    A component of one row is NEW, one with two different values of model, dn,
    pressure or material is up for REVIEW, others merge. The standard name
    comes from the member with the longest name (the least row_id of those),
    the code from category and name. anomalies (row_id) are counted per record.
    """
    rows, _ = save(enrich(records), "enriched")
    found = connected_components(match_pairs(rows))
    members = rows.join(found, F.col("row_id") == F.col("id"), "left").withColumn("master_id", F.coalesce("component", "row_id"))
    return fuse(members.drop("id", "component"), anomalies)


def fuse(members: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Golden records of enriched members with their master_id; see golden_records. A hot component is aggregated before it is shuffled."""
    shown = shown_attributes(members).select("row_id", F.struct(standard_name().alias("name")).alias("shown"))
    members = members.join(shown, "row_id")
    members = members.withColumn("odd", F.lit(0)) if anomalies is None else members.join(
        anomalies.select("row_id", F.lit(1).alias("odd")).distinct(), "row_id", "left"
    )
    values = lambda a: F.collect_set(F.nullif(F.col(a), F.lit("")))
    several = lambda a: F.min(F.nullif(F.col(a), F.lit(""))) != F.max(F.nullif(F.col(a), F.lit("")))
    grouped = members.groupBy("master_id").agg(
        F.min_by(F.struct("std_category", *ATTRIBUTES), "row_id").alias("lead"),
        F.max_by("shown.name", F.struct(F.length("material_name"), -F.col("row_id"))).alias("standard_name"),
        F.count("*").alias("source_count"),
        F.count_distinct(F.nullif(F.col("material_code"), F.lit(""))).alias("code_count"),
        F.array_join(F.sort_array(values("system_source")), ",").alias("source_systems"),
        F.array_join(F.sort_array(values("plant_code")), ",").alias("plant_codes"),
        F.count_if(F.col("odd") == 1).alias("anomaly_count"),
        *(F.coalesce(several(a), F.lit(False)).alias(f"two_{a}") for a in ("model", "dn", "pressure", "material")),
    )
    conflict = F.col("two_model") | F.col("two_dn") | F.col("two_pressure") | F.col("two_material")
    decision = F.when(F.col("source_count") == 1, "NEW").when(conflict, "REVIEW").otherwise("AUTO_MERGE")
    signature = F.concat_ws("|", "lead.std_category", "standard_name")
    return grouped.select(
        "master_id",
        F.col("lead.std_category").alias("category"),
        *(F.col(f"lead.{a}").alias(a) for a in ATTRIBUTES),
        "standard_name",
        golden_code(F.col("lead.std_category"), signature).alias("mdm_code"),
        "source_count",
        "code_count",
        "source_systems",
        "plant_codes",
        "anomaly_count",
        decision.alias("decision"),
        F.when(F.col("source_count") == 1, 0.60).when(conflict, 0.72).otherwise(0.92).alias("confidence"),
    )
