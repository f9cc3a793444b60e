"""Delivery instructions: intent, ranking of golden records, plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdmill.functions import rules, semantics, text
from mdmill.operators import likeness
from mdmill.session import save


# Words by which an instruction asks for one golden record, or for all.
ONE_WORDS, ALL_WORDS = r"(?i)(?:一个|一条|最相似|第一条|top\s*1)", "(?:全部|所有|整批|批量|新增主数据)"
RANK_WEIGHTS = {**rules.RANK_WEIGHTS, "category": 0.15}
# End of fixed values.
#: Likeness from which a master is listed.
LEAST = 0.30


def short_similarity(a: Column, b: Column) -> Column:
    """Likeness of two standardized short texts: 1 if equal, 0.92 if one holds the other, else at most 0.9 by characters and order; 0 if one is blank."""
    return likeness.likeness(likeness.parts(a), likeness.parts(b), likeness.sequence_ratio(a, b))


def parse_intents(instructions: DataFrame) -> DataFrame:
    """instructions (id, text) with targets, plants, mode, brand, model, name and confidence.

    Brand, model and name are what the labels and brackets of the text say
    (semantics.delivery_filters); without them brand and model are looked for
    before the destination.
    """
    t = F.col("text")
    before = F.split(t, "发往|同步到|分发到|发送到|发到", 2)[0]
    out = instructions.withColumn("said", semantics.delivery_filters(t)).withColumns(
        {
            "targets": semantics.target_systems(t),
            "plants": semantics.target_plants(t),
            "mode": semantics.delivery_mode(t),
            "brand": F.coalesce(F.nullif(F.col("said.brand"), F.lit("")), text.brand(before)),
            "model": F.coalesce(F.nullif(F.col("said.model"), F.lit("")), text.model(before)),
            "name": F.col("said.name"),
        }
    ).drop("said")
    sure = F.lit(0.45) + F.when(F.size("targets") > 0, 0.35).otherwise(0.0) + F.when(F.concat("brand", "model", "name") != "", 0.15).otherwise(0.0)
    return out.withColumn("confidence", F.round(F.least(F.lit(0.98), sure), 2))


def rank_masters(intents: DataFrame, masters: DataFrame, k: int = 20) -> DataFrame:
    """(id, row_id, similarity, level, exact, rank, actionable): approved masters an instruction may mean, best first.

    masters (row_id, brand, model, name, plant_codes as an array, approved, and
    category where instructions have one). Approval and plants are gates; brand,
    model, name, category and the whole text add by their weights. Under 0.30
    nothing is listed; actionable are the exact ones, else those from 0.55, else
    the first. A category has no say in what is exact.

    Instructions that want the same and masters with the same fields meet once.
    They meet where a field, or the text and the name, may be 0.30 alike
    (likeness.candidates); a mean of less is not listed. Each pair has an upper
    bound from character counts. The k best by that bound are compared in full,
    and of the others those whose bound reaches the k-th similarity so found.
    """
    weights = {f: w for f, w in RANK_WEIGHTS.items() if f in intents.columns and f in masters.columns}
    fields = list(weights)
    asked, _ = save(intents.select("id", F.array_sort("plants").alias("plants"), "text", *fields), "intents")
    free = masters.where("approved").select("row_id", "plant_codes", *fields)
    standard = lambda c: likeness.parts(text.standardize(F.coalesce(F.col(c), F.lit(""))))
    whole = likeness.parts(text.standardize(F.concat_ws(" ", "text", *(F.nullif(F.col(f), F.lit("")) for f in fields))))
    kinds, _ = save(free.groupBy(*fields).agg(F.min("row_id").alias("kind")), "kinds")
    has, _ = save(kinds.select("kind", *(standard(f).alias(f"has_{f}") for f in fields)), "has")
    same = asked.groupBy("plants", "text", *fields).agg(F.min("id").alias("want"))
    known, _ = save(asked.join(same, ["plants", "text", *fields]).select("id", "want"), "known")
    wants, _ = save(same.select("want", "plants", whole.alias("want_query"), *(standard(f).alias(f"want_{f}") for f in fields)), "wants")
    compared = [*((f"want_{f}", f"has_{f}", f) for f in fields), ("want_query", "has_name", "query")]

    met = None
    for a, b, _f in compared:
        left, right = wants.select("want", F.col(f"{a}.text").alias("t")).where("t <> ''"), has.select("kind", F.col(f"{b}.text").alias("u")).where("u <> ''")
        distinct = lambda df, c: df.where(f"{c}.text <> ''").select(F.col(c).alias("p")).dropDuplicates(["p"])
        texts = likeness.candidates(distinct(wants, a), distinct(has, b), LEAST)
        texts, _ = save(texts.join(distinct(wants, a), F.col("want") == F.col("p.text")).select(F.col("p").alias("x"), "has").join(distinct(has, b), F.col("has") == F.col("p.text")).where(likeness.most_alike(F.col("x"), F.col("p")) >= LEAST).select(F.col("x.text").alias("t"), F.col("has").alias("u")), "alike")
        some = left.join(texts, "t").join(right, "u").select("want", "kind")
        met = some if met is None else met.unionByName(some)
    wanted = lambda a, f: F.col(f"{a}.text") != "" if f != "query" else F.lit(True)
    pairs = met.distinct().join(wants.drop("plants"), "want").join(has, "kind")
    # Stored field by field: in one expression the likenesses would be worked out many times.
    most, _ = save(pairs.select("want", "kind", *(F.when(wanted(a, f), likeness.most_alike(F.col(a), F.col(b))).alias(f) for a, b, f in compared)), "most")
    bounded = most.select("want", "kind", _mean({f: F.col(f) for _, _, f in compared}, weights)[0].alias("most"))
    places = Window.partitionBy("want").orderBy(F.desc("most"), "kind")
    # A kind counts for what it bounds only if a plant that is asked for may have one of its rows.
    gate = F.arrays_overlap("plants", "plant_codes") | F.array_contains("plant_codes", "GROUP")
    # Of equal masters with equal plants the first k by row_id are all that can be listed.
    copies = Window.partitionBy("kind", "plant_codes").orderBy("row_id")
    rows = free.join(kinds, fields).select("kind", "row_id", "plant_codes")
    rows, _ = save(rows.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k).drop("place"), "listed")
    codes = rows.select("kind", "plant_codes").distinct()
    open_kinds = bounded.where(F.col("most") >= LEAST).join(codes, "kind").join(wants.select("want", "plants"), "want").where(gate).select("want", "kind", "most").distinct()
    bounded, _ = save(open_kinds.withColumn("place", F.row_number().over(places)), "bounded")
    first, _ = save(_exact(bounded.where(F.col("place") <= k), wants, has, compared, weights, wanted), "first")
    least = first.groupBy("want").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(LEAST).alias("least"))
    rest = bounded.where(F.col("place") > k).join(least, "want").where(F.col("most") >= F.col("least"))
    second, _ = save(_exact(rest, wants, has, compared, weights, wanted), "second")
    scored = first.unionByName(second).where(F.col("similarity") >= LEAST)

    order = Window.partitionBy("want").orderBy(F.desc("similarity"), "row_id")
    ranked = scored.join(rows, "kind").join(wants.select("want", "plants"), "want").where(gate).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = Window.partitionBy("want")
    ranked = ranked.withColumns({"any_exact": F.max("exact").over(best), "top": F.max("similarity").over(best)})
    act = F.when(F.col("any_exact"), F.col("exact")).when(F.col("top") >= 0.55, F.col("similarity") >= 0.55).otherwise(F.col("rank") == 1)
    level = F.when(F.col("similarity") >= 0.82, "HIGH").when(F.col("similarity") >= 0.60, "MEDIUM").otherwise("LOW")
    return known.join(ranked, "want").select("id", "row_id", "similarity", level.alias("level"), "exact", "rank", act.alias("actionable"))


def _mean(scores: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """(similarity, exact) of the fields' likenesses; those of fields that are not wanted are null."""
    given = [f for f in scores if f != "query"]
    some = F.coalesce(*(scores[f] for f in given)).isNotNull()
    weight = {**{f: F.lit(weights[f]) for f in given}, "query": F.when(some, 0.10).otherwise(0.35)}
    top = sum((F.coalesce(scores[f], F.lit(0.0)) * w for f, w in weight.items()), F.lit(0.0))
    under = sum((F.when(scores[f].isNotNull(), w).otherwise(0.0) for f, w in weight.items()), F.lit(0.0))
    named = [scores[f] for f in given if f != "category"]
    exact = F.coalesce(*named).isNotNull() & ~sum((F.when(s < 0.86, 1).otherwise(0) for s in named), F.lit(0)).cast("boolean")
    return F.round(F.least(F.lit(0.99), top / under), 4), exact


def _exact(pairs: DataFrame, wants: DataFrame, has: DataFrame, compared, weights, wanted) -> DataFrame:
    """(want, kind, similarity, exact) of pairs (want, kind), each text pair given to the matcher once."""
    whole, _ = save(pairs.select("want", "kind").join(wants.drop("plants"), "want").join(has, "kind"), "pairs")
    unsettled = [whole.where(wanted(a, f) & ~likeness.settled(F.col(a), F.col(b))).select(F.col(f"{a}.text").alias("a"), F.col(f"{b}.text").alias("b")) for a, b, f in compared]
    every = unsettled[0]
    for some in unsettled[1:]:
        every = every.unionByName(some)
    of = likeness.ratios(every)
    for a, b, f in compared:
        whole = whole.join(of.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("ratio").alias(f"ratio_{f}")), (F.col(f"{a}.text") == F.col("__a")) & (F.col(f"{b}.text") == F.col("__b")), "left").drop("__a", "__b")
    scores = [F.when(wanted(a, f), likeness.likeness(F.col(a), F.col(b), F.coalesce(f"ratio_{f}", F.lit(0.0)))).alias(f) for a, b, f in compared]
    rated, _ = save(whole.select("want", "kind", *scores), "rated")
    similarity, exact = _mean({f: F.col(f) for _, _, f in compared}, weights)
    return rated.select("want", "kind", similarity.alias("similarity"), exact.alias("exact"))


def selection_modes(intents: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id, selection_mode): TOP_ONE or ALL if the text says so, else EXPLICIT (a choice is needed) for several actionable masters, SINGLE for one or none."""
    several = ranked.where("actionable").groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("n"))
    mode = (
        F.when(F.col("text").rlike(ONE_WORDS), "TOP_ONE").when(F.col("text").rlike(ALL_WORDS), "ALL").when(F.coalesce("n", F.lit(0)) > 1, "EXPLICIT").otherwise("SINGLE")
    )
    return intents.join(several, F.col("id") == F.col("__id"), "left").select("id", mode.alias("selection_mode"))


def plan_tasks(intents: DataFrame, ranked: DataFrame, masters: DataFrame | None = None) -> DataFrame:
    """(id, row_id, target_system, target_plant, task_id, selection_mode, eligible, selected, status): a task for each actionable master, system and plant.

    masters (row_id, plant_codes) tell whether a plant may get a record: it or
    GROUP is named. Selected are eligible tasks of the best master where one is
    asked for. Instructions without a target system have no tasks.
    """
    chosen = ranked.where("actionable").select("id", "row_id", "rank")
    spread = intents.select("id", F.explode("targets").alias("target_system"), "plants").select("id", "target_system", F.explode("plants").alias("target_plant"))
    tasks = chosen.join(spread, "id").join(selection_modes(intents, ranked), "id")
    eligible = F.lit(True)
    if masters is not None:
        tasks = tasks.join(masters.select("row_id", "plant_codes"), "row_id")
        eligible = F.array_contains("plant_codes", F.col("target_plant")) | F.array_contains("plant_codes", "GROUP")
    key = F.concat_ws("|", F.col("id").cast("string"), F.col("row_id").cast("string"), "target_system", "target_plant")
    tasks = tasks.withColumns({"task_id": F.concat(F.lit("TASK-"), F.upper(F.substring(F.sha1(key), 1, 12))), "eligible": eligible})
    best = F.col("rank") == F.min("rank").over(Window.partitionBy("id"))
    picked = (F.col("selection_mode") == "TOP_ONE") & best & F.col("eligible")
    status = F.when(F.col("eligible"), "PENDING_CONFIRMATION").otherwise("OUT_OF_SCOPE")
    return tasks.withColumns({"selected": picked, "status": status}).select(
        "id", "row_id", "target_system", "target_plant", "task_id", "selection_mode", "eligible", "selected", "status"
    )
