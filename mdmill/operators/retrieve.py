"""Retrieval over a standard tree and attribute search over golden records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdmill.functions import rules, text
from mdmill.functions.semantics import bare, bare_similarity, hashed_vectors, pieces, terms
from mdmill.session import gather, save, spread

#: A tree or query table up to so many rows is broadcast; a larger one is joined in blocks of that size.
BLOCK_ROWS = 5_000


def blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """df cut by a hash into parts small enough to broadcast; together they are df."""
    n = -(-df.count() // BLOCK_ROWS) or 1
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def hybrid_search(queries: DataFrame, entries: DataFrame, aliases: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, code, score, rule, lexical, vector, rank, margin, decision): the k best entries of each query.

    queries (query_id, text), entries (code, content), aliases (target,
    keywords). An entry scores by the aliases that point to it, shared terms
    and hashed vectors; its code in the query counts as a full hit. Targets of
    aliases outside the tree are candidates too, by the keywords of one
    alias (the greatest), once an alias hits. Equal texts are scored once. Ties go to the
    smaller code. decision looks at the best score and its lead over the next.
    """
    asked = spread(queries.groupBy("text").agg(F.min("query_id").alias("id")))
    asked, _ = save(asked.withColumns({"t": terms(F.col("text")), "bare": bare(F.col("text")), "digits": F.regexp_replace("text", "[^0-9]", "")}), "asked")
    one = asked.drop("text")
    outside = aliases.join(entries.select(F.col("code").alias("target")), "target", "left_anti")
    outside = outside.groupBy(F.col("target").alias("code")).agg(F.max("keywords").alias("content")).withColumn("outside", F.lit(True))
    tree = entries.select("code", "content", F.lit(False).alias("outside")).unionByName(outside)
    tree, _ = save(tree.withColumns({"ct": terms(F.col("content")), "held": bare(F.col("content")), "id": F.col("code")}), "tree")
    qv = hashed_vectors(asked, pieces(F.col("bare"))).select(F.col("id"), "idx", "w")
    ev = hashed_vectors(tree, pieces(F.col("held"))).select(F.col("id").alias("code"), "idx", F.col("w").alias("v"))
    cosine = qv.join(ev, "idx").groupBy("id", "code").agg(F.sum(F.col("w") * F.col("v")).alias("vector"))
    words = F.filter(F.transform(F.split("keywords", rules.KEYWORD_BREAK), bare), lambda w: w != "")
    rated = []
    named, _ = save(aliases.select("target", words.alias("words"), terms(F.col("keywords")).alias("kt"), bare(F.col("keywords")).alias("held")), "named")
    for part in blocks(named, "target"):
        hit = F.exists("words", lambda w: F.col("bare").contains(w))
        likeness = bare_similarity(F.col("bare"), F.col("held"), F.col("t"), F.col("kt"))
        rule = F.when(hit, 1.0).when(likeness >= 0.6, 0.65).otherwise(likeness * 0.5)
        rated.append(one.crossJoin(part).select("id", F.col("target").alias("code"), rule.alias("rule")))
    rated = gather(rated).groupBy("id", "code").agg(F.max("rule").alias("rule"))
    lexical = []
    for part in blocks(tree.drop("id", "content"), "code"):
        some = one.crossJoin(part).select(
            "id", "code",
            bare_similarity(F.col("bare"), F.col("held"), F.col("t"), F.col("ct")).alias("lexical"),
            (~F.col("outside") & F.col("digits").contains(F.col("code"))).alias("exact"),
            "outside",
        )
        lexical.append(some)
    lexical = gather(lexical)
    a, b, c = rules.RETRIEVAL_WEIGHTS
    scored = lexical.join(rated, ["id", "code"], "left").where("NOT outside OR rule > 0").join(cosine, ["id", "code"], "left").select(
        "id", "code",
        F.when(F.col("exact"), 1.0).otherwise(F.coalesce("rule", F.lit(0.0))).alias("rule"),
        F.when(F.col("exact"), 1.0).otherwise(F.col("lexical")).alias("lexical"),
        F.greatest(F.coalesce("vector", F.lit(0.0)), F.lit(0.0)).alias("vector"),
    )
    scored = scored.withColumn("score", F.round(F.least(F.lit(1.0), F.col("rule") * a + F.col("lexical") * b + F.col("vector") * c), 6))
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("rule"), "code")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(k, 2))
    lead = F.first("score").over(best) - F.coalesce(F.nth_value("score", 2).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    first = F.first("score").over(best)
    decided = top.withColumns({"margin": F.round(lead, 6), "first": first}).where(F.col("rank") <= k)
    verdict = F.when((F.col("first") >= rules.AUTO_SCORE) & (F.col("margin") >= rules.AUTO_MARGIN), "AUTO_RECOMMEND").otherwise("REVIEW")
    known = queries.join(asked.select("text", "id"), "text").select("query_id", "id")
    shown = (F.round(c, 6).alias(c) for c in ("rule", "lexical", "vector"))
    return known.join(decided, "id").select("query_id", "code", "score", *shown, "rank", "margin", verdict.alias("decision"))


def classify(queries: DataFrame, entries: DataFrame, aliases: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """(query_id, code, path, confidence, candidates, decision, needs_review, evidence_ids), a row for each query (query_id, text).

    code is the best entry, path its content cut at ' / ' (null for a target
    outside the tree), candidates the best three as (code, score), evidence_ids
    the citations of the best (cited: code, citation_id). A query that is blank
    or finds nothing is UNRESOLVED and needs a person, as all but
    AUTO_RECOMMEND do.
    """
    asked = queries.where(text.clean(F.col("text")) != "")
    ranked = F.sort_array(F.collect_list(F.struct("rank", "code", "score")))
    found = hybrid_search(asked, entries, aliases, 3).groupBy(F.col("query_id").alias("__q")).agg(ranked.alias("r"), F.first("decision").alias("decision"))
    paths = entries.groupBy(F.col("code").alias("__code")).agg(F.split(F.min("content"), " / ").alias("path"))
    best = found.withColumn("code", F.col("r")[0]["code"]).join(paths, F.col("code") == F.col("__code"), "left")
    if cited is not None:
        best = with_citations(best, cited).withColumnRenamed("citation_ids", "evidence_ids")
    else:
        best = best.withColumn("evidence_ids", F.array().cast("array<string>"))
    decision = F.coalesce("decision", F.lit("UNRESOLVED"))
    return queries.select("query_id").join(best, F.col("query_id") == F.col("__q"), "left").select(
        "query_id", "code", "path", F.col("r")[0]["score"].alias("confidence"), F.transform("r", lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"))).alias("candidates"),
        decision.alias("decision"), (decision != "AUTO_RECOMMEND").alias("needs_review"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
    )


def citations(rows: DataFrame, excerpt: Column) -> DataFrame:
    """rows with citation_id, the place of each in its source file, one row a place; rows that repeat a place keep the greatest record hash.

    rows (standard_no, version_label, filename, source_sha256, sheet, row_no,
    cell_range, record_sha256); excerpt is a text over their columns.
    """
    place = F.concat(F.upper(F.substring("source_sha256", 1, 12)), F.lit("#"), "sheet", F.lit("!"), F.col("row_no").cast("string"))
    fields = ["standard_no", "version_label", "filename", "source_sha256", "sheet", "row_no", "cell_range", "record_sha256"]
    cited = rows.select(place.alias("citation_id"), *fields, excerpt.alias("excerpt"))
    last = F.max_by(F.struct(*fields, "excerpt"), "record_sha256").alias("c")
    return cited.groupBy("citation_id").agg(last).select("citation_id", "c.*")


def with_citations(results: DataFrame, cited: DataFrame) -> DataFrame:
    """results of hybrid_search with the array citation_ids of cited (code, citation_id), in order; empty where a code has none."""
    ids = cited.groupBy("code").agg(F.sort_array(F.collect_set("citation_id")).alias("citation_ids"))
    return results.join(ids, "code", "left").withColumn("citation_ids", F.coalesce("citation_ids", F.array().cast("array<string>")))


def search_conditions(queries: DataFrame) -> DataFrame:
    """queries (query_id, text) with the conditions their texts state; '' where one is not stated."""
    q = F.col("text")
    barred = F.regexp_extract(q, rf"(?i)(?:{rules.EXCLUDE_WORDS})(?:的|是)?\s*([A-Za-z0-9一-龥]+)", 1)
    span = lambda i: F.regexp_extract(q, r"(?i)DN\s*(\d+)\s*[~—-]\s*(\d+)", i)
    category = text.category(text.standardize(q), F.lit(""))
    return queries.withColumns(
        {
            "q_exclude": text.material(barred),
            "q_model": text.model(q),
            "q_brand": text.brand(q),
            "q_dn_from": F.nullif(span(1), F.lit("")).cast("long"),
            "q_dn_to": F.nullif(span(2), F.lit("")).cast("long"),
            "q_pressure": text.pressure(q),
            "q_category": F.when(category == rules.OTHER, "").otherwise(category),
        }
    ).withColumns(
        {
            "q_material": F.when(F.col("q_exclude") == "", text.material(q)).otherwise(""),
            "q_dn": F.when(F.col("q_dn_from").isNull(), text.dn(q)).otherwise(""),
        }
    )


def attribute_search(queries: DataFrame, masters: DataFrame, mode: str = "and", k: int = 20, suggestions: int = 0) -> DataFrame:
    """(query_id, row_id, score, matched, required, rank): the k best masters of each query, ties by row_id.

    masters are enriched records with `name`. mode `and` asks for all stated
    conditions, `or` for one, `fuzzy` for one or a likeness in words. A column
    qty_min of queries asks for masters with so many records (source_count of
    masters). Equal queries are asked and equal masters scored once; of equal
    masters, which take their places by row_id, the first ones are all that can
    be listed.
    With suggestions, a query of mode `and` that finds nothing lists so many
    masters that meet at least half of its conditions, by share met and score,
    and a column `suggestion` tells them from results.
    """
    if suggestions and mode != "and":
        raise ValueError("suggestions are for the mode `and`")
    counted = "qty_min" in queries.columns
    keys = ["name", *rules.SEARCH_WEIGHTS, *(["source_count"] if counted else [])]
    rows = masters.withColumn("category", F.col("std_category")).select("row_id", *keys)
    equal = Window.partitionBy(*keys).orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = rows.withColumns({"kind": F.first("row_id").over(equal), "place": F.row_number().over(equal)}).where(F.col("place") <= max(k, suggestions))
    members, _ = save(first, "members")
    kinds, _ = save(spread(members.where("place = 1")).select(*keys, "kind"), "kinds")
    members = members.select("kind", "row_id")
    words = F.lower(F.concat_ws(" ", "name", "category", "model", "brand", "dn", "pressure", "material"))
    pairs_of = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    letters = lambda c: F.filter(F.array_distinct(F.split(F.regexp_replace(c, r"(?U)\s+", ""), "")), lambda x: x != "")
    kinds = kinds.withColumn("whole", text.standardize(words))
    kinds, _ = save(kinds.withColumns({"grams": F.array_distinct(pairs_of(F.col("whole"))), "letters": letters(F.col("whole"))}), "whole")
    alike = F.to_json(F.struct("text", *(["qty_min"] if counted else [])))
    known, _ = save(queries.withColumn("__asked", alike), "queries")
    once = known.groupBy("__asked").agg(F.min("query_id").alias("query_id"), F.first("text").alias("text"), *([F.first("qty_min").alias("qty_min")] if counted else []))
    known = known.select(F.col("query_id").alias("__query"), "__asked").join(once.select("__asked", "query_id"), "__asked").drop("__asked")
    asked = search_conditions(spread(once.drop("__asked"))).withColumn("q_whole", text.standardize(F.col("text")))
    asked, _ = save(asked.withColumns({"q_grams": F.array_distinct(pairs_of(F.col("q_whole"))), "q_letters": letters(F.col("q_whole"))}), "asked")
    found = []
    for part in blocks(asked, "query_id"):
        pair = kinds.crossJoin(part)
        stated, hits, score = F.lit(0), F.lit(0), F.lit(0.0)
        for field, weight in rules.SEARCH_WEIGHTS.items():
            wanted, has = F.lower(f"q_{field}"), F.lower(field)
            same = wanted == has
            if field == "category":
                same = same | has.contains(wanted) | wanted.contains(has)
            hit = (wanted != "") & same
            stated, hits, score = stated + (wanted != "").cast("int"), hits + hit.cast("int"), score + F.when(hit, weight).otherwise(0.0)
        ranged = F.col("q_dn_from").isNotNull()
        within = ranged & F.coalesce(F.expr("try_cast(dn AS BIGINT)").between(F.col("q_dn_from"), F.col("q_dn_to")), F.lit(False))
        stated, hits, score = stated + ranged.cast("int"), hits + within.cast("int"), score + F.when(within, 0.20).otherwise(0.0)
        if counted:
            asks = F.col("qty_min").isNotNull()
            enough = asks & F.coalesce(F.col("source_count") >= F.col("qty_min"), F.lit(False))
            stated, hits, score = stated + asks.cast("int"), hits + enough.cast("int"), score + F.when(enough, 0.10).otherwise(0.0)
        overlap = F.size(F.array_intersect("q_grams", "grams")) / F.size("q_grams")
        alike = F.size(F.array_intersect("q_letters", "letters")) / F.greatest(F.size(F.array_union("q_letters", "letters")), F.lit(1))
        rated = pair.where((F.col("q_exclude") == "") | ~F.col("whole").contains(F.lower("q_exclude"))).select(
            "query_id", "kind", stated.alias("required"), hits.alias("matched"), overlap.alias("overlap"), alike.alias("alike"), score.alias("base")
        )
        some = rated.withColumn("score", F.col("base") + F.least(F.lit(0.20), F.col("overlap") * 0.20) + F.when(F.col("alike") >= 0.45, F.least(F.lit(0.35), F.col("alike") * 0.35)).otherwise(0.0))
        free = F.col("required") == 0
        passes = {
            "and": free | (F.col("matched") == F.col("required")),
            "or": free | (F.col("matched") > 0),
            "fuzzy": free | (F.col("matched") > 0) | (F.col("alike") >= 0.45) | (F.col("overlap") >= 0.18),
        }[mode]
        if mode == "fuzzy":
            some = some.withColumn("score", F.when(F.col("score") > 0, F.col("score") * 1.15 + 0.03).otherwise(F.col("score")))
        kept = passes & (F.col("score") > 0)
        if suggestions:
            kept |= (F.col("matched") > 0) & (F.try_divide("matched", "required") >= 0.5)
        found.append(some.where(kept).select("query_id", "kind", "score", "matched", "required"))
    found, _ = save(gather(found), "found")
    near = (F.col("required") > 0) & (F.col("matched") < F.col("required")) if suggestions else F.lit(False)
    value = F.when(near, F.least(F.col("score") * 0.75 + F.try_divide("matched", "required") * 0.20, F.lit(0.89))).otherwise(F.least("score", F.lit(0.99)))
    found = found.select("query_id", "kind", F.round(value, 4).alias("score"), "matched", "required", near.alias("suggestion"))

    def best_rows(some: DataFrame, first: list, k: int) -> DataFrame:
        """The k best rows of each query: kinds that cannot reach them go before their rows are listed."""
        best = Window.partitionBy("query_id").orderBy(*first, "kind")
        least = some.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).groupBy("query_id").agg(F.max("place").alias("least"))
        tied = some.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(*first)))
        order = Window.partitionBy("query_id").orderBy(*first, "row_id")
        reach = tied.join(least, "query_id").where("place <= least").join(members, "kind")
        return reach.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    out = [F.col("__query").alias("query_id"), "row_id", "score", "matched", "required", "rank"]
    ranked = best_rows(found.where("NOT suggestion"), [F.desc("score")], k)
    if not suggestions:
        return ranked.join(known, "query_id").select(*out)
    answered = found.where("NOT suggestion").select("query_id").distinct()
    near = found.where("suggestion").join(answered, "query_id", "left_anti")
    near = best_rows(near, [F.desc(F.try_divide("matched", "required")), F.desc("score")], suggestions)
    return ranked.unionByName(near).join(known, "query_id").select(*out, "suggestion")
